"""Held-out run: the chosen configs on a later slice, without tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.forecast import Config, native_log, window_counts
from tidemark.operators.metrics import config_scores, unscored_runs
from tidemark.plans.tune import Learner
from tidemark.schema import BASELINE, BASELINE_CONFIG
from tidemark.session import stored
from tidemark.sources.logs import resume_anti


def union_distinct_models(best: DataFrame) -> DataFrame:
    """Per market the stored models and the baseline, each once."""
    baseline = best.select("market", F.lit(BASELINE).alias("model"))
    return best.select("market", "model").union(baseline).distinct()


def best_config_join(best: DataFrame) -> DataFrame:
    """The config to run per (market, model); the baseline is there even if it was not stored."""
    stored = best.select("market", "model", "config_index", "hyperparams_json")
    default = best.select("market").distinct().select(
        "market", F.lit(BASELINE).alias("model"),
        F.lit(BASELINE_CONFIG).alias("config_index"), F.lit("{}").alias("hyperparams_json"))
    missing = default.join(stored, ["market", "model"], "left_anti")
    return stored.unionByName(missing)


def held_out_log(labelled: DataFrame, best: DataFrame, configs: Sequence[Config], window_size: int,
                 test_ratio: float, learner: Learner = native_log, done: DataFrame | None = None,
                 max_windows: int | None = None) -> DataFrame:
    """Log of the chosen config of each (market, model) on the held-out slice.

    Pairs that ``done`` (an earlier log, each window once) holds in full are left out.
    """
    todo = best_config_join(best)
    if done is not None:
        todo = resume_anti(todo, done, expected=window_counts(labelled, window_size, max_windows))
    more = {} if max_windows is None else {"max_windows": max_windows}
    return learner(labelled, configs, window_size, test_ratio, todo=todo, **more)


def held_out_metrics(log: DataFrame, window_size: int, test_ratio: float,
                     chosen: DataFrame | None = None) -> DataFrame:
    """Scores of a held-out log, which should be a stored one, with its run columns.

    Mean price and sample count are those of the scored forecasts.  With ``chosen``
    (``best_config_join``), a pair without a score is a row too: ``skipped``, with the ``reason``.
    """
    run = {"window_size": F.lit(window_size), "test_ratio": F.lit(test_ratio)}
    scores = config_scores(log, with_loss=True).withColumns(
        {**run, "skipped": F.lit(False), "reason": F.lit("")})
    if chosen is None:
        return scores
    keys = ["market", "model", "config_index"]
    why = unscored_runs(log).select(*keys, "n_windows", "reason")
    rest = chosen.select(*keys, "hyperparams_json").join(scores.select(*keys), keys, "left_anti") \
        .join(why, keys, "left").withColumns({
            **run, "skipped": F.lit(True), "n_windows": F.coalesce("n_windows", F.lit(0)),
            "reason": F.coalesce("reason", F.lit("no window, or the config is not in the list"))})
    return scores.unionByName(rest, allowMissingColumns=True)


def evaluate_best(labelled: DataFrame, best: DataFrame, configs: Sequence[Config],
                  window_size: int, test_ratio: float, learner: Learner = native_log,
                  max_windows: int | None = None) -> DataFrame:
    """Of ``configs`` run, per (market, model), the chosen one: a row for each, scored or skipped.

    The log is written before it is scored, so that every fit runs once.
    """
    log = stored(held_out_log(labelled, best, configs, window_size, test_ratio, learner,
                              max_windows=max_windows), "held_out_log")
    return held_out_metrics(log, window_size, test_ratio, best_config_join(best))
