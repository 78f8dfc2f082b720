"""Grid search: labelled rows to a log, scores and the best config per (market, model)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.forecast import Config, all_runs, native_log, window_counts
from tidemark.operators.metrics import config_scores, dedupe_log
from tidemark.operators.ranking import best_by_market_model
from tidemark.sources.logs import missing_windows, resume_anti

# (labelled, configs, window_size, test_ratio, todo=runs or None) -> log
Learner = Callable[..., DataFrame]


def tuning_scores(log: DataFrame, window_size: int, test_ratio: float) -> DataFrame:
    """Scores with the run columns, in one pass over a log that has each window once."""
    return config_scores(log, with_loss=True).withColumns({
        "window_size": F.lit(window_size), "test_ratio": F.lit(test_ratio)})


def grid_log(labelled: DataFrame, configs: Sequence[Config], window_size: int, test_ratio: float,
             done: DataFrame | None = None, learner: Learner = native_log,
             max_configs: int | None = None, max_windows: int | None = None, by_window: bool = False) -> DataFrame:
    """Walk-forward log of the grid.

    Runs that ``done`` (an earlier log, each window once) holds in full and without failures are
    left out.  Of the others all windows are run again, or ``by_window`` only those that are missing or failed;
    then both logs together are whole.  The limits keep the first configs of each model and the first windows of
    each market.
    """
    if max_configs is not None:
        configs = [c for c in configs if c.config_index < max_configs]
    more = {} if max_windows is None else {"max_windows": max_windows}
    todo = None
    if done is not None:
        left = missing_windows if by_window else resume_anti
        todo = left(all_runs(labelled, configs), done, expected=window_counts(labelled, window_size, max_windows))
    return learner(labelled, configs, window_size, test_ratio, todo=todo, **more)


def tune(labelled: DataFrame, configs: Sequence[Config], window_size: int, test_ratio: float,
         done: DataFrame | None = None, learner: Learner = native_log,
         max_configs: int | None = None, max_windows: int | None = None) -> DataFrame:
    """Best config per (market, model) of what is still to run."""
    log = grid_log(labelled, configs, window_size, test_ratio, done, learner, max_configs, max_windows)
    return best_by_market_model(config_scores(log))


def rescore(log: DataFrame, seq: str = "run_seq") -> DataFrame:
    """Best config per (market, model) from stored logs, which re-runs may have written to twice."""
    return best_by_market_model(config_scores(dedupe_log(log, seq)))
