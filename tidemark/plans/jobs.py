"""Whole runs that read and write stored tables.

Each stage ends in a written table and the next one starts from it, so a run can be resumed and a
lost executor never costs more than a stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.calendar import coverage_stats
from tidemark.operators.clean import clean_prices, drop_baseline
from tidemark.operators.forecast import Config, native_log
from tidemark.operators.metrics import (
    clipped_error_counts, config_scores, dedupe_log, failed_fits, gold_metrics, uneven_cells, unscored_runs)
from tidemark.operators.ranking import best_by_market_model, best_by_model, rank_in_market, ranking_order
from tidemark.operators.reports import (
    attach_hp, axis_bounds, cfg_market, cfg_overall, configs_across_markets, error_histogram, hp_sensitivity,
    metric_pivot, model_summary, rank_curve_by_market, rank_curve_pooled, ranked_configs)
from tidemark.operators.traces import align_models, aligned_trace
from tidemark.operators.windows import next_price_label
from tidemark.plans.evaluate import best_config_join, held_out_log, held_out_metrics
from tidemark.plans.panel import build_panel, unused_tickers
from tidemark.plans.tune import Learner, grid_log, tuning_scores
from tidemark.schema import (
    BASELINE, CALENDAR_END, CALENDAR_START, NETS, OUTPUT_START, PANEL_FEATURES, SCORE_COLUMNS)
from tidemark.session import stored
from tidemark.sources.logs import append_log, bad_log_files, read_log_table, read_logs
from tidemark.sources.market_files import missing_inputs, passed_over_files, quotes_series, read_labelled_csv
from tidemark.sources.panels import read_panel, write_panel
from tidemark.sources.results import (
    FRONT_TEST, read_best_configs, read_scores, write_best_configs, write_metrics)


def market_table(spark: SparkSession, markets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Market, equity ticker and FX ticker of each market."""
    return spark.createDataFrame(list(markets),
                                 "market string, equity_ticker string, fx_ticker string")


def panel_job(series: DataFrame, quotes: DataFrame, out: str, config: DataFrame,
              commodities: dict[str, str], start: str = CALENDAR_START,
              end: str = CALENDAR_END, output_start: str = OUTPUT_START) -> DataFrame:
    """Write the panel of every market; returns the coverage of the output range."""
    write_panel(build_panel(series, config, quotes, commodities, start, end, output_start), out)
    return coverage_stats(series, output_start, end)


def raw_panel_job(spark: SparkSession, files: str, raw_quotes: DataFrame, out: str, config: DataFrame,
                  commodities: dict[str, str], start: str = CALENDAR_START, end: str = CALENDAR_END,
                  output_start: str = OUTPUT_START) -> None:
    """Raw market files and landed quotes to the panel, its coverage and the report of what is missing.

    Markets without a file and tickers without quotes do not stop the others; they are rows of
    ``missing_inputs``.
    """
    series = stored(clean_prices(read_labelled_csv(spark, files, market="market").withColumn("seq", F.lit(0)),
                                 start, end), "series")
    quotes = stored(quotes_series(raw_quotes), "quotes")
    stats = panel_job(series, quotes, f"{out}/panel", config, commodities, start, end, output_start)
    write_metrics(stats, f"{out}/coverage", stats.columns)
    absent = missing_inputs(config.select("market"), series, ["market"]).select(
        F.lit("no price file").alias("what"), "market", F.lit(None).cast("string").alias("ticker"))
    idle = unused_tickers(config, quotes).select(F.lit("no quotes").alias("what"), "market", "ticker")
    wanted = spark.createDataFrame([(t,) for t in commodities.values()], "ticker string")
    raw = missing_inputs(wanted, quotes, ["ticker"]).select(
        F.lit("no quotes").alias("what"), F.lit(None).cast("string").alias("market"), "ticker")
    report = absent.unionByName(idle).unionByName(raw)
    write_metrics(report, f"{out}/missing_inputs", report.columns)
    over = passed_over_files(spark, files)
    write_metrics(over, f"{out}/passed_over_files", over.columns)


def labelled_panel(spark: SparkSession, panel: str, start: str | None, end: str | None,
                   features: Sequence[str] = PANEL_FEATURES) -> DataFrame:
    return next_price_label(read_panel(spark, panel, start, end), features)


def _stored_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_log_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def tune_job(spark: SparkSession, panel: str, log: str, out: str, configs: Sequence[Config],
             window_size: int, test_ratio: float, start: str | None = None,
             end: str | None = None, learner: Learner = native_log,
             features: Sequence[str] = PANEL_FEATURES, max_configs: int | None = None,
             max_windows: int | None = None, by_window: bool = False) -> None:
    """Append the runs that are missing, failed or cut short to the log, ``by_window`` only their missing and
    failed windows; then score the whole log and write metrics, best configs and the runs that have no score."""
    done = _stored_log(spark, log)
    labelled = labelled_panel(spark, panel, start, end, features)
    append_log(grid_log(labelled, configs, window_size, test_ratio, done and dedupe_log(done), learner,
                        max_configs, max_windows, by_window), log)
    runs = dedupe_log(read_log_table(spark, log))
    scores = tuning_scores(runs, window_size, test_ratio)
    write_metrics(attach_hp(scores), f"{out}/hparam_metrics")
    left = unscored_runs(runs)
    write_metrics(left, f"{out}/unscored_runs", left.columns)
    write_best_configs(best_by_market_model(scores), f"{out}/best_configs")


def evaluate_job(spark: SparkSession, panel: str, best: str, out: str, configs: Sequence[Config],
                 window_size: int, test_ratio: float, start: str | None = None,
                 end: str | None = None, learner: Learner = native_log,
                 features: Sequence[str] = PANEL_FEATURES, max_windows: int | None = None) -> None:
    """Run the stored best configs on a later slice; write their log, which is what a later call
    resumes and the trace reports read, and then their metrics."""
    chosen = read_best_configs(spark, best).drop("hyperparams")
    labelled = labelled_panel(spark, panel, start, end, features)
    log = f"{out}/test_log"
    done = _stored_log(spark, log)
    append_log(held_out_log(labelled, chosen, configs, window_size, test_ratio, learner,
                            done and dedupe_log(done), max_windows), log)
    scores = held_out_metrics(dedupe_log(read_log_table(spark, log)), window_size, test_ratio,
                              best_config_join(chosen))
    write_metrics(attach_hp(scores), f"{out}/test_metrics", FRONT_TEST)


def score_job(spark: SparkSession, logs: str, out: str) -> None:
    """Score log files and write config scores, both best tables, the best configs, and what was
    passed over: files, runs without a score, and windows whose lists differ in length."""
    log = stored(dedupe_log(read_logs(spark, logs)), "log")
    write_metrics(ranking_order(config_scores(log)), f"{out}/config_scores", SCORE_COLUMNS)
    for name, table in {"bad_log_files": bad_log_files(spark, logs), "unscored_runs": unscored_runs(log),
                        "uneven_cells": uneven_cells(log)}.items():
        write_metrics(table, f"{out}/{name}", table.columns)
    scores = read_scores(spark, f"{out}/config_scores")
    best = best_by_market_model(scores)
    write_metrics(best, f"{out}/best_by_market_model", scores.columns)
    write_metrics(best_by_model(configs_across_markets(scores)), f"{out}/best_by_model_across_markets")
    write_best_configs(best, f"{out}/best_configs")


def report_job(scores: DataFrame, out: str) -> None:
    """The tables behind the configuration reports, from a stored score table."""
    per_market = cfg_market(drop_baseline(scores))
    overall = attach_hp(cfg_overall(per_market))
    for name, table in {"configs_ranked_all": ranked_configs(overall),
                        "hist_config_mape": error_histogram(overall),
                        "hp_sensitivity": hp_sensitivity(overall),
                        "rank_curve": rank_curve_pooled(per_market),
                        "rank_in_market": rank_in_market(scores),
                        "model_summary": model_summary(scores)}.items():
        write_metrics(table, f"{out}/{name}", table.columns)
    curve = stored(rank_curve_by_market(per_market), "curve")
    for name, table in {"rank_curve_by_market": curve, "rank_curve_axis": axis_bounds(curve),
                        "mape_by_market": metric_pivot(scores, "MAPE", [*NETS, BASELINE])}.items():
        write_metrics(table, f"{out}/{name}", table.columns)


def trace_job(spark: SparkSession, log: str, out: str, models: Sequence[str]) -> None:
    """The tables behind the trace reports, from a stored held-out log: one trace per pair, models
    side by side, metrics over pieces of the trace, clipped errors and the fits that failed."""
    runs = stored(dedupe_log(read_log_table(spark, log)), "log")
    trace = stored(aligned_trace(runs), "trace")
    for name, table in {"aligned_trace": trace,
                        "aligned_models": align_models(trace, list(models), truth_model=BASELINE),
                        "gold_metrics": gold_metrics(trace), "clipped_errors": clipped_error_counts(trace),
                        "failed_fits": failed_fits(runs)}.items():
        write_metrics(table, f"{out}/{name}", table.columns)
