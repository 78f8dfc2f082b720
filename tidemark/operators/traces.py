"""Forecast traces: one forecast per target date, and several models side by side."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.parsing import list_first
from tidemark.functions.values import target_date
from tidemark.operators.clean import dedupe_last


def aligned_trace(log: DataFrame, keys: Sequence[str] = ("market", "model")) -> DataFrame:
    """First forecast of each window at its target date (next weekday after the feature date);
    of several windows with one target date the newest stays.  Where a log holds several configs of
    a pair, the one of the highest index decides between equal windows; put ``config_index`` into
    ``keys`` for a trace of each.  Each window of a config is to be there once (``dedupe_log``)."""
    config = "config_index" in log.columns and "config_index" not in keys
    rows = log.filter(F.col("end_date").isNotNull()).select(
        *keys, newest(F.col("window_id"), F.col("config_index") if config else None).alias("newest"),
        target_date("end_date").alias("target_date"),
        list_first("y_true").alias("y_true"), list_first("y_pred").alias("y_pred"))
    return dedupe_last(rows, [*keys, "target_date"], "newest", ["y_true", "y_pred"])


def newest(window: Column, config: Column | None) -> Column:
    """One number that orders by window, then by config: aggregates hash by it, while a pair would make them sort."""
    if config is None:
        return window
    return window.cast("decimal(20,0)") * F.lit(Decimal(2**32)) + F.coalesce(config, F.lit(-2**31)).cast("decimal(10,0)")


def align_models(trace: DataFrame, models: Sequence[str], how: str = "inner",
                 truth_model: str | None = None) -> DataFrame:
    """Truth and one prediction column per model; ``inner`` keeps the dates all models have.

    One aggregate with a fixed list of models instead of a join per model.
    """
    truth_model = truth_model or models[0]
    wide = trace.groupBy("market", "target_date").agg(
        F.max(F.when(F.col("model") == truth_model, F.col("y_true"))).alias("y_true"),
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models],
        F.count_if(F.col("model").isin(list({*models, truth_model}))).alias("n"))
    if how == "inner":
        wide = wide.filter(F.col("n") == len({*models, truth_model}))
    else:
        wide = wide.filter(F.col("n") > 0)
    return wide.drop("n")
