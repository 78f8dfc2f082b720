"""Labels, sliding windows, their train/test split and per-window scaling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.clean import complete_rows
from tidemark.operators.indicators import series_window

EPS = 2.220446049250313e-16


def next_price_label(panel: DataFrame, features: Sequence[str], price: str = "Price",
                     keys: Sequence[str] = ("market",)) -> DataFrame:
    """y = the next retained row's price.  Rows with a missing feature go only afterwards, so
    a label may come from a row that is itself dropped."""
    labelled = panel.withColumn("y", F.lead(price).over(series_window(keys)))
    return complete_rows(labelled, features)


def number_rows(labelled: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Adds ``r``, the 0-based row number within the key; rows that have one already keep it."""
    return labelled if "r" in labelled.columns else labelled.withColumn("r", F.row_number().over(series_window(keys)) - 1)


def split_point(window_size: int, test_ratio: float) -> int:
    """Number of train rows of a window; at least one row on either side."""
    if window_size < 2 or not 0.0 < test_ratio < 1.0:
        raise ValueError("need window_size >= 2 and 0 < test_ratio < 1")
    return max(1, min(round(window_size * (1.0 - test_ratio)), window_size - 1))


def sliding_windows(labelled: DataFrame, window_size: int, test_ratio: float,
                    max_windows: int | None = None,
                    keys: Sequence[str] = ("market",)) -> DataFrame:
    """One row per (window, position): window k is rows k..k+W-1; positions before the split
    train.  This copies each row W times; the learners and scalers below use frames instead.
    """
    split = split_point(window_size, test_ratio)
    rows = number_rows(labelled, keys)
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.greatest(F.col("r") - (window_size - 1), F.lit(0))
    last = F.least(F.col("r"), F.col("n") - window_size)
    out = rows.filter(first <= last).withColumn(
        "window_id", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    out = limit_windows(out, max_windows)
    return out.withColumn("pos", (F.col("r") - F.col("window_id")).cast("int")) \
              .withColumn("is_train", F.col("pos") < split).drop("r", "n")


def limit_windows(df: DataFrame, max_windows: int | None) -> DataFrame:
    return df if max_windows is None else df.filter(F.col("window_id") < max_windows)


def short_series(labelled: DataFrame, window_size: int,
                 keys: Sequence[str] = ("market",)) -> DataFrame:
    """Keys with fewer rows than one window needs: nothing can be forecast for them."""
    return labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")) \
                   .filter(F.col("n_rows") < window_size)


def test_rows(labelled: DataFrame, window_size: int, test_ratio: float,
              max_windows: int | None = None, price: str = "Price",
              keys: Sequence[str] = ("market",), extra: dict[str, Column] | None = None
              ) -> DataFrame:
    """One row per window, sitting at its first test row, without copying any row.

    With stride 1 the train rows of a window are the frame of ``split`` rows before its first
    test row, so anything learnt from them is a window function (``extra``).
    ``y_true`` and ``prices`` are the labels and today's prices of the test rows in order.
    """
    split = split_point(window_size, test_ratio)
    n_test = window_size - split
    w = series_window(keys)
    ahead = w.rowsBetween(0, n_test - 1)
    rows = number_rows(labelled, keys).withColumns({
        "window_id": (F.col("r") - split).cast("bigint"),
        "end_date": F.last("d").over(ahead),
        "y_true": F.collect_list("y").over(ahead),
        "prices": F.collect_list(price).over(ahead),
        **(extra or {})})
    full = rows.filter((F.col("window_id") >= 0) & (F.size("y_true") == n_test))
    return limit_windows(full, max_windows).select(
        *keys, "window_id", F.col("d").alias("start_date"), "end_date", "y_true", "prices",
        *(extra or {}))


def train_frame(window_size: int, test_ratio: float, keys: Sequence[str] = ("market",)):
    return series_window(keys).rowsBetween(-split_point(window_size, test_ratio), -1)


def standard_scale_stats(labelled: DataFrame, window_size: int, test_ratio: float,
                         keys: Sequence[str] = ("market",)) -> DataFrame:
    """Mean and population standard deviation of the train labels of each window.

    A spread within rounding error of zero counts as constant and scales by 1.
    """
    f = train_frame(window_size, test_ratio, keys)
    out = test_rows(labelled, window_size, test_ratio, keys=keys, extra={
        "y_mean": F.avg("y").over(f), "var": F.var_pop("y").over(f),
        "n": F.count("y").over(f)})
    bound = F.col("n") * EPS * F.col("var") + F.pow(F.col("n") * F.col("y_mean") * EPS, F.lit(2))
    return out.select(*keys, "window_id", "y_mean",
                      F.when(F.col("var") <= bound, 1.0).otherwise(F.sqrt("var")).alias("y_scale"))


def robust_scale_stats(labelled: DataFrame, features: Sequence[str], window_size: int,
                       test_ratio: float, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Median and interquartile range of the train rows, per window and feature.

    All features are frames of one window, so the rows are neither copied nor shuffled per
    feature; only the results are turned into rows.
    """
    f = train_frame(window_size, test_ratio, keys)
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    wide = test_rows(labelled, window_size, test_ratio, price=features[0], keys=keys, extra={
        f"q_{c}": F.percentile(c, quartiles).over(f) for c in features})
    long = wide.select(*keys, "window_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"q_{c}").alias("q")) for c in features])))
    iqr = F.element_at("q", 3) - F.element_at("q", 1)
    return long.select(*keys, "feature", "window_id", F.element_at("q", 2).alias("median"),
                       F.when(iqr < 10 * EPS, 1.0).otherwise(iqr).alias("iqr"))
