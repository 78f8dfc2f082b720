"""Long series cut into parts, so that a few of them use every core.

The operators of the other modules give a whole series to one task.  Here no task holds more than a
part of one, and what crosses the parts is small:

* ``fill_calendar_parts``: buckets of days; the last known value before each bucket and the first one after it
  come from one row per bucket.
* ``bounded``: parts of rows with a halo, the rows that frames reach beyond their part, are copied to
  their neighbours; any operator whose frames are bounded then works per part.
* ``robust_scale_sliding``: quartiles of wide frames from a sorted buffer, per part with its halo.
* ``ewm_parts``, ``technicals_parts``: sums per part, one fold of what earlier parts carry over, one write-back.

Tables of one row per part are made by key and then dealt by part, or a join with them would bring the
rows of a key together to match.

Results equal those of the plain operators for any length of the parts (those of ``ewm`` but for
rounding).  Where a series is needed twice it is written in between.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from datetime import date as Date

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import is_business_day
from tidemark.operators.calendar import business_days, check_bounds
from tidemark.operators.indicators import (
    atr, averages, block_rows, block_sum, decayed, direction, price_delta, roc, rsi, series_window, sma, span_alpha)
from tidemark.operators.windows import (
    EPS, next_price_label, robust_scale_stats, sliding_windows, split_point, standard_scale_stats, test_rows)
from tidemark.session import stored

# Functions on the rows of a part travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bucket_of(date: Column | str, days: int) -> Column:
    """The number of the bucket of ``days`` calendar days that a date lies in."""
    return F.floor(F.unix_date(date) / days).cast("int")


def bucket_edges(known: DataFrame, lo: int, hi: int, keys: Sequence[str]) -> DataFrame:
    """Each bucket ``lo``..``hi`` of each key with the known values next to it.

    ``known`` has ``bucket`` and ``at`` (a struct of date and value).  ``prev`` is the last one before the bucket,
    ``first`` the first one in it (NULL if there is none) and ``next`` the first one after it.  A bucket is one
    row before anything is sorted by key, and a bucket without values is made by the one before.
    """
    own = known.groupBy(*keys, "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    own = own.select("*", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"),
                     F.lead("bucket").over(w).alias("next_bucket"))
    since = F.when(F.col("before").isNull(), F.lit(lo)).otherwise(F.col("bucket"))
    until = F.coalesce(F.col("next_bucket") - 1, F.lit(hi))
    rows = own.withColumn("b", F.explode(F.sequence(since, until)))
    ahead, here = F.col("b") < F.col("bucket"), F.col("b") == F.col("bucket")
    return rows.select(
        *keys, F.col("b").alias("bucket"),
        F.when(here, F.col("before")).when(~ahead, F.col("last")).alias("prev"),
        F.when(here, F.col("first")).alias("first"),
        F.when(ahead, F.col("first")).otherwise(F.col("after")).alias("next")).repartition(*keys, "bucket")


def fill_calendar_parts(series: DataFrame, start: str, end: str, days: int, keys: Sequence[str] = ("market",),
                        value: str = "price", interior: bool = True, leading: bool = True,
                        trailing: bool = True) -> DataFrame:
    """``fill_calendar`` by buckets of ``days`` days: the same rows, but no task holds a whole key.

    A known row makes the days up to the next known one or the end of its bucket; the days before the first
    known one of a bucket, or all of one that has none, are made by its edges.
    """
    lo, hi = check_bounds(start, end)
    first_bucket, last_bucket = ((Date.fromisoformat(x) - Date(1970, 1, 1)).days // days for x in (start, end))
    inside = F.col("d").between(lo, hi) & is_business_day("d")
    at = F.struct(F.col("d").alias("d"), F.col(value).alias("v")).alias("at")
    known = stored(series.filter(inside & F.col(value).isNotNull()).select(
        *keys, bucket_of("d", days).alias("bucket"), at), "known")
    edges = bucket_edges(known, first_bucket, last_bucket, keys)
    w = Window.partitionBy(*keys, "bucket").orderBy("at.d")
    begin = F.greatest(lo, F.date_from_unix_date(F.col("bucket") * days))
    finish = F.least(hi, F.date_from_unix_date((F.col("bucket") + 1) * days - 1))
    rows = known.withColumn("then", F.lead("at").over(w)) \
        .join(edges.select(*keys, "bucket", "next"), [*keys, "bucket"]) \
        .select(*keys, F.col("at").alias("left"), F.coalesce("then", "next").alias("right"), F.col("at.d").alias("since"),
                F.coalesce(F.date_sub("then.d", 1), finish).alias("until"))
    opening = edges.select(
        *keys, F.col("prev").alias("left"), F.coalesce("first", "next").alias("right"), begin.alias("since"),
        F.coalesce(F.date_sub("first.d", 1), finish).alias("until"))
    days_of = rows.unionByName(opening).withColumn(
        "d", F.explode(F.when(F.col("since") <= F.col("until"), business_days("since", "until"))))
    after = F.datediff("d", "left.d")
    left, right = F.col("left.v"), F.col("right.v")
    line = left + (right - left) * after / F.datediff("right.d", "left.d")
    filled = (F.when(after == 0, left)
              .when(F.col("left").isNull(), right if leading else None)
              .when(F.col("right").isNull(), left if trailing else None)
              .otherwise(line if interior else None))
    return days_of.select(*keys, "d", filled.alias(value), F.coalesce(after != 0, F.lit(True)).alias("is_filled"))


def numbered(df: DataFrame, days: int, keys: Sequence[str] = ("market",), date: str = "d") -> DataFrame:
    """Adds ``r``, the 0-based number of a row in its key, and ``n``, the rows of the key.

    Rows are numbered within buckets of days and moved up by the rows of earlier buckets.  ``df`` is read
    twice, so give a written one if it is dear.
    """
    df = df.withColumn("_bucket", bucket_of(date, days))
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(every).alias("n")).repartition(*keys, "_bucket")
    here = Window.partitionBy(*keys, "_bucket").orderBy(date)
    return df.withColumn("_place", F.row_number().over(here)).join(counts, [*keys, "_bucket"]) \
        .withColumn("r", F.col("_before") + F.col("_place") - 1).drop("_bucket", "_place", "_before")


def halo(rows: DataFrame, length: int, before: int, after: int) -> DataFrame:
    """Each row with every ``part`` of ``length`` rows in which a frame of ``before`` rows back and ``after`` ahead meets it."""
    first = F.greatest(F.floor((F.col("r") - after) / length), F.lit(0))
    last = F.floor(F.least(F.col("r") + before, F.col("n") - 1) / length)
    return rows.withColumn("part", F.explode(F.sequence(first, last)))


def bounded(df: DataFrame, work: Callable[[DataFrame, list[str]], DataFrame], length: int, before: int, after: int,
            days: int, place: Column | None = None, keys: Sequence[str] = ("market",), date: str = "d") -> DataFrame:
    """An operator with frames of ``before`` rows back and ``after`` rows ahead, per part of ``length`` rows.

    ``work`` gets the rows of all parts and the keys that tell parts apart.  ``place`` says which row number a result
    belongs to, ``r`` by default; results that a halo gave are left out, as they belong to another part.
    """
    if length < 1 or before < 0 or after < 0:
        raise ValueError("parts need a row at least, and frames cannot end before they start")
    rows = halo(numbered(df, days, keys, date), length, before, after)
    place = F.col("r") if place is None else place
    out = work(rows, [*keys, "part"])
    return out.filter(F.floor(place / length) == F.col("part")).drop("part", "r", "n")


def next_price_label_parts(panel: DataFrame, features: Sequence[str], length: int, days: int, price: str = "Price",
                           keys: Sequence[str] = ("market",)) -> DataFrame:
    return bounded(panel, lambda rows, by: next_price_label(rows, features, price, by), length, 0, 1, days, keys=keys)


def _reach(window_size: int, test_ratio: float) -> tuple[int, int, Column]:
    """Rows before and after the first test row of a window, and the number of that row."""
    split = split_point(window_size, test_ratio)
    return split, window_size - split - 1, F.col("window_id") + split


def test_rows_parts(labelled: DataFrame, window_size: int, test_ratio: float, length: int, days: int,
                    price: str = "Price", keys: Sequence[str] = ("market",)) -> DataFrame:
    before, after, place = _reach(window_size, test_ratio)
    return bounded(labelled, lambda rows, by: test_rows(rows, window_size, test_ratio, price=price, keys=by),
                   length, before, after, days, place, keys)


def standard_scale_parts(labelled: DataFrame, window_size: int, test_ratio: float, length: int, days: int,
                         keys: Sequence[str] = ("market",)) -> DataFrame:
    before, after, place = _reach(window_size, test_ratio)
    return bounded(labelled, lambda rows, by: standard_scale_stats(rows, window_size, test_ratio, by),
                   length, before, after, days, place, keys)


def robust_scale_parts(labelled: DataFrame, features: Sequence[str], window_size: int, test_ratio: float, length: int,
                       days: int, keys: Sequence[str] = ("market",)) -> DataFrame:
    before, after, place = _reach(window_size, test_ratio)
    return bounded(labelled, lambda rows, by: robust_scale_stats(rows, features, window_size, test_ratio, by),
                   length, before, after, days, place, keys)


def sliding_windows_parts(labelled: DataFrame, window_size: int, test_ratio: float, days: int,
                          max_windows: int | None = None, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Once rows are numbered, each one alone tells the windows it lies in: no frame and no halo."""
    return sliding_windows(numbered(labelled, days, keys), window_size, test_ratio, max_windows, keys)


# ---- recurrences across parts ------------------------------------------------------------

def ewm_parts(rows: DataFrame, specs: dict[str, tuple[str, float]], length: int,
              keys: Sequence[str] = ("market",), date: str = "d") -> DataFrame:
    """``ewm`` of rows that have ``r``, their number in the series, by parts of ``length`` rows.

    Each part is summed up by itself and written with its rows.  One row per part goes to the fold of what the
    earlier parts carry over, itself a decayed sum, which comes back by part.
    """
    fading = {n: (x, 1.0 - a) for n, (x, a) in specs.items() if a < 1.0}
    longest = min([block_rows(q) for _, q in fading.values()], default=length)
    if not 0 < length <= longest:
        raise ValueError(f"parts of {length} rows, 1..{longest} allowed for these weights")
    by = ", ".join(f"`{k}`" for k in keys)
    own = f"PARTITION BY {by}, _part ORDER BY `{date}`"
    parted = rows.selectExpr("*", f"r div {length} AS _part", f"CAST(r % {length} AS double) AS _place")
    sums = stored(parted.selectExpr("*", *(f"{block_sum(f'`{x}`', q, own, '_place')} AS `_sum_{n}`"
                                           for n, (x, q) in fading.items())), "sums")
    values = list(dict.fromkeys(x for x, _ in specs.values()))
    ends = sums.groupBy(*keys, "_part").agg(
        *[F.max_by(f"_sum_{n}", "r").alias(f"_end_{n}") for n in fading],
        *[F.min(F.when(F.col(x).isNotNull(), F.struct(F.col("r").alias("r"), F.col(x).alias("x")))).alias(f"_first_{x}")
          for x in values])
    ends = decayed(ends, {f"_until_{n}": (f"_end_{n}", q ** length) for n, (_, q) in fading.items()}, keys, "_part", "_part")
    carries = ends.selectExpr(
        *(f"`{k}`" for k in keys), "_part",
        *(f"lag(`_until_{n}`, 1, 0D) OVER (PARTITION BY {by} ORDER BY _part) AS `_carry_{n}`" for n in fading),
        *(f"min(`_first_{x}`) OVER (PARTITION BY {by}) AS `_first_{x}`" for x in values)).repartition(*keys, "_part")
    wide = sums.join(carries, [*keys, "_part"]).selectExpr("*", *(
        f"`_sum_{n}` + `_carry_{n}` * pow({q!r}D, _place + 1) AS `_{n}`" for n, (_, q) in fading.items()),
        *(f"coalesce(`{x}`, 0D) AS `_{n}`" for n, (x, a) in specs.items() if a >= 1.0))
    return wide.selectExpr(*(f"`{c}`" for c in rows.columns), *averages(specs, "r"))


def running_sum_parts(rows: DataFrame, name: str, value: str, length: int, keys: Sequence[str] = ("market",),
                      date: str = "d") -> DataFrame:
    """Adds the running sum of a column of rows that have ``r``: sums per part, moved up by the earlier parts."""
    rows = rows.withColumn("_part", F.floor(F.col("r") / length))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).select(
        *keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")) \
        .repartition(*keys, "_part")
    here = Window.partitionBy(*keys, "_part").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_here", F.sum(value).over(here)).join(offsets, [*keys, "_part"]) \
        .withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")


def technicals_parts(df: DataFrame, length: int, days: int, keys: Sequence[str] = ("market",), date: str = "d",
                     price: str = "price") -> DataFrame:
    """``technicals`` by parts of ``length`` rows."""
    def frames(rows: DataFrame, by: list[str]) -> DataFrame:
        w = series_window(by, date)
        return price_delta(rows, w, price).withColumns({
            "SMA_5": sma(price, 5, w), "ROC_10": roc(price, 10, w), "ATR_14": atr("delta", 14, w),
            "_up": direction("delta").cast("long")})
    parted = halo(numbered(df, days, keys, date), length, 14, 0)
    rows = stored(frames(parted, [*keys, "part"]).filter(F.floor(F.col("r") / length) == F.col("part")).drop("part"), "frames")
    rows = running_sum_parts(rows, "adl", "_up", length, keys, date).withColumn("adl", F.col("adl").cast("double"))
    wide = ewm_parts(rows, {
        "ema_12": (price, span_alpha(12)), "ema_26": (price, span_alpha(26)),
        "avg_gain": ("gain", 1.0 / 14), "avg_loss": ("loss", 1.0 / 14),
        "adl_3": ("adl", span_alpha(3)), "adl_10": ("adl", span_alpha(10))}, length, keys, date)
    return wide.select(
        *df.columns, "SMA_5", (F.try_divide(F.col("ema_12") - F.col("ema_26"), F.col("ema_26")) * 100).alias("PPO_12_26"),
        rsi("avg_gain", "avg_loss").alias("RSI_14"), "ROC_10", "ATR_14",
        (F.col("adl_3") - F.col("adl_10")).alias("CO_chaikin_3_10"))


# ---- order statistics of sliding frames --------------------------------------------------

def sliding_quartiles(values: np.ndarray, rows: int) -> np.ndarray:
    """The quartiles (25, 50, 75) of the ``rows`` values before each place, NaN where one is missing from all of them.

    The values of a frame are kept sorted: per step one goes out and one comes in at a place found by bisection, so
    the cost hardly depends on the length of the frame.  Missing values (NaN) are in no frame.
    """
    out = np.full((len(values), 3), np.nan)
    held: list[float] = []
    data = values.tolist()
    for i, x in enumerate(data):
        n = len(held)
        if n:
            for k, p in enumerate((0.25, 0.5, 0.75)):
                at = (n - 1) * p
                low = int(at)
                out[i, k] = held[low] if at == low else (low + 1 - at) * held[low] + (at - low) * held[low + 1]
        if i >= rows and data[i - rows] == data[i - rows]:
            del held[bisect_left(held, data[i - rows])]
        if x == x:
            insort(held, x)
    return out


def robust_scale_sliding(labelled: DataFrame, features: Sequence[str], window_size: int, test_ratio: float, length: int,
                         days: int, keys: Sequence[str] = ("market",)) -> DataFrame:
    """``robust_scale_stats`` for wide windows: a sorted buffer per feature and part instead of a percentile per frame.

    A part of ``length`` rows comes with the rows that its frames reach back to; make it several times as long as
    a window.  All features of a part are worked through by one call.
    """
    split, after, _ = _reach(window_size, test_ratio)
    features, keys = list(features), list(keys)
    rows = numbered(labelled.select(*keys, "d", *features), days, keys)
    parted = halo(rows, length, split, 0).withColumn("windows", F.col("n") - (window_size - 1)).drop("n", "d")
    types = dict(labelled.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "feature string", "window_id bigint", "median double", "iqr double"])

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        r = pdf["r"].to_numpy()
        window = r - split
        mine = (r // length == key[-1]) & (window >= 0) & (window < pdf["windows"].to_numpy())
        out = []
        for feature in features:
            q = sliding_quartiles(pdf[feature].to_numpy(float), split)[mine]
            iqr = q[:, 2] - q[:, 0]
            out.append(pd.DataFrame({"feature": feature, "window_id": window[mine], "median": q[:, 1],
                                     "iqr": np.where(iqr < 10 * EPS, 1.0, iqr)}))
        result = pd.concat(out)
        for place, k in enumerate(keys):
            result.insert(place, k, key[place])
        return result
    return parted.groupBy(*keys, "part").applyInPandas(work, schema) \
        .withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("median", "iqr")})
