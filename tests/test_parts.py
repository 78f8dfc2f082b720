"""Series cut into parts against the plain operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, plan, prices, series
from tidemark.operators import calendar, indicators, parts, windows
from tidemark.session import stored

START, END = "2021-03-01", "2024-06-28"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sparse(spark):
    """Series with long gaps, one known value, values on the edges and outside the calendar."""
    rng = random.Random(7)
    days = [str(d)[:10] for d in np.arange("2021-02-01", "2024-08-01", dtype="datetime64[D]")]
    data = [("dense", d, rng.uniform(1, 9)) for d in days if rng.random() < 0.6]
    data += [("gaps", d, rng.uniform(1, 9)) for d in days if rng.random() < 0.004]
    data += [("one", "2022-07-06", 5.0), ("late", "2024-06-28", 2.0), ("late", "2024-06-27", None), ("out", "2020-01-01", 1.0)]
    return stored(series(spark, data), "sparse")


@pytest.mark.parametrize("days", [1, 3, 30, 365, 10_000])
def test_fill_equals_the_plain_one(sparse, days):
    for options in ({}, {"leading": False}, {"trailing": False, "interior": False}):
        want = rows(calendar.fill_calendar(sparse, START, END, **options))
        assert rows(parts.fill_calendar_parts(sparse, START, END, days, **options)) == want


def test_no_task_holds_a_whole_series(spark, sparse):
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = parts.fill_calendar_parts(sparse, START, END, 30).filter("market = 'dense'")
        shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert max(shares) < 0.6 * sum(shares)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    data = [(m, day(str(d)[:10]), float(p), None if k % 97 == 5 else float(p) ** 2) for m, n in (("a", 900), ("b", 333), ("c", 4))
            for k, (d, p) in enumerate(zip(np.arange("2020-01-01", "2024-12-31", dtype="datetime64[D]")[:n], 50 + rng.normal(0, 1, n).cumsum()))]
    return stored(spark.createDataFrame(data, "market string, d date, Price double, f double"), "panel")


LENGTHS = [1, 7, 64, 5000]


@pytest.mark.parametrize("length", LENGTHS)
def test_labels(panel, length):
    want = windows.next_price_label(panel, ["Price", "f"])
    got = parts.next_price_label_parts(panel, ["Price", "f"], length, 50)
    assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("length", LENGTHS)
@pytest.mark.parametrize("size, ratio", [(10, 0.1), (12, 0.4)])
def test_windows(panel, length, size, ratio):
    lab = stored(windows.next_price_label(panel, ["Price", "f"]), "lab")
    assert rows(parts.test_rows_parts(lab, size, ratio, length, 40)) == rows(windows.test_rows(lab, size, ratio))
    assert rows(parts.standard_scale_parts(lab, size, ratio, length, 40)) == rows(windows.standard_scale_stats(lab, size, ratio))


def test_robust_scales_and_copies(panel):
    lab = stored(windows.next_price_label(panel, ["Price", "f"]), "lab")
    assert rows(parts.robust_scale_parts(lab, ["Price", "f"], 10, 0.1, 50, 40)) == rows(windows.robust_scale_stats(lab, ["Price", "f"], 10, 0.1))
    got, want = parts.sliding_windows_parts(lab, 10, 0.1, 40), windows.sliding_windows(lab, 10, 0.1)
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("length", [1, 13, 250, 600])
def test_indicators(panel, length):
    df = panel.select("market", "d", F.col("Price").alias("price"))
    want = indicators.technicals(df).orderBy("market", "d").collect()
    got = parts.technicals_parts(df, length, 60).orderBy("market", "d").collect()
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2]
        for x, y in zip(a[2:], b[2:]):
            assert x is y is None or x == pytest.approx(y, rel=1e-11, abs=1e-11)


@pytest.mark.parametrize("alpha", [1.0, 0.999, 0.5, 1 / 14, 0.01])
def test_averages_over_many_blocks(spark, alpha):
    """Long series, leading and inner gaps, values of very different size, both ways of cutting."""
    rng = random.Random(2)
    xs = [None, None] + [rng.uniform(1, 9) * 10.0 ** rng.randrange(-8, 8) for _ in range(9000)]
    xs[40] = xs[700] = None
    e, want = None, []
    for x in xs:
        e = x if e is None else e * (1 - alpha) + (x or 0.0) * alpha
        want.append(None if x is None else e)
    df = prices(spark, [0] * len(xs), start="1990-01-01").drop("price").withColumn(
        "r", F.datediff("d", F.lit("1990-01-01").cast("date")).cast("long"))
    values = spark.createDataFrame(list(enumerate(xs)), "r long, price double")
    df = stored(df.join(values, "r"), "values")
    plain = column(indicators.ewm(df, {"e": ("price", alpha)}, indicators.series_window()), "e")
    length = min(128, indicators.block_rows(1 - alpha)) if alpha < 1 else 128
    cut = column(parts.ewm_parts(df, {"e": ("price", alpha)}, length), "e")
    for got in (plain, cut):
        assert [x is None for x in got] == [x is None for x in want]
        assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], rel=1e-12)


def test_parts_too_long_for_the_weights_are_refused(spark):
    df = prices(spark, [1, 2, 3]).withColumn("r", F.lit(0).cast("long"))
    with pytest.raises(ValueError):
        parts.ewm_parts(df, {"e": ("price", 0.5)}, 100_000)
    with pytest.raises(ValueError):
        parts.bounded(df, lambda rows, by: rows, 0, 1, 0, 30)


def test_frames_are_dealt_by_part(panel):
    text = plan(parts.standard_scale_parts(panel.withColumn("y", F.col("Price")), 10, 0.1, 64, 40))
    lines = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert any("part" in line for line in lines)
    assert not any("Window" in line and "collect_list" in line and "part" not in line for line in text.splitlines())


def test_four_windows_for_all_indicators(panel):
    df = indicators.technicals(panel.select("market", "d", F.col("Price").alias("price")))
    assert plan(df).count("Window [") <= 4


# ---- sliding order statistics --------------------------------------------------------------

@pytest.mark.parametrize("rows", [1, 2, 9, 225])
def test_quartiles_by_definition(rows):
    rng = random.Random(rows)
    xs = np.array([rng.choice([rng.uniform(-5, 5), float(rng.randrange(4)), float("nan")]) for _ in range(600)])
    got = parts.sliding_quartiles(xs, rows)
    for i in range(len(xs)):
        frame = xs[max(0, i - rows):i]
        frame = frame[~np.isnan(frame)]
        if len(frame):
            assert got[i] == pytest.approx(np.percentile(frame, [25, 50, 75]), rel=1e-12, abs=1e-12)
        else:
            assert np.isnan(got[i]).all()


@pytest.mark.parametrize("size, length", [(10, 7), (10, 400), (60, 100), (250, 300)])
def test_scales_of_wide_windows(panel, size, length):
    lab = stored(windows.next_price_label(panel, ["Price", "f"]), "lab")
    want = windows.robust_scale_stats(lab, ["Price", "f"], size, 0.1)
    got = parts.robust_scale_sliding(lab, ["Price", "f"], size, 0.1, length, 40)
    assert got.columns == want.columns and got.count() == want.count()
    key = lambda df: sorted((r.market, r.feature, r.window_id, r.median, r.iqr) for r in df.collect())
    for a, b in zip(key(got), key(want)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12)


def test_wide_windows_cost_little_more():
    """250 rows against 10: less than three times the time, of the best of some runs."""
    import time
    xs = np.random.default_rng(1).normal(size=30_000)

    def seconds(rows):
        best = []
        for _ in range(5):
            start = time.perf_counter()
            parts.sliding_quartiles(xs, rows)
            best.append(time.perf_counter() - start)
        return min(best)
    assert seconds(225) < 3 * seconds(9)


def test_missing_values_and_short_series(spark):
    df = spark.createDataFrame([("a", day(f"2024-01-{k + 1:02}"), None if k % 3 else float(k)) for k in range(20)]
                               + [("b", day("2024-01-01"), 1.0)], "market string, d date, f double").withColumn("y", F.lit(1.0))
    got = parts.robust_scale_sliding(df, ["f"], 10, 0.1, 50, 30).orderBy("window_id").collect()
    assert [r.window_id for r in got] == list(range(11)) and got[0].median == 3.0
    none = parts.robust_scale_sliding(df.withColumn("f", F.lit(None).cast("double")), ["f"], 10, 0.1, 50, 30).collect()
    assert {(r.median, r.iqr) for r in none} == {(None, None)}
