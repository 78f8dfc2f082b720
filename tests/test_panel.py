import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, clean, indicators
from tidemark.plans import panel as panels
from tests.helpers import column, day, plan, prices, series


def test_time_weighted_gap(spark):
    df = series(spark, [("m", "2024-01-05", 12), ("m", "2024-01-09", 16)])
    out = calendar.fill_calendar(df, "2024-01-05", "2024-01-09")
    assert column(out, "price") == [12.0, 15.0, 16.0]
    assert column(out, "is_filled") == [False, True, False]


def test_edges(spark):
    df = series(spark, [("m", "2024-01-03", 10), ("m", "2024-01-09", 20)])
    fill = lambda **k: column(calendar.fill_calendar(df, "2024-01-01", "2024-01-11", **k), "price")
    mid = [10.0, 10 + 10 / 6, 10 + 20 / 6, 10 + 50 / 6, 20.0]
    assert fill() == pytest.approx([10.0, 10.0, *mid, 20.0, 20.0])
    assert fill(leading=False, trailing=False)[:2] == [None, None]
    assert fill(leading=False)[-2:] == [20.0, 20.0]
    assert fill(interior=False)[3] is None


def test_days_outside_the_calendar_take_no_part(spark):
    df = series(spark, [("m", "2023-12-29", 1), ("m", "2024-01-02", 10), ("m", "2024-01-06", 99),
                        ("m", "2024-01-08", 16), ("m", "2024-01-10", 50)])
    out = calendar.fill_calendar(df, "2024-01-01", "2024-01-09")
    assert column(out, "price") == [10.0, 10.0, 11.0, 12.0, 13.0, 16.0, 16.0]


def test_fill_matches_pandas(spark):
    rng = random.Random(5)
    rows, want = [], {}
    days = pd.date_range("2023-01-02", "2024-06-28", freq="B")
    for m in "abc":
        known = {d: rng.uniform(5, 90) for d in days if rng.random() < 0.3}
        rows += [(m, d.date().isoformat(), p) for d, p in known.items()]
        want[m] = pd.Series(known).reindex(days).interpolate(method="time").ffill().bfill().tolist()
    out = calendar.fill_calendar(series(spark, rows), "2023-01-02", "2024-06-28")
    for m in "abc":
        assert column(out.filter(F.col("market") == m), "price") == pytest.approx(want[m], rel=1e-12)
    assert out.filter("price IS NULL").count() == 0


def test_reindex_and_coverage(spark):
    df = series(spark, [("m", "2024-01-02", 1), ("m", "2024-01-10", 2), ("n", "2023-12-01", 3)])
    out = calendar.calendar_reindex(df.filter("market = 'm'"), "2024-01-01", "2024-01-12")
    assert column(out, "price") == [None, 1.0, None, None, None, None, None, 2.0, None, None]
    stats = {r.market: r for r in calendar.coverage_stats(df, "2024-01-01", "2024-01-12").collect()}
    assert tuple(stats["m"])[1:] == (day("2024-01-02"), day("2024-01-10"), 10, 2, 8, 80.0)
    assert tuple(stats["n"])[1:] == (None, None, 10, 0, 10, 100.0)


def test_calendar_bounds():
    assert calendar.business_day_count("2022-06-01", "2025-09-03") == 851
    assert calendar.business_day_count("2022-09-01", "2025-09-03") == 785
    with pytest.raises(ValueError):
        calendar.check_bounds("2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        calendar.check_bounds("0001-01-01", "9999-12-31")


def test_observed(spark):
    df = series(spark, [("m", "2024-01-05", 1), ("m", "2024-01-06", 2), ("n", "2024-01-05", 3)])
    assert calendar.observed_in_range(df, "2024-01-01", "2024-01-31").count() == 2
    assert calendar.index_intersection(df, "2024-01-01", "2024-01-31").count() == 1


def test_clean_prices(spark):
    rows = [("m", "2024-01-05", 3.0, 1), ("m", "2024-01-05", 4.0, 2), ("m", "2024-01-05", 0.0, 3),
            ("m", "2024-01-06", 9.0, 4), ("m", "2024-01-08", float("nan"), 5),
            ("m", "2024-01-09", None, 6), ("m", "2024-01-10", float("inf"), 7),
            ("m", "2024-01-11", -2.0, 8)]
    df = spark.createDataFrame([(m, day(d), p, s) for m, d, p, s in rows],
                               "market string, d date, price double, seq bigint")
    out = clean.clean_prices(df, "2024-01-01", "2024-12-31").orderBy("d").collect()
    assert [tuple(r) for r in out] == [("m", day("2024-01-05"), 4.0), ("m", day("2024-01-11"), -2.0)]


def test_small_indicator_values(spark):
    w = indicators.series_window()
    df = indicators.price_delta(prices(spark, [1, 2, 1, 3, 3, 2]), w)
    assert column(df.withColumn("x", indicators.direction("delta")), "x") == [0, 1, -1, 1, 0, -1]
    out = indicators.ewm(df, {"g": ("gain", 1 / 14)}, w)
    assert column(out, "g")[0] is None
    assert column(out, "g")[1:] == pytest.approx([1, 0.928571, 1.005102, 0.933309, 0.866644], abs=1e-6)


@pytest.mark.parametrize("alpha", [2 / 3, 0.5, 2 / 11, 2 / 13, 2 / 27, 1 / 14])
def test_ewm_is_a_fold(spark, alpha):
    rng = np.random.default_rng(3)
    xs = rng.uniform(1, 1e6, 3000)
    df = prices(spark, xs, start="2000-01-01")
    got = column(indicators.ewm(df, {"e": ("price", alpha)}, indicators.series_window()), "e")
    e, want = xs[0], []
    for i, x in enumerate(xs):
        e = x if i == 0 else alpha * x + (1 - alpha) * e
        want.append(e)
    assert got == pytest.approx(want, rel=1e-13)


def folded(xs, weight):
    """The exponential average of a list, value by value; missing values at the start are passed over."""
    out, state = [], None
    for x in xs:
        if x is not None:
            state = x if state is None else state + weight * (x - state)
        out.append(state)
    return out


def test_technicals_by_definition(spark):
    rng = np.random.default_rng(11)
    xs = (50 + rng.normal(0, 1, 700).cumsum()).tolist()
    xs[300:320] = [xs[299]] * 20  # a flat stretch
    got = indicators.technicals(prices(spark, xs, start="2010-01-01")).orderBy("d").collect()
    steps = [None] + [b - a for a, b in zip(xs, xs[1:])]
    up = folded([None if s is None else max(s, 0.0) for s in steps], 1 / 14)
    down = folded([None if s is None else max(-s, 0.0) for s in steps], 1 / 14)
    fast, slow = folded(xs, 2 / 13), folded(xs, 2 / 27)
    line, level = [], 0
    for s in steps:
        level += 0 if s is None else (s > 0) - (s < 0)
        line.append(float(level))
    quick, lazy = folded(line, 2 / 4), folded(line, 2 / 11)
    for i, row in enumerate(got):
        last5 = xs[max(0, i - 4):i + 1]
        assert row.SMA_5 == pytest.approx(sum(last5) / len(last5), rel=1e-9)
        assert row.PPO_12_26 == pytest.approx(100 * (fast[i] / slow[i] - 1), rel=1e-7, abs=1e-9)
        if i == 0 or not down[i]:
            assert row.RSI_14 is None
        else:
            assert row.RSI_14 == pytest.approx(100 * up[i] / (up[i] + down[i]), rel=1e-9)
        assert row.ROC_10 == (None if i < 10 else pytest.approx(100 * (xs[i] / xs[i - 10] - 1), rel=1e-7, abs=1e-9))
        moves = [abs(s) for s in steps[max(0, i - 13):i + 1] if s is not None]
        assert row.ATR_14 == (pytest.approx(sum(moves) / len(moves), rel=1e-9) if moves else None)
        assert row.CO_chaikin_3_10 == pytest.approx(quick[i] - lazy[i], rel=1e-9, abs=1e-9)


def test_one_shuffle_by_market(spark):
    df = indicators.technicals(calendar.fill_calendar(
        prices(spark, range(1, 60)), "2024-01-01", "2024-03-29"))
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in text and "Cartesian" not in text


def market_tables(spark):
    days = [day("2024-01-01") + dt.timedelta(i) for i in range(60)]
    base = spark.createDataFrame(
        [(m, d, 10.0 + i + k) for k, m in enumerate("ab") for i, d in enumerate(days)
         if d.weekday() < 5 and (i + k) % 3], "market string, d date, price double")
    quotes = spark.createDataFrame(
        [(t, d, 1.0 * i + j) for j, t in enumerate(["EQ", "FX", "C1"]) for i, d in enumerate(days)
         if d.weekday() < 5 and i % 4 == j], "ticker string, d date, price double")
    config = spark.createDataFrame([("a", "EQ", "FX"), ("b", "EQ", "NONE")],
                                   "market string, equity_ticker string, fx_ticker string")
    return base, config, quotes


def test_build_panel(spark):
    base, config, quotes = market_tables(spark)
    out = panels.build_panel(base, config, quotes, {c: "C1" for c in
                             ["CL_F", "NG_F", "RB_F", "HRC_F", "ALI_F"]},
                             "2024-01-01", "2024-02-29", "2024-01-15")
    assert out.columns[:4] == ["market", "d", "Price", "equity_index"]
    n = calendar.business_day_count("2024-01-15", "2024-02-29")
    assert out.groupBy("market").count().orderBy("market").collect() == [("a", n), ("b", n)]
    assert out.filter("market = 'b' AND fx_rate IS NOT NULL").count() == 0
    assert [tuple(r) for r in panels.unused_tickers(config, quotes).collect()] == [("NONE", "b")]


def test_panel_does_not_depend_on_partitioning(spark):
    base, config, quotes = market_tables(spark)
    args = ({c: "C1" for c in ["CL_F", "NG_F", "RB_F", "HRC_F", "ALI_F"]}, "2024-01-01", "2024-02-29")
    a = panels.build_panel(base, config, quotes, *args).orderBy("market", "d").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = panels.build_panel(base.repartition(5), config, quotes.repartition(7), *args) \
            .orderBy("market", "d").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b


def test_feature_groups(spark):
    from tidemark.operators.reports import feature_group, price_feature_pairs
    df = spark.createDataFrame([("SMA_5",), ("CO_chaikin_3_10",), ("fx_rate",), ("NG_F",), ("Price",)],
                               "c string").select("c", feature_group("c").alias("g"))
    assert {r.c: r.g for r in df.collect()} == {
        "SMA_5": "technical", "CO_chaikin_3_10": "technical", "fx_rate": "financial",
        "NG_F": "commodities", "Price": None}
    p = spark.createDataFrame([("m", day("2024-01-02"), 1.0, 2.0, None)],
                              "market string, d date, Price double, a double, b double")
    assert price_feature_pairs(p, ["a", "b"]).select("feature", "value").collect() == [("a", 2.0)]
