import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranking, reports, traces
from tests.helpers import column, day, plan
from workload import registry

PAIRS = "g string, y_true double, y_pred double"


def score(spark, t, p, report=False):
    df = spark.createDataFrame([("g", a, b) for a, b in zip(t, p)], PAIRS)
    return (metrics.safe_metrics if report else metrics.forecast_metrics)(df, ["g"]).first()


def test_constant_truth(spark):
    assert score(spark, [5.0] * 3, [5.0] * 3).R2 == 1.0
    assert score(spark, [5.0] * 3, [5.0, 5.0, 6.0]).R2 == 0.0
    assert score(spark, [5.0] * 3, [5.0, 5.0, 6.0], report=True).R2 is None
    assert score(spark, [5.0], [4.0]).R2 is None


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    t, p = rng.uniform(10, 20, 500), rng.uniform(10, 20, 500)
    r = score(spark, t.tolist(), p.tolist())
    rmse = np.sqrt(((t - p) ** 2).mean())
    assert r.MAPE == pytest.approx((abs(p - t) / t).mean())
    assert (r.RMSE, r.MAE, r.mean_price) == pytest.approx((rmse, abs(p - t).mean(), t.mean()))
    assert r.RMSE_over_mean_price == pytest.approx(rmse / t.mean())
    assert r.R2 == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert r.n_samples == 500


def test_two_normalisers(spark):
    t, p = [-2.0, 2.0, -4.0, 4.0], [-1.0, 2.0, -4.0, 5.0]
    assert score(spark, t, p).RMSE_over_mean_price is None  # signed mean is 0
    assert score(spark, t, p, report=True).RMSE_over_mean_price == pytest.approx(np.sqrt(0.5) / 3)


def test_report_skips_non_finite(spark):
    r = score(spark, [1.0, float("nan"), 2.0, None], [1.0, 2.0, float("inf"), 3.0], report=True)
    assert (r.n_points, r.MAPE) == (1, 0.0)


LOG = ("market string, model string, config_index int, window_id bigint, hp_json string, "
       "end_date date, y_true array<double>, y_pred array<double>, seq int")


def log(spark):
    d = day("2024-01-05")
    return spark.createDataFrame([
        ("m", "x", 0, 0, '{"a": 1}', d, [1.0, 2.0], [1.0, 1.0], 0),
        ("m", "x", 0, 1, '{"b": 2}', d, [4.0], [5.0], 0),
        ("m", "x", 0, 2, None, d, [], [], 0),
        ("m", "x", 1, 0, "{}", d, [], [], 0),
        ("m", "x", 2, 0, "{}", d, [9.0], [9.0], 0),
        ("m", "x", 2, 0, "{}", d, [1.0], [2.0], 1)], LOG)


def test_config_scores(spark):
    out = {r.config_index: r for r in metrics.config_scores(metrics.dedupe_log(log(spark), "seq")).collect()}
    assert set(out) == {0, 2}  # a config without forecasts has no score
    assert (out[0].n_windows, out[0].n_samples, out[0].hyperparams_json) == (3, 3, '{"a": 1}')
    assert out[0].MAPE == pytest.approx((0 + 0.5 + 0.25) / 3)
    assert (out[2].n_windows, out[2].MAE) == (1, 1.0)
    assert metrics.log_windows(log(spark)).filter("config_index = 2").first().n_windows == 1


def test_uneven_lists(spark):
    df = spark.createDataFrame([("m", "x", 0, 0, "{}", None, [1.0, 2.0], [1.0], 0)], LOG)
    assert metrics.uneven_cells(df).first().n_uneven == 1
    assert metrics.config_scores(df).first().n_samples == 1


def test_train_loss_skips_nan(spark):
    df = spark.createDataFrame([("m", "x", 0, 1.0), ("m", "x", 0, float("nan")), ("m", "x", 0, None),
                                ("m", "x", 0, 3.0)], "market string, model string, config_index int, train_loss double")
    assert metrics.mean_train_loss(df).first().train_loss_last_mean == 2.0


def trace(spark, n, market="m", model="x", bad=()):
    return spark.createDataFrame(
        [(market, model, day("2024-01-01").replace(day=1 + i), float(i + 1),
          float("nan") if i in bad else float(i + 2)) for i in range(n)],
        "market string, model string, target_date date, y_true double, y_pred double")


@pytest.mark.parametrize("n, sizes", [(10, [3, 3, 4]), (6, [2, 2, 2]), (7, [2, 2, 3]), (8, [2, 3, 3]),
                                      (5, [2, 2]), (4, [2]), (3, []), (2, [])])
def test_chunk_sizes(spark, n, sizes):
    out = metrics.trace_chunks(trace(spark, n)).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in out] == sizes


def test_gold_metrics(spark):
    df = trace(spark, 10, bad=(4,)).union(trace(spark, 2, model="short"))
    out = {r.model: r for r in metrics.gold_metrics(df).collect()}
    t = np.array([i + 1.0 for i in range(10) if i != 4])
    mape = [np.mean(1 / c) for c in np.split(t, [3, 6])]
    assert out["x"].n_points == 9 and out["x"].MAPE == pytest.approx(np.mean(mape))
    assert out["x"].MAPE_raw == pytest.approx(np.mean(1 / t))
    r2 = [1 - len(c) / ((c - c.mean()) ** 2).sum() for c in np.split(t, [3, 6])]
    assert out["x"].R2 == pytest.approx(np.mean(r2))
    assert out["short"].MAPE is None and out["short"].MAPE_raw == pytest.approx(0.75)


def test_clipped_errors(spark):
    df = spark.createDataFrame([("m", "x", 1.0, 1.1), ("m", "x", 1.0, 1.5), ("m", "x", 2.0, 1.0),
                                ("m", "x", None, 1.0)],
                               "market string, model string, y_true double, y_pred double")
    r = metrics.clipped_error_counts(df).first()
    assert (r.n_clipped, r.n_points) == (2, 3) and (r.min_clipped, r.max_clipped) == (-0.16, 0.16)


def test_trace_keeps_newest_window(spark):
    rows = [("m", "x", 1, day("2024-01-05"), [1.0], [2.0]), ("m", "x", 2, day("2024-01-06"), [3.0], []),
            ("m", "x", 3, day("2024-01-08"), [5.0, 9.0], [6.0, 9.0]), ("m", "x", 4, None, [7.0], [7.0])]
    df = spark.createDataFrame(rows, "market string, model string, window_id int, end_date date, "
                                     "y_true array<double>, y_pred array<double>")
    out = traces.aligned_trace(df).orderBy("target_date").collect()
    assert [(r.target_date, r.y_true, r.y_pred) for r in out] == [
        (day("2024-01-08"), 3.0, None), (day("2024-01-09"), 5.0, 6.0)]


def test_align_models(spark):
    df = trace(spark, 4, model="a").union(trace(spark, 2, model="b"))
    assert traces.align_models(df, ["a", "b"]).count() == 2
    outer = traces.align_models(df, ["a", "b"], how="outer").orderBy("target_date").collect()
    assert [r.b for r in outer] == [2.0, 3.0, None, None]


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([("m", "x", i, None if v != v else v) for i, v in
                                enumerate([float("nan"), 0.9, float("nan"), 0.95])],
                               "market string, model string, config_index int, R2 double")
    df = df.withColumns({c: F.lit(1.0) for c in ("MAPE", "RMSE_over_mean_price", "MAE")})
    out = [r.config_index for r in ranking.ranking_order(df).collect()]
    assert out == [3, 1, 0, 2]
    assert ranking.best_by_market_model(df).first().config_index == 3


def hot_scores(spark, n=3000):
    """One model holds a third of the rows; many values are equal."""
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"m{i % 40}", f"k{i % 7}",
             rng.choice([0.01, 0.02, rng.uniform(0, 0.2), -rng.uniform(0, 5), 0.0]),
             rng.uniform(-1, 1) if i % 11 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "model string, market string, MAPE double, R2 double, config_index int")


def test_ordered_rank_matches_row_number(spark):
    df = hot_scores(spark)
    got = ranking.ordered_rank(df, ["model"], "MAPE", [F.col("config_index")]).collect()
    rows = sorted(df.collect(), key=lambda r: (r.model, r.MAPE, r.config_index))
    place, want = {}, {}
    for r in rows:
        place[r.model] = place.get(r.model, 0) + 1
        want[r.config_index] = place[r.model]
    assert {r.config_index: r["rank"] for r in got} == want


def test_rank_puts_missing_values_last(spark):
    df = hot_scores(spark)
    out = ranking.ordered_rank(df, ["model"], "R2").filter("R2 IS NULL")
    n = {r.model: r["count"] for r in df.filter("R2 IS NOT NULL").groupBy("model").count().collect()}
    assert all(r["rank"] > n.get(r.model, 0) for r in out.collect())


def test_exact_quantiles(spark):
    df = hot_scores(spark)
    got = {r.model: r for r in ranking.exact_quantiles(
        df, ["model"], "R2", {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}).collect()}
    pdf = df.toPandas().dropna(subset=["R2"])
    for model, g in pdf.groupby("model"):
        want = np.percentile(g.R2, [5, 50, 95, 0, 100])
        assert tuple(got[model])[1:] == pytest.approx(tuple(want), rel=1e-12)


def test_no_task_sorts_a_whole_group(spark):
    """Rows are ranked inside the runs of a key; the best config is limited before the shuffle."""
    text = plan(ranking.ordered_rank(hot_scores(spark), ["model"], "MAPE"))
    assert all("run#" in line for line in text.splitlines() if "row_number()" in line)
    best = plan(ranking.top_n(hot_scores(spark).repartition(4), ["model"], ranking.lowest("MAPE"), 1))
    assert best.count("WindowGroupLimit") == 2 and "Partial" in best


@pytest.fixture
def whole_partitions(spark):
    """So little data would else be put together into one run."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, False)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("value", ["0.5", "0.99 + id / 1e7", "CAST(NULL AS DOUBLE)"])
def test_a_concentrated_metric_is_spread(spark, value, whole_partitions):
    """Equal values, values packed together and missing values: no run holds much over its share."""
    df = spark.range(40_000).selectExpr("id", "'m' AS model", f"{value} AS R2")
    runs = ranking.sorted_runs(df, [F.col("model"), F.col("R2").asc_nulls_last(), F.xxhash64(*df.columns)])
    sizes = [r["count"] for r in runs.groupBy("run").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * 40_000 / len(sizes)
    ranks = ranking.ordered_rank(df, ["model"], "R2")
    assert ranks.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 40_000, 40_000)
    got = ranking.exact_quantiles(df, ["model"], "R2", {"half": 0.5}).collect()
    assert [r.half for r in got] == {"0.5": [0.5], "0.99 + id / 1e7": [pytest.approx(0.99 + 19999.5 / 1e7, rel=1e-12)]}.get(value, [])
    assert ranking.ranked_values(df, ["model"], "R2").count() == (40_000 if "id" in value else 1)


def test_missing_numbers_do_not_spread(spark):
    """NaN, infinite and null forecasts are left out of every metric, and of the extremes."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("m", "x", 0, 0, "{}", None, [1.0, 2.0, 100.0, 7.0], [1.5, 2.0, None, nan], 0),
                                ("m", "x", 0, 1, "{}", None, [3.0, 5.0], [3.0, inf], 0),
                                ("m", "x", 1, 0, "{}", None, [1.0, 2.0], [nan, nan], 0)], LOG)
    out = metrics.config_scores(df).collect()
    assert [(r.config_index, r.n_windows, r.n_samples, r.mean_price) for r in out] == [(0, 2, 3, 2.0)]
    assert out[0].R2 == pytest.approx(1 - (0.25 / 3) / (2 / 3))
    assert metrics.unscored_runs(df).first().reason == "no forecast"
    wide = spark.createDataFrame([("m", "x", "a", nan, 0.5), ("m", "x", "b", 0.1, nan), ("m", "x", "c", 0.2, inf)],
                                 "market string, model string, hyperparams_json string, MAPE double, R2 double")
    assert tuple(ranking.best_extremes(wide).first())[2:] == (0.1, None, 0.5)


def test_dedupe_does_not_depend_on_the_layout(spark):
    d = day("2024-01-05")
    rows = [("m", "x", 0, w, "{}", d, [1.0], [float(w % 7 + k)], k // 2) for w in range(60) for k in range(4)]
    got = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, LOG).repartition(1 + 3 * seed)
        got.add(tuple(sorted((r.window_id, r.y_pred[0]) for r in metrics.dedupe_log(df, "seq").collect())))
    assert got == {tuple((w, float(w % 7 + 3)) for w in range(60))}


def test_rank_curves(spark):
    df = hot_scores(spark).withColumn("hyperparams_json", F.col("config_index").cast("string"))
    got = reports.rank_curve_pooled(df).orderBy("model", "rank").toPandas()
    pdf = df.toPandas()
    for model, g in pdf.groupby("model"):
        m, r = np.sort(g.MAPE)[::-1], np.sort(g.R2.dropna())
        k = min(len(m), len(r))
        mine = got[got.model == model]
        if k < 20:
            assert mine.empty
            continue
        assert mine["rank"].tolist() == list(range(1, k + 1))
        np.testing.assert_allclose(mine.MAPE, np.clip(m[:k], 0, 0.05))
        np.testing.assert_allclose(mine.R2, np.clip(r[:k], 0, 1))


def test_rank_curve_by_market(spark):
    df = hot_scores(spark)
    got = reports.rank_curve_by_market(df).orderBy("model", "rank").toPandas()
    for model, g in df.toPandas().groupby("model"):
        ms, rs = [], []
        for _, s in g.groupby("market"):
            m, r = np.sort(s.MAPE)[::-1], np.sort(s.R2.dropna())
            if len(m) >= 5 and len(r) >= 5:
                ms.append(m), rs.append(r)
        mine = got[got.model == model]
        if not ms:
            assert mine.empty
            continue
        k = min(map(len, ms + rs))
        np.testing.assert_allclose(mine.MAPE, np.clip(np.mean([m[:k] for m in ms], axis=0), 0, 0.10))
        np.testing.assert_allclose(mine.R2, np.clip(np.mean([r[:k] for r in rs], axis=0), 0, 1))
    assert reports.rank_curve_by_market(df, top_k=2).agg(F.max("rank")).first()[0] == 2


def test_axis_bounds(spark):
    df = spark.createDataFrame([("a", 0.5)] * 3 + [("b", 0.0), ("b", 1.0), ("c", 2.0)], "model string, R2 double")
    got = {r.model: (r.lo, r.hi) for r in reports.axis_bounds(df).collect()}
    assert got["a"] == pytest.approx((0.47, 0.53)) or got["a"] == pytest.approx((0.44, 0.56))
    assert got["b"] == pytest.approx((0.02, 0.98))
    assert got["c"] == pytest.approx((0.94, 1.0))


def test_histogram(spark):
    df = spark.createDataFrame([("tcn", 0.08), ("tcn", 0.5), ("tcn", 0.0), ("mlp", 0.0005), ("mlp", None)],
                               "model string, mean_MAPE double")
    out = reports.error_histogram(df)
    got = {(r.model, r.bin): (r.n, r.share) for r in out.filter("n > 0").collect()}
    assert got == {("tcn", 39): (2, 2 / 3), ("tcn", 0): (1, 1 / 3), ("mlp", 0): (1, 1.0)}
    assert out.count() == 80
    assert out.agg(F.sum("share")).first()[0] == pytest.approx(2.0)


def test_hp_sensitivity(spark):
    rows = [("MLP", '{"activation": "tanh", "epochs": 16, "learning_rate": 0.0001}', 1.0),
            ("MLP", '{"activation": "relu", "epochs": 16, "learning_rate": 0.01}', 3.0),
            ("MLP", '{"activation": "gelu", "epochs": 16, "learning_rate": 0.01}', 5.0)]
    df = spark.createDataFrame(rows, "model string, hyperparams_json string, mean_MAPE double")
    out = reports.hp_sensitivity(reports.attach_hp(df)).orderBy("hp", "value_order").collect()
    assert [(r.hp, r.value, r.mean_MAPE) for r in out] == [
        ("activation", "relu", 3.0), ("activation", "tanh", 1.0), ("activation", "gelu", 5.0),
        ("learning_rate", "0.0001", 1.0), ("learning_rate", "0.01", 4.0)]


def test_pivots_and_counts(spark):
    df = spark.createDataFrame([("m", "a", 1.0, "x"), ("m", "b", 2.0, "x"), ("n", "a", 3.0, "y")],
                               "market string, model string, MAPE double, hyperparams_json string")
    out = reports.ordered_pivot(df, "MAPE", ["n", "z", "m"], ["b", "a"]).collect()
    assert [(r.market, r.b, r.a) for r in out] == [("n", None, 3.0), ("z", None, None), ("m", 2.0, 1.0)]
    assert tuple(reports.run_counts(df).first()) == (3, 2, 2, 3)


def test_extremes_and_overall(spark):
    rows = [("m", "a", "c1", 0.1, 0.5), ("m", "a", "c2", 0.2, 0.9), ("m", "a", "c3", None, 0.99),
            ("n", "a", "c1", 0.3, None)]
    df = spark.createDataFrame(rows, "market string, model string, hyperparams_json string, MAPE double, R2 double")
    r = ranking.best_extremes(df).orderBy("market").collect()
    assert tuple(r[0])[2:] == (0.1, 0.5, 0.99) and tuple(r[1])[2:] == (0.3, None, None)
    o = {x.hyperparams_json: x for x in reports.cfg_overall(reports.cfg_market(df)).collect()}
    assert (o["c1"].mean_MAPE, o["c1"].mean_R2, o["c1"].markets_covered) == (0.2, 0.5, 2)


def test_runs_of_the_line_log_need_no_shuffle_of_their_own(spark, sf):
    """Whole configs lie in one task: their states are summed up where the windows are."""
    states = metrics.run_states(registry.line_log_with_failures(spark, sf))
    assert plan(states).count("Exchange hashpartitioning") == 1
    assert states.groupBy().sum("n_windows").first()[0] == registry.fx.line_log(spark, sf).count()


def test_windows_of_the_line_log_need_no_shuffle_of_their_own(spark, sf):
    found = metrics.log_windows(registry.fx.line_log(spark, sf))
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert found.groupBy().sum("n_windows").first()[0] == registry.fx.line_log(spark, sf).count()


def test_runs_to_resume_are_not_dealt_by_market(spark, sf):
    """Markets are few: only the windows expected of each are gathered by market, the runs stay where their configs lie."""
    dealt = re.findall(r"Exchange hashpartitioning\((market#\d+(?:, model)?)", plan(registry.resume_incomplete(spark, sf)))
    assert sum("model" not in by for by in dealt) == 1 and len(dealt) == 4
