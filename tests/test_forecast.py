import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, metrics, windows
from tidemark.operators.clean import date_slice
from tidemark.plans import evaluate, tune as tuning
from tests.helpers import column, day, plan, prices

GRID = [forecast.BASELINE_ONLY,
        forecast.Config("rolling_mean", 0, (("lookback", 2),)),
        forecast.Config("rolling_mean", 1, (("lookback", 4),)),
        forecast.Config("rolling_ols", 0)]


def labelled(spark, n=60, seed=2, markets="ab"):
    rng = np.random.default_rng(seed)
    out = None
    for m in markets:
        df = prices(spark, 20 + rng.normal(0, 1, n).cumsum(), market=m)
        out = df if out is None else out.union(df)
    return windows.next_price_label(out.withColumnRenamed("price", "Price"), ["Price"])


@pytest.mark.parametrize("w, ratio, want", [(20, .05, 19), (10, .1, 9), (2, .9, 1), (20, .15, 17),
                                            (10, .95, 1)])
def test_split(w, ratio, want):
    assert windows.split_point(w, ratio) == want


@pytest.mark.parametrize("w, ratio", [(1, .1), (10, 0.0), (10, 1.0)])
def test_split_errors(w, ratio):
    with pytest.raises(ValueError):
        windows.split_point(w, ratio)


def test_label_may_come_from_a_dropped_row(spark):
    df = prices(spark, [1, 2, 3, 4]).withColumnRenamed("price", "Price").withColumn(
        "f", F.when(F.col("Price") != 2, 1.0))
    out = windows.next_price_label(df, ["Price", "f"]).orderBy("d").select("Price", "y").collect()
    assert [tuple(r) for r in out] == [(1.0, 2.0), (3.0, 4.0)]


def test_sliding_windows(spark):
    lab = labelled(spark, 88, markets="a")
    out = windows.sliding_windows(lab, 20, 0.05)
    assert out.select("window_id").distinct().count() == 68
    assert out.count() == 68 * 20 and out.filter("is_train").count() == 68 * 19
    assert windows.sliding_windows(lab, 20, 0.05, max_windows=5).count() == 100
    assert windows.sliding_windows(lab, 90, 0.05).count() == 0
    assert windows.short_series(lab, 90).collect() == [("a", 87)]
    assert windows.short_series(lab, 87).count() == 0


def brute(lab, w, ratio, learn):
    """Forecast row by row in plain Python."""
    split, out = windows.split_point(w, ratio), {}
    rows = lab.orderBy("d").collect()
    by = {}
    for r in rows:
        by.setdefault(r.market, []).append(r)
    for m, rs in by.items():
        for k in range(len(rs) - w + 1):
            tr, te = rs[k:k + split], rs[k + split:k + w]
            out[m, k] = ([r.y for r in te], learn(np.array([r.Price for r in tr]),
                         np.array([r.y for r in tr]), np.array([r.Price for r in te])))
    return out


def line(x, y, z):
    slope, base = np.polyfit(x, y, 1)
    return base + slope * z


@pytest.mark.parametrize("w, ratio", [(10, 0.1), (12, 0.25)])
def test_native_learners_match_brute_force(spark, w, ratio):
    lab = labelled(spark)
    got = forecast.native_log(lab, GRID, w, ratio).collect()
    learners = {("naive_last_price", -1): lambda x, y, z: z,
                ("rolling_mean", 0): lambda x, y, z: np.full(len(z), y[-2:].mean()),
                ("rolling_mean", 1): lambda x, y, z: np.full(len(z), y[-4:].mean()),
                ("rolling_ols", 0): line}
    for (model, c), learn in learners.items():
        want = brute(lab, w, ratio, learn)
        rows = {(r.market, r.window_id): r for r in got if (r.model, r.config_index) == (model, c)}
        assert rows.keys() == want.keys()
        for key, (truth, pred) in want.items():
            assert rows[key].y_true == truth
            assert rows[key].y_pred == pytest.approx(pred, rel=1e-8)


def test_log_dates_and_limits(spark):
    lab = labelled(spark, markets="a")
    out = forecast.walk_forward_naive(lab, 12, 0.25, max_windows=3).orderBy("window_id").collect()
    assert len(out) == 3
    assert (out[0].start_date, out[0].end_date) == (day("2024-01-10"), day("2024-01-12"))


def test_flat_train_rows(spark):
    df = prices(spark, [5.0] * 15 + [6.0, 7.0]).withColumnRenamed("price", "Price")
    log = forecast.native_log(windows.next_price_label(df, ["Price"]), GRID[3:], 10, 0.1)
    assert log.filter("window_id = 0").first().y_pred == [5.0]
    assert log.filter("y_pred[0] IS NULL OR isnan(y_pred[0])").count() == 0


def test_bad_configs(spark):
    lab = labelled(spark, 20, markets="a")
    with pytest.raises(ValueError):
        forecast.native_log(lab, [forecast.Config("rolling_mean", 0, (("lookback", 10),))], 10, 0.1)
    with pytest.raises(ValueError):
        forecast.native_log(lab, [forecast.Config("mlp", 0)], 10, 0.1)


def fit(x_train, y_train, x_test, hp, seed):
    if hp.get("lookback") == 4:
        raise RuntimeError("no")
    return np.full(len(x_test), y_train[-2:].mean()), float(len(y_train))


def test_walk_forward_fit_blocks(spark):
    """Blocks and parts of the grid must not show in the result; errors are data."""
    lab = labelled(spark)
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log = forecast.walk_forward_fit(lab, ["Price"], GRID[1:3], fit, 12, 0.25, block_windows=13,
                                    block_configs=1)
    want = brute(lab, 12, 0.25, lambda x, y, z: np.full(len(z), y[-2:].mean()))
    rows = log.collect()
    good = {(r.market, r.window_id): r for r in rows if r.config_index == 0}
    assert len(rows) == 2 * len(want) and good.keys() == want.keys()
    for key, (truth, pred) in want.items():
        assert good[key].y_true == truth and good[key].y_pred == pytest.approx(pred, rel=1e-12)
        assert good[key].train_loss == 9.0
    bad = [r for r in rows if r.config_index == 1]
    assert all(r.y_pred is None and r.error == "RuntimeError: no" for r in bad)
    assert metrics.failed_fits(log).count() == 2
    few = forecast.walk_forward_fit(lab, ["Price"], GRID[1:2], fit, 12, 0.25, max_windows=4)
    assert few.count() == 8


def test_scale_stats(spark):
    lab = labelled(spark, 40, markets="a").withColumn("k", F.lit(3.0))
    rows = lab.orderBy("d").collect()
    y, x = np.array([r.y for r in rows]), np.array([r.Price for r in rows])
    std = {r.window_id: r for r in windows.standard_scale_stats(lab, 10, 0.2).collect()}
    rob = {(r.feature, r.window_id): r for r in
           windows.robust_scale_stats(lab, ["Price", "k"], 10, 0.2).collect()}
    assert sorted(std) == list(range(len(y) - 9))
    for k in std:
        assert std[k].y_mean == pytest.approx(y[k:k + 8].mean())
        assert std[k].y_scale == pytest.approx(y[k:k + 8].std())
        q1, q2, q3 = np.percentile(x[k:k + 8], [25, 50, 75])
        assert (rob["Price", k].median, rob["Price", k].iqr) == pytest.approx((q2, q3 - q1))
        assert (rob["k", k].median, rob["k", k].iqr) == (3.0, 1.0)
    flat = windows.standard_scale_stats(lab.withColumn("y", F.lit(1e5 / 3)), 10, 0.2)
    assert {r.y_scale for r in flat.collect()} == {1.0}


def test_grid(spark):
    grid = forecast.full_grid(spark)
    rows = {(r.model, r.config_index): r for r in grid.collect()}
    assert len(rows) == 2026
    assert json.loads(rows["gru", 272].hp_json) == {
        "hidden_units": 128, "num_layers": 2, "activation": "relu", "learning_rate": 0.01,
        "batch_size": 32, "epochs": 64}
    tcn = rows["tcn", 107]
    assert (tcn.hp["channels"], tcn.hp["blocks"], tcn.hp["activation"], tcn.hp["learning_rate"],
            tcn.hp["epochs"], tcn.hp["kernel_size"]) == ("32", "4", "tanh", "0.01", "64", "5")
    assert rows["naive_last_price", -1].hp_json == "{}"
    assert all(r.hp_json == json.dumps(json.loads(r.hp_json), sort_keys=True) for r in rows.values())
    assert forecast.limit_configs(grid, 3).count() == 16
    big = forecast.config_grid(spark, "x", {c: range(100) for c in "abc"})
    assert big.filter("config_index = 123456").first().hp == {"a": "12", "b": "34", "c": "56"}


def test_the_grid_as_a_run(spark):
    """All configs of the grid table through the cheap learner, with all of their text unchanged."""
    grid = forecast.full_grid(spark)
    configs = forecast.grid_configs(grid.filter("model <> 'naive_last_price'"))
    text = {(r.model, r.config_index): r.hp_json for r in grid.collect()}
    assert len(configs) == 2025 and all(c.hp_json == text[c.model, c.config_index] for c in configs)
    assert dict(configs[0].hp)["learning_rate"] == 0.01
    assert len(forecast.grid_configs(grid, max_configs=3)) == 16
    lab = labelled(spark, 20, markets="a")
    start = time.perf_counter()
    runs = forecast.all_runs(lab, configs)
    assert time.perf_counter() - start < 2 and runs.count() == 2025
    log = forecast.walk_forward_fit(lab, ["Price"], configs, last_label, 12, 0.25, max_windows=2)
    assert log.count() == 2 * 2025 and log.filter("error IS NOT NULL").count() == 0


def last_label(x_train, y_train, x_test, hp, seed):
    assert isinstance(hp["epochs"], int)
    return np.full(len(x_test), y_train[-1]), None


def test_grid_cross(spark):
    w = windows.test_rows(labelled(spark, 20, markets="a"), 10, 0.1)
    out = forecast.grid_cross(w, GRID)
    assert out.count() == w.count() * 4
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_tune_and_evaluate(spark):
    lab = labelled(spark, 120)
    early, late = date_slice(lab, end="2024-02-29"), date_slice(lab, "2024-03-01")
    best = tuning.tune(early, GRID, 10, 0.1)
    assert best.count() == 6
    scores = metrics.config_scores(forecast.native_log(early, GRID, 10, 0.1)).collect()
    for r in best.collect():
        assert r.MAPE == min(s.MAPE for s in scores if (s.market, s.model) == (r.market, r.model))
    out = evaluate.evaluate_best(late, best, GRID, 10, 0.1)
    assert {(r.market, r.model, r.config_index) for r in out.collect()} == {
        (r.market, r.model, r.config_index) for r in best.collect()}
    done = forecast.native_log(early, GRID[:2], 10, 0.1)
    left = tuning.tune(early, GRID, 10, 0.1, done=done)
    assert {r.model for r in left.collect()} == {"rolling_mean", "rolling_ols"}


def test_baseline_is_always_evaluated(spark):
    best = spark.createDataFrame([("a", "mlp", 3, "{}"), ("b", "naive_last_price", -1, "{}")],
                                 "market string, model string, config_index int, hyperparams_json string")
    out = {(r.market, r.model, r.config_index) for r in evaluate.best_config_join(best).collect()}
    assert out == {("a", "mlp", 3), ("a", "naive_last_price", -1), ("b", "naive_last_price", -1)}
    assert evaluate.union_distinct_models(best).count() == 3
