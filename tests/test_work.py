"""What is still to be done, where it is done, and what of a log counts as done."""

import datetime as dt
import random
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import forecast, metrics
from tidemark.plans import tune as tuning
from tidemark.session import stored
from tidemark.sources import logs

import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEYS = ["market", "model", "config_index"]


def labelled(spark, sizes):
    rng = random.Random(1)
    rows = [(m, dt.date(2020, 1, 1) + dt.timedelta(k), rng.uniform(5, 9), rng.uniform(5, 9)) for m, n in sizes.items() for k in range(n)]
    return stored(spark.createDataFrame(rows, "market string, d date, Price double, y double"), "labelled")


def last_label(x_train, y_train, x_test, hp, seed):
    import numpy as np
    return np.full(len(x_test), y_train[-hp["k"]]), None


def key(df):
    return sorted(((r.market, r.model, r.config_index, r.window_id, tuple(r.y_pred)) for r in df.collect()))


def config(i, **hp):
    return forecast.Config("net", i, tuple(hp.items()))


def test_missing_windows_by_definition(spark):
    rng = random.Random(4)
    counts = {"a": 40, "b": 7, "c": 0}
    rows, want = [], set()
    for m, n in counts.items():
        for c in range(5):
            state = {w: rng.choice(["good"] * 6 + ["late", "absent"]) for w in range(n)}
            if c == 4:
                state = dict.fromkeys(state, "absent")
            rows += [(m, "x", c, w, None if s == "good" else s) for w, s in state.items() if s != "absent"]
            want |= {(m, c, w) for w, s in state.items() if s != "good"}
    rows += [("a", "x", 0, 99, None), ("a", "x", 0, -1, None)]  # beyond the run
    log = spark.createDataFrame(rows, "market string, model string, config_index int, window_id long, error string")
    todo = spark.createDataFrame([(m, "x", c) for m in counts for c in range(5)] * 2, "market string, model string, config_index int")
    expected = spark.createDataFrame(list(counts.items()), "market string, n_expected long")
    got = logs.missing_windows(todo, log, expected).collect()
    assert {(r.market, r.config_index, w) for r in got for w in range(r.first, r.last + 1)} == want
    spans = sorted((r.market, r.config_index, r.first, r.last) for r in got)
    assert all(a[:2] != b[:2] or a[3] + 1 < b[2] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("learner", ["native", "fit"])
def test_a_cut_run_fits_only_the_rest(spark, learner):
    """Stopped at window 500 of 772: 272 windows are left, and both logs equal a whole run."""
    lab = labelled(spark, {"m": 781})
    if learner == "native":
        configs = [forecast.Config("rolling_mean", 0, (("lookback", 3),)), forecast.Config("rolling_mean", 1, (("lookback", 5),))]
        run = forecast.native_log
    else:
        configs = [config(0, k=1), config(1, k=2)]
        run = lambda lab, cfgs, w, ratio, todo=None: forecast.walk_forward_fit(lab, ["Price"], cfgs, last_label, w, ratio, todo=todo)
    whole = stored(run(lab, configs, 10, 0.1), "whole")
    assert whole.groupBy("config_index").count().filter("count = 772").count() == 2
    done = whole.filter("config_index = 0 AND window_id < 500 OR config_index = 1 AND window_id <> 300")
    rest = tuning.grid_log(lab, configs, 10, 0.1, done, learner=run, by_window=True)
    assert {r.config_index: r["count"] for r in rest.groupBy("config_index").count().collect()} == {0: 272, 1: 1}
    assert key(done.unionByName(rest)) == key(whole)


# ---- work placed by cost -----------------------------------------------------------------

def test_parts_of_equal_cost():
    rng = random.Random(3)
    configs = [config(i, c=rng.choice([1, 2, 30])) for i in range(500)]
    cost = lambda c: float(dict(c.hp)["c"])
    parts = forecast.config_parts(configs, 64, cost)
    sums = [sum(map(cost, p)) for p in parts]
    assert sorted(c.config_index for p in parts for c in p) == list(range(500)) and max(map(len, parts)) <= 64
    assert max(sums) < 1.1 * sum(sums) / len(sums)
    assert forecast.config_parts(configs, 64)[0] == configs[:64]


def test_no_task_is_overloaded(spark):
    """Units of very different cost: the most loaded task has less than 1.3 of the mean, by a hash more than 2."""
    configs = [config(i, c=(1, 4, 30)[i % 3]) for i in range(96)]
    cost = lambda c: float(dict(c.hp)["c"])
    counts = spark.createDataFrame([(f"m{k}", 30 + 97 * k) for k in range(14)], "market string, n_expected long")
    tasks = 12
    units = stored(forecast.work_units(counts, forecast.config_parts(configs, 16, cost), 256, cost), "units")
    def load(df, by):
        sums = [r["s"] for r in df.repartition(tasks, *by).groupBy(F.spark_partition_id()).agg(F.sum("cost").alias("s")).collect()]
        return max(sums) * tasks / sum(sums)
    placed = stored(forecast.placed(units, tasks), "placed")
    assert placed.select("slot").distinct().count() == tasks
    assert load(placed, ["slot"]) < 1.3 < 2 < max(load(units, ["market"]), load(units, ["market", "block"]))
    total = sum(cost(c) for c in configs) * sum(30 + 97 * k for k in range(14))
    assert placed.agg(F.sum("cost")).first()[0] == pytest.approx(total)


def test_units_of_intervals(spark):
    """Only blocks that hold a window to run are units, and they cost what is to run in them."""
    configs = [config(0, c=1), config(1, c=5), config(2, c=1)]
    counts = spark.createDataFrame([("a", 1000), ("b", 100)], "market string, n_expected long")
    todo = spark.createDataFrame([("a", "net", 0, 250, 260), ("a", "net", 1, 0, 0), ("a", "net", 1, 990, 5000), ("b", "net", 2, 100, 120),
                                  ("a", "other", 0, 0, 10)], "market string, model string, config_index int, first long, last long")
    units = forecast.work_units(counts, [configs], 256, lambda c: float(dict(c.hp)["c"]), todo).collect()
    got = {(r.market, r.block): ([tuple(x) for x in r.runs], r.cost) for r in units}
    assert got == {("a", 0): ([(0, 250, 255), (1, 0, 0)], 11.0), ("a", 1): ([(0, 256, 260)], 5.0), ("a", 3): ([(1, 990, 999)], 50.0)}


def test_placing_changes_no_result(spark):
    lab = labelled(spark, {"m": 90, "n": 41, "short": 5})
    configs = [config(i, k=1 + i % 4) for i in range(23)]
    fit = lambda **more: key(forecast.walk_forward_fit(lab, ["Price"], configs, last_label, 10, 0.1, block_windows=16, block_configs=5, **more))
    want = fit()
    assert len(want) == 23 * (81 + 32)
    assert fit(cost=lambda c: 30.0 if c.config_index < 4 else 1.0, tasks=3) == want == fit(tasks=1)
    cut = fit(max_windows=20)
    assert cut == [r for r in want if r[3] < 20]


# ---- committed runs ----------------------------------------------------------------------

def rows(df):
    return sorted(map(tuple, df.select("market", "model", "config_index", "window_id", "run_seq").collect()))


def test_only_finished_runs_count(spark, tmp_path):
    path, lab = str(tmp_path / "log"), labelled(spark, {"m": 30})
    log = forecast.walk_forward_naive(lab, 10, 0.1)
    logs.append_log(log, path, 5)
    want = rows(logs.read_log_table(spark, path))
    logs.append_log(log, path, 5)  # the same run once more
    log.filter("window_id < 3").withColumn("run_seq", F.lit(6).cast("long")).write.partitionBy("model", "market").parquet(f"{path}/attempt=6-x")
    assert rows(logs.read_log_table(spark, path)) == want and len(want) == 21
    broken = F.udf(lambda w: 1 // (w - 20) + w, "long")  # the last window raises, after others were written
    with pytest.raises(Exception):
        logs.append_log(log.withColumn("window_id", broken("window_id")), path, 7)
    assert rows(logs.read_log_table(spark, path)) == want
    logs.append_log(log, path, 7)
    assert len(rows(logs.read_log_table(spark, path))) == 42
    assert len(logs.clear_attempts(spark, path)) >= 1 and logs.clear_attempts(spark, path) == []
    assert len(rows(logs.read_log_table(spark, path))) == 42


def test_two_appends_of_one_run_at_a_time(spark, tmp_path):
    path, lab = str(tmp_path / "log"), labelled(spark, {"m": 30})
    log, failed = forecast.walk_forward_naive(lab, 10, 0.1), []

    def append():
        try:
            logs.append_log(log, path, 1)
        except Exception as e:
            failed.append(e)
    threads = [threading.Thread(target=append) for _ in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(rows(logs.read_log_table(spark, path))) == 21 and len(failed) <= 2


def test_tables_without_a_manifest_are_read(spark, tmp_path):
    path, lab = str(tmp_path / "log"), labelled(spark, {"m": 30})
    log = forecast.walk_forward_naive(lab, 10, 0.1)
    log.withColumn("run_seq", F.lit(1).cast("long")).write.partitionBy("model", "market").parquet(path)
    assert len(rows(logs.read_log_table(spark, path))) == 21
    logs.append_log(log.withColumn("y_pred", F.array(F.lit(0.5))), path, 2)
    got = logs.read_log_table(spark, path)
    assert len(rows(got)) == 42 and {r.y_pred[0] for r in metrics.dedupe_log(got).collect()} == {0.5}
    assert got.filter("market = 'x'").count() == 0
