"""The whole grid over all windows of every market, against brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast
from workload import fixtures as fx
from workload.learners import mean_of_layers


def test_whole_grid_over_all_windows(spark):
    values = {"a": [float(3 * k % 11 + k) for k in range(16)], "b": [float(k * k % 13) for k in range(13)]}
    rows = [(m, dt.date(2024, 1, 1) + dt.timedelta(k), y, y + 1) for m, ys in values.items() for k, y in enumerate(ys)]
    labelled = spark.createDataFrame(rows, "market string, d date, y double, x double")
    configs = forecast.grid_configs(forecast.full_grid(spark).filter(F.col("model") != "naive_last_price"))
    got = forecast.walk_forward_fit(labelled, ["x"], configs, mean_of_layers(), fx.WINDOW, fx.RATIO).collect()
    split = forecast.split_point(fx.WINDOW, fx.RATIO)
    want = {}
    for c in configs:
        hp = dict(c.hp)
        layers = hp.get("num_layers", hp.get("blocks"))
        for m, ys in values.items():
            for w in range(len(ys) - fx.WINDOW + 1):
                train = ys[w:w + split][-layers:]
                want[m, c.model, c.config_index, w] = sum(train) / len(train)
    assert len(got) == len(want) and max(k[3] for k in want) > 1
    for r in got:
        assert list(r["y_pred"]) == pytest.approx([want[r["market"], r["model"], r["config_index"], r["window_id"]]] * len(r["y_pred"]))
