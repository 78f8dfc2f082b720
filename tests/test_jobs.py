import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, metrics, windows
from tidemark.plans import evaluate, jobs, tune as tuning
from tidemark.schema import COMMODITIES
from tidemark.sources import logs, panels, results
from tests.helpers import day
from tests.test_forecast import GRID, labelled


MARKETS = [("Australia", "E1", "F1"), ("RGGI", "E2", "F2")]
RAW = {c: f"{c}=" for c in COMMODITIES}


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """Two markets with quotes, as a written panel."""
    out = str(tmp_path_factory.mktemp("panel") / "p")
    rng = np.random.default_rng(8)
    days = [day("2022-06-01") + dt.timedelta(i) for i in range(400)]
    days = [d for d in days if d.weekday() < 5]
    walk = {m: 30 + rng.normal(0, 1, len(days)).cumsum() * 0.3 for m in ("Australia", "RGGI")}
    series = spark.createDataFrame([(m, d, float(walk[m][i])) for m in walk for i, d in enumerate(days)
                                    if rng.random() < 0.8], "market string, d date, price double")
    tickers = {"E1", "E2", "F1", "F2", *RAW.values()}
    quotes = spark.createDataFrame([(t, d, float(rng.uniform(1, 2))) for t in sorted(tickers) for d in days
                                    if rng.random() < 0.9], "ticker string, d date, price double")
    stats = jobs.panel_job(series, quotes, out, jobs.market_table(spark, MARKETS), RAW, end="2023-07-03").collect()
    assert {r.market for r in stats} == {"Australia", "RGGI"}
    assert all(r.total_bd == r.observed_bd + r.filled_bd for r in stats)
    return out


def test_tune_evaluate_score_report(spark, panel, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    jobs.tune_job(spark, panel, log, out, GRID[:2], 10, 0.1, end="2023-02-28")
    n = logs.read_log_table(spark, log).count()
    jobs.tune_job(spark, panel, log, out, GRID, 10, 0.1, end="2023-02-28")
    both = logs.read_log_table(spark, log)
    assert both.count() == 2 * n  # only the two missing configs ran
    best = results.read_best_configs(spark, f"{out}/best_configs")
    assert best.count() == 6
    jobs.evaluate_job(spark, panel, f"{out}/best_configs", out, GRID, 10, 0.1, start="2023-03-01")
    got = spark.read.option("header", True).csv(f"{out}/test_metrics")
    assert got.count() == 6 and got.columns[:3] == ["market", "model", "config_index"]
    assert {"hp_hidden_units", "hp_learning_rate", "skipped", "reason", "train_loss_last_mean"} <= set(got.columns)

    files, scored = str(tmp_path / "files"), str(tmp_path / "scored")
    logs.write_log_files(both, files)
    jobs.score_job(spark, files, scored)
    again = results.read_best_configs(spark, f"{scored}/best_configs")
    key = lambda df: sorted((r.market, r.model, r.config_index, round(r.MAPE, 12)) for r in df.collect())
    assert key(again) == key(best)
    jobs.report_job(results.read_scores(spark, f"{scored}/config_scores"), str(tmp_path / "report"))
    ranked = spark.read.option("header", True).csv(str(tmp_path / "report" / "configs_ranked_all"))
    assert ranked.count() == 3
    names = {"rank_in_market", "model_summary", "rank_curve_by_market", "rank_curve_axis", "mape_by_market"}
    assert names <= {p.name for p in (tmp_path / "report").iterdir()}
    assert {"bad_log_files", "unscored_runs", "uneven_cells"} <= {p.name for p in (tmp_path / "scored").iterdir()}
    jobs.trace_job(spark, f"{out}/test_log", str(tmp_path / "traces"), ["rolling_mean", "rolling_ols"])
    side = spark.read.option("header", True).csv(str(tmp_path / "traces" / "aligned_models"))
    assert side.columns[:3] == ["market", "target_date", "y_true"] and side.count() > 20
    assert spark.read.option("header", True).csv(str(tmp_path / "traces" / "gold_metrics")).count() == 6


def test_raw_files_to_panel(spark, tmp_path):
    """Two files with their labels in different places; a market without a file, a ticker without quotes."""
    days = [d for d in (day("2022-06-01") + dt.timedelta(i) for i in range(200)) if d.weekday() < 5]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "Australia.csv").write_text(',"Some title",,\nDate,"Rate, EUR",Secondary Market, \n' + "".join(
        f"{d},0.5,{30 + i % 7}, \n" for i, d in enumerate(days)))
    (tmp_path / "raw" / "RGGI.csv").write_text(',"Other title",,,\nDate,"Rate, EUR",Primary,Secondary Market, \n' + "".join(
        f"{d},0.5,1.25,{10 + i % 5}, \n" for i, d in enumerate(days)))
    quotes = spark.createDataFrame([(t, d, 1.0 + i % 3, 0) for t in ("E1", "F1", "F2", *list(RAW.values())[1:]) for i, d in enumerate(days)],
                                   "ticker string, d date, adj_close double, seq int")
    out = str(tmp_path / "out")
    config = jobs.market_table(spark, [*MARKETS, ("Nowhere", "E1", "F1")])
    jobs.raw_panel_job(spark, str(tmp_path / "raw"), quotes, out, config, RAW, end="2022-12-01")
    got = {(r.market, r.d): r.Price for r in panels.read_panel(spark, f"{out}/panel").collect()}
    assert all(got[m, d] == base + i % step for m, base, step in (("Australia", 30, 7), ("RGGI", 10, 5))
               for i, d in enumerate(days) if day("2022-09-01") <= d <= day("2022-12-01"))
    left = {(r.what, r.market, r.ticker) for r in spark.read.option("header", True).csv(f"{out}/missing_inputs").collect()}
    assert left == {("no price file", "Nowhere", None), ("no quotes", "RGGI", "E2"), ("no quotes", None, list(RAW.values())[0])}
    assert spark.read.option("header", True).csv(f"{out}/coverage").count() == 2


def counting(x_train, y_train, x_test, hp, seed):
    return np.full(len(x_test), y_train[-1]), float(hp.get("lookback", 0))


def test_todo_limits_the_fits(spark):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    lab = labelled(spark, 40)
    runs = forecast.all_runs(lab, GRID[1:])
    assert runs.count() == 6
    todo = runs.filter("(market = 'a' AND config_index = 1) OR (market = 'b' AND model = 'rolling_ols')")
    for size in (1, 2, 256):
        log = forecast.walk_forward_fit(lab, ["Price"], GRID[1:], counting, 10, 0.1,
                                        block_configs=size, todo=todo)
        got = {(r.market, r.model, r.config_index, r.train_loss) for r in log.collect()}
        assert got == {("a", "rolling_mean", 1, 4.0), ("b", "rolling_ols", 0, 0.0)}
    learner = lambda lab, cfgs, w, ratio, todo=None: forecast.walk_forward_fit(
        lab, ["Price"], cfgs, counting, w, ratio, todo=todo)
    best = tuning.tune(lab, GRID[1:], 10, 0.1, done=log, learner=learner)
    assert best.count() == 3


def half_failing(x_train, y_train, x_test, hp, seed):
    """The first config fails in half of the windows and is right in the others."""
    if hp.get("lookback") == 3 and int(abs(y_train[-1]) * 1e6) % 2:
        raise RuntimeError("no")
    return np.full(len(x_test), float("inf") if hp.get("lookback") == 4 else y_train[-1]), 1.0


def test_failed_runs_are_never_chosen_and_run_again(spark, panel, tmp_path):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    configs = [forecast.Config("net", i, (("lookback", k),)) for i, k in enumerate((3, 4, 5))]
    learner = lambda lab, cfgs, w, ratio, todo=None, max_windows=None: forecast.walk_forward_fit(
        lab, ["Price"], cfgs, half_failing, w, ratio, max_windows=max_windows, todo=todo)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    jobs.tune_job(spark, panel, log, out, configs, 10, 0.1, end="2023-02-28", learner=learner, max_windows=12)
    best = results.read_best_configs(spark, f"{out}/best_configs").collect()
    assert {r.config_index for r in best} == {2} and len(best) == 2
    left = spark.read.option("header", True).csv(f"{out}/unscored_runs")
    assert {(r.config_index, r.n_windows) for r in left.collect()} == {("0", "12"), ("1", "12")}
    assert left.filter("config_index = 1 AND reason LIKE '12 of 12 windows failed: ValueError%'").count() == 2
    before = logs.read_log_table(spark, log).count()
    jobs.tune_job(spark, panel, log, out, configs, 10, 0.1, end="2023-02-28", learner=learner, max_windows=12)
    assert logs.read_log_table(spark, log).count() == before + 2 * 2 * 12  # only the failed configs ran again
    jobs.tune_job(spark, panel, log, out, configs[2:], 10, 0.1, end="2023-02-28", learner=learner, max_windows=14)
    runs = {(r.config_index, r.n_windows) for r in metrics.run_states(metrics.dedupe_log(logs.read_log_table(spark, log))).collect()}
    assert (2, 14) in runs and (0, 12) in runs  # a longer run starts over what was cut short


def test_held_out_log_is_written_and_every_fit_runs_once(spark, panel, tmp_path):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    calls = spark.sparkContext.accumulator(0)

    def counted(x_train, y_train, x_test, hp, seed):
        calls.add(1)
        return np.full(len(x_test), y_train[-1]), 2.5

    learner = lambda lab, cfgs, w, ratio, todo=None, max_windows=None: forecast.walk_forward_fit(
        lab, ["Price"], cfgs, counted, w, ratio, max_windows=max_windows, todo=todo)
    config = forecast.Config("net", 4, (("lookback", 5),))
    best = spark.createDataFrame([(m, "net", i, config.hp_json) for m, i in (("Australia", 4), ("RGGI", 9))],
                                 "market string, model string, config_index int, hyperparams_json string")
    lab = jobs.labelled_panel(spark, panel, "2023-03-01", None)
    got = {(r.market, r.model): r for r in evaluate.evaluate_best(
        lab, best, [config, forecast.BASELINE_ONLY], 10, 0.1, learner).collect()}
    fits = got["Australia", "net"].n_windows + sum(r.n_windows for r in got.values() if r.model == "naive_last_price")
    assert calls.value == fits and got["Australia", "net"].train_loss_last_mean == 2.5
    assert got["RGGI", "net"].skipped and "not in the list" in got["RGGI", "net"].reason and got["RGGI", "net"].MAPE is None
    assert not got["RGGI", "naive_last_price"].skipped

    folder, out = str(tmp_path / "best"), str(tmp_path / "out")
    results.write_best_configs(metrics.config_scores(forecast.native_log(lab, GRID[:1], 10, 0.1)), folder)
    jobs.evaluate_job(spark, panel, folder, out, GRID, 10, 0.1, start="2023-03-01")
    first = logs.read_log_table(spark, f"{out}/test_log").count()
    jobs.evaluate_job(spark, panel, folder, out, GRID, 10, 0.1, start="2023-03-01")
    assert logs.read_log_table(spark, f"{out}/test_log").count() == first > 0
