import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import metrics, ranking
from tidemark.sources import logs, market_files, panels, results
from tidemark.streaming import scores as streaming
from tests.helpers import day, plan
from workload import registry

KEYS = ["market", "model", "config_index"]
LOG = ("market string, model string, config_index int, window_id bigint, hp_json string, "
       "start_date date, end_date date, y_true array<double>, y_pred array<double>, train_loss double")


def log(spark, n=6, model="x", markets="mn"):
    d = day("2024-01-05")
    hp = '{"a": "b, c", "lr": 0.0001}'
    return spark.createDataFrame(
        [(m, model, c, w, hp, d, d, [10.0 + w, 1.5], [10.0 + c, 1.25], None)
         for m in markets for c in range(2) for w in range(n)], LOG)


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


# Published daily prices of two markets, and the published scores of forecasting each
# day by the price of the day before.
PRICES = {
    "Australia": [
        29.057831325301205, 29.11566265060241, 29.17349397590361, 29.34698795180723, 29.404819277108437,
        29.46265060240964, 29.520481927710843, 29.57831325301205, 29.751807228915663, 29.809638554216868,
        29.867469879518072, 29.92530120481928, 29.98313253012048, 30.156626506024097, 30.2144578313253,
        30.272289156626503, 30.33012048192771, 30.38795180722892, 30.56144578313253, 30.61927710843373,
        30.67710843373494, 30.734939759036145, 30.79277108433735, 30.966265060240964, 31.02409638554217,
        31.08192771084337, 31.13975903614458, 31.197590361445783, 31.371084337349394, 31.4289156626506,
        31.486746987951804, 31.54457831325301, 31.602409638554214, 31.775903614457828, 31.833734939759037,
        31.89156626506024, 31.949397590361443, 32.00722891566265, 32.18072289156626, 32.23855421686747,
        32.29638554216867, 32.35421686746988, 32.41204819277108, 32.5855421686747, 32.6433734939759,
        32.70120481927711, 32.75903614457831, 32.81686746987952, 32.99036144578313, 33.04819277108434,
        33.10602409638554, 33.16385542168675, 33.22168674698795, 33.39518072289157, 33.45301204819277,
        33.51084337349398, 33.56867469879518, 33.626506024096386, 33.8, 33.8, 33.8, 33.8, 33.8, 33.8, 33.8,
        33.8, 33.8, 33.8, 33.8,
    ],
    "RGGI": [
        12.76, 12.87, 13.15, 13.12, 13.17, 13.26, 13.29, 13.33, 13.37, 13.23, 13.24, 13.28, 13.18, 13.19,
        13.02, 12.8, 12.9, 12.86, 12.96, 13.04, 13.06, 13.37, 13.42, 13.48, 13.5, 13.63, 13.58, 13.46, 13.48,
        13.38, 13.18, 13.29, 13.22, 13.22, 13.26, 13.23, 13.32, 13.28, 13.24, 13.27, 13.33, 13.33, 13.33,
        13.3, 13.11, 13.05, 13.15, 13.14, 13.13, 13.15, 13.14, 13.1, 13.22, 13.19, 13.14, 13.1, 13.0, 13.12,
        13.15, 13.34, 13.3, 13.27, 13.25, 13.4375, 13.5, 13.4, 13.3, 13.43, 13.205,
    ],
}
SCORES = {
    "Australia": (0.00221928501853181, 0.002737476170287832, 0.06973777462792341, 0.9966554959635682),
    "RGGI": (0.005913327487005617, 0.007822530646379056, 0.07816176470588226, 0.6127387474428543),
}


def test_published_scores(spark, tmp_path):
    """Log files of the naive forecasts, read back and scored, give the published numbers."""
    days = [day("2025-01-01") + dt.timedelta(i) for i in range(100)]
    rows = [(m, "naive_last_price", -1, i, "{}", days[i], days[i], [x[i + 1]], [x[i]], None)
            for m, x in PRICES.items() for i in range(len(x) - 1)]
    logs.write_log_files(spark.createDataFrame(rows, LOG), str(tmp_path / "log"))
    out = metrics.config_scores(metrics.dedupe_log(logs.read_logs(spark, str(tmp_path / "log")))).collect()
    assert {r.market: (r.n_windows, r.n_samples) for r in out} == {m: (68, 68) for m in PRICES}
    for r in out:
        assert (r.MAPE, r.RMSE_over_mean_price, r.MAE, r.R2) == pytest.approx(SCORES[r.market], rel=1e-9)


def test_labelled_csv_layouts(spark, tmp_path):
    """Each file of a folder is read by its own labels."""
    write(tmp_path, "one.csv", ',"t"\nDate,"Rate, EUR",A,B,Secondary Market\n2024-01-02,1,2,3,15\n')
    write(tmp_path, "two more.csv", ',"t"\nDate,Rate,Secondary Market,B,C\n2024-01-03,1,16,3,4\n2024-01-04,1,,3,4\n')
    df = market_files.read_labelled_csv(spark, str(tmp_path), market="market", carry={"B": "b"})
    assert sorted(map(tuple, df.collect())) == [("one", "3", day("2024-01-02"), 15.0), ("two more", "3", day("2024-01-03"), 16.0)]
    write(tmp_path, "three.csv", ',"t"\nDate,Rate,B\n2024-01-03,1,16\n')
    with pytest.raises(ValueError, match="three"):
        market_files.read_labelled_csv(spark, str(tmp_path))


def test_labelled_csv(spark, tmp_path):
    write(tmp_path, "a.csv", ',"Some market",,," "\nDate,"Rate, EUR","Market Currency",'
          '"Secondary Market"," "\n2024-01-02,0.8,USD,15.5," "\n2024-01-03,0.8,USD,," "\n'
          'total,1,,9.0," "\n2024-01-04,0.8,USD,16," "\n')
    df = market_files.read_labelled_csv(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(day("2024-01-02"), 15.5), (day("2024-01-04"), 16.0)]
    with pytest.raises(ValueError):
        market_files.read_labelled_csv(spark, str(tmp_path), value="absent")


def test_two_columns_and_sheet(spark):
    df = spark.createDataFrame([("2024-01-02", "1.5", "z"), ("x", "2", "z"), ("2024-01-03", "", "z")],
                               ["a", "b", "c"])
    assert [tuple(r) for r in market_files.read_two_column(df).collect()] == [(day("2024-01-02"), 1.5)]
    both = spark.createDataFrame([("2024-01-02", "1", "2")], [" Date", "Close", "Adj Close"])
    only = spark.createDataFrame([("2024-01-02", "1")], ["when", "Close "])
    assert market_files.read_price_sheet(both).first().price == 2.0
    assert market_files.read_price_sheet(only).first().price == 1.0


def test_quotes(spark):
    rows = [("t", day("2024-01-02"), 1.0, 2.0, 1), ("t", day("2024-01-02"), 3.0, 4.0, 2), ("u", None, 1.0, 1.0, 3)]
    df = spark.createDataFrame(rows, "ticker string, d date, adj_close double, close double, seq int")
    assert [tuple(r) for r in market_files.quotes_series(df).collect()] == [("t", day("2024-01-02"), 3.0)]
    assert market_files.quotes_series(df.drop("adj_close")).first().price == 4.0
    assert market_files.quotes_series(df, tickers=["u"]).count() == 0


def test_panel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", day("2024-01-05"), 1.0, 2.0), ("m", day("2024-01-06"), 1.0, 2.0),
                                ("m", day("2024-01-08"), -1.0, 2.0), ("n", day("2024-01-09"), 3.0, None)],
                               "market string, d date, Price double, f double")
    panels.write_panel(df, str(tmp_path / "p"))
    assert sorted(os.listdir(tmp_path / "p"))[-2:] == ["market=m", "market=n"]
    got = panels.read_panel(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, got.select("market", "d", "Price", "f").collect())) == [
        ("m", day("2024-01-05"), 1.0, 2.0), ("n", day("2024-01-09"), 3.0, None)]
    write(tmp_path / "c", "x.csv", "Unnamed: 0,Price,f\n2024-01-05,1.5,inf\nbad,2,3\n2024-01-08,x,1\n")
    got = panels.read_panel(spark, str(tmp_path / "c"), format="csv").collect()
    assert [tuple(r) for r in got] == [(day("2024-01-05"), 1.5, None)]
    with pytest.raises(ValueError):
        panels.as_panel(spark.range(1))


def test_panel_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("m", day("2024-01-05"), 1.0, 2.0)], "market string, d date, Price double, f double")
    panels.write_panel(df, str(tmp_path / "p"))
    got = panels.read_panel(spark, str(tmp_path / "p"), "2024-01-01", "2024-02-01") \
        .filter("market = 'm'").select("d", "Price")
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-01-01)" in text and "market" in text.split("PartitionFilters")[1][:60]
    assert "f:double" not in text.split("ReadSchema")[1]


def test_log_round_trip(spark, tmp_path):
    logs.write_log_files(log(spark), str(tmp_path / "l" / "deep"))
    got = logs.read_logs(spark, str(tmp_path / "l"))
    cols = ["market", "model", "config_index", "window_id", "hp_json", "start_date", "y_true", "y_pred"]
    assert sorted(got.select(cols).collect()) == sorted(log(spark).select(cols).collect())


def test_bad_log_files_are_skipped(spark, tmp_path):
    logs.write_log_files(log(spark), str(tmp_path / "good"))
    write(tmp_path / "bad", "b.csv", "market,model_name,config_index\nm,X,1\n")
    got = logs.read_logs(spark, str(tmp_path))
    assert got.count() == 24
    bad = logs.bad_log_files(spark, str(tmp_path)).collect()
    assert len(bad) == 1 and "window_id" in bad[0].missing and bad[0].file.endswith("b.csv")


def test_log_columns_are_found_by_name(spark, tmp_path):
    logs.write_log_files(log(spark), str(tmp_path / "usual"))
    other = logs.to_log_file_columns(log(spark, model="other"))
    other.select(*reversed(other.columns)).write.option("header", True).option("escape", '"') \
         .csv(str(tmp_path / "other"))
    got = logs.read_logs(spark, str(tmp_path))
    cols = ["market", "model", "config_index", "window_id", "hp_json", "y_true", "y_pred"]
    want = log(spark).union(log(spark, model="other"))
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_stream_refuses_another_layout(spark, tmp_path):
    other = logs.to_log_file_columns(log(spark))
    other.select(*reversed(other.columns)).write.option("header", True).csv(str(tmp_path / "in"))
    with pytest.raises(Exception):
        streaming.stream_log_scores(spark, str(tmp_path / "in"), str(tmp_path / "work"))


def test_many_layouts_and_foreign_files(spark, tmp_path):
    """Any number of layouts in one pass over the cells; foreign files give no rows and are listed."""
    names = logs.LOG_FILE_COLUMNS
    cells = {"market": "m", "model_name": "X", "config_index": "1", "model_hyperparameters_dict": "{}",
             "test_data_values_list": '"[1.0, NaN]"', "test_data_model_predictions_list": '"[2.0, 3.0]"', "end_date": "2024-01-05"}
    for i in range(120):
        head = [*names[i % len(names):], *names[:i % len(names)], f"extra{i}"]
        write(tmp_path, f"{i}.csv", ",".join(head) + "\n" + ",".join({**cells, "window_id": str(i)}.get(c, "z") for c in head) + "\n")
    write(tmp_path, "foreign.csv", "id,name,region,code,qty,rank\nEU,zz,3,7,EU,zz\n")
    write(tmp_path, "other.csv", "market,x\nEU,1\n")
    got = logs.read_logs(spark, str(tmp_path))
    text = plan(got)
    rows = got.collect()
    assert sorted(r.window_id for r in rows) == list(range(120))
    assert all((r.market, r.model, r.config_index, r.y_true, r.y_pred) == ("m", "x", 1, [1.0, None], [2.0, 3.0]) for r in rows)
    assert text.count("FileScan csv") == 1 and text.count("FileScan text") == 1
    bad = {os.path.basename(r.file): r.missing for r in logs.bad_log_files(spark, str(tmp_path)).collect()}
    assert set(bad) == {"foreign.csv", "other.csv"} and "market" in bad["foreign.csv"]


def test_single_quoted_log_cells(spark, tmp_path):
    head = ",".join(logs.LOG_FILE_COLUMNS)
    write(tmp_path, "x.csv", head + "\nt,m,m,NAIVE,-1,0,\"{'k': 1}\",2024-01-05 00:00:00,2024-01-05 00:00:00,"
          "[1.5],[oops\nt,m,m,NAIVE,x,1,{},,,[1],[1]\n")
    rows = logs.read_logs(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    assert (rows[0].model, rows[0].hp_json, rows[0].y_true, rows[0].y_pred) == ("naive", '{"k":"1"}', [1.5], [])


def test_append_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(log(spark).filter("config_index = 0"), path)
    todo = log(spark).select("market", "model", "config_index").distinct()
    left = logs.resume_anti(todo, logs.read_log_table(spark, path))
    assert {r.config_index for r in left.collect()} == {1} and left.count() == 2
    logs.append_log(log(spark).filter("config_index = 1"), path)
    assert logs.read_log_table(spark, path).count() == 24
    assert logs.distinct_done(logs.read_log_table(spark, path)).count() == 4
    logs.append_log(log(spark).filter("config_index = 1"), path)  # the same run once more
    twice = logs.read_log_table(spark, path)
    assert metrics.config_scores(metrics.dedupe_log(twice)).agg(F.max("n_windows")).first()[0] == 6


def test_scores_and_best_configs(spark, tmp_path):
    scores = metrics.config_scores(log(spark).union(log(spark, model="tcn", markets="m")))
    results.write_metrics(scores, str(tmp_path / "t"), results.FRONT_TUNING)
    back = results.read_scores(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scores.select(back.columns).collect()))
    best = ranking.best_by_market_model(scores)
    docs = {r.market: json.loads(r.document) for r in results.best_configs_json(best).collect()}
    assert list(docs["m"]["m"]) == ["tcn", "x"]
    assert docs["m"]["m"]["x"]["hyperparams"] == {"a": "b, c", "lr": 0.0001}
    assert list(docs["m"]["m"]["x"]) == sorted(docs["m"]["m"]["x"])
    results.write_best_configs(best, str(tmp_path / "b"))
    again = results.read_best_configs(spark, str(tmp_path / "b"))
    assert sorted((r.market, r.model, r.config_index, r.MAPE) for r in again.collect()) == sorted(
        (r.market, r.model, r.config_index, r.MAPE) for r in best.collect())
    assert again.first().hyperparams == {"a": "b, c", "lr": "0.0001"}
    one = {**docs["m"], **docs["n"]}
    write(tmp_path / "w", "all.json", json.dumps(one, indent=2))
    assert results.read_best_configs(spark, str(tmp_path / "w"), lines=False).count() == 3


def test_nan_cells_become_null(spark, tmp_path):
    cols = results.SCORE_SCHEMA.fieldNames()
    write(tmp_path / "n", "s.csv", ",".join(cols) + "\nm,x,0,1,0.1,0.2,0.3,nan,0.4,5,1,{}\nm,x,1,1,,0.2,0.3,NaN,0.4,5,1,{}\n")
    rows = results.read_scores(spark, str(tmp_path / "n")).orderBy("config_index").collect()
    assert [(r.MAPE, r.R2) for r in rows] == [(0.1, None), (None, None)]


def test_missing_inputs(spark):
    a = spark.createDataFrame([("m",), ("n",)], "market string")
    assert market_files.missing_inputs(a, a.filter("market = 'm'"), ["market"]).collect() == [("n",)]


def test_stream_equals_batch_and_scores_files_once(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    rows = log(spark)
    logs.write_log_files(rows.filter("window_id < 3").repartition(4), source)
    first = streaming.stream_log_scores(spark, source, work, max_files=1)
    want = metrics.forecast_metrics(metrics.log_pairs(rows.filter("window_id < 3")), KEYS)
    key = lambda df: sorted((r.market, r.model, r.config_index, round(r.MAPE, 12), round(r.R2, 12), r.n_samples)
                            for r in df.collect())
    assert key(first) == key(want)
    logs.write_log_files(rows.filter("window_id >= 3"), source)
    again = streaming.stream_log_scores(spark, source, work)
    again = streaming.stream_log_scores(spark, source, work)  # nothing new
    assert key(again) == key(metrics.forecast_metrics(metrics.log_pairs(rows), KEYS))
    scores = {r.config_index: r for r in again.collect()}
    assert scores[0].n_windows == 6 and json.loads(scores[0].hyperparams_json)["lr"] == 0.0001


def test_stream_counts_a_window_once(spark, tmp_path):
    """A window that a later file logs again replaces the earlier one, as in the batch job."""
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    wrong = log(spark).withColumn("y_pred", F.transform("y_pred", lambda p: p * 9))
    logs.write_log_files(wrong, source)
    streaming.stream_log_scores(spark, source, work)
    time.sleep(0.02)
    logs.write_log_files(log(spark), source)
    got = streaming.stream_log_scores(spark, source, work)
    want = metrics.config_scores(metrics.dedupe_log(logs.read_logs(spark, source)))
    names = ["market", "model", "config_index", "n_windows", "n_samples", "hyperparams_json"]
    key = lambda df: sorted((*(r[c] for c in names), *(round(r[m], 10) for m in ("MAPE", "MAE", "RMSE", "R2")))
                            for r in df.collect())
    assert key(got) == key(want) == key(metrics.config_scores(log(spark).withColumn(
        "hp_json", F.lit('{"a":"b, c","lr":"0.0001"}'))).withColumn("hyperparams_json", F.lit(want.first().hyperparams_json)))


def test_shared_folder_comes_from_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_folder(spark).startswith(given)
    session.stored(spark.range(3), "x")
    assert any(os.scandir(given))
    session.clear_scratch(spark)
    assert not os.path.exists(session.shared_folder(spark))
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")


def test_files_that_are_passed_over(spark, tmp_path):
    """Every file without a price, why, and how many of its rows begin with a date."""
    write(tmp_path / "a", "one.csv", "title\nDate,Secondary Market\n2024-01-02,1\n2024-01-03,2\n")
    write(tmp_path / "a", "two.csv", "Date,x,Secondary Market\n2024-01-02,0,1\n")
    write(tmp_path / "a", "rest.csv", "2024-01-04,5\n2024-01-05,6\n")
    write(tmp_path / "b", "one.csv", "Date,Secondary Market\n2024-01-02,1\n")
    write(tmp_path / "b", "part.csv", "2024-01-04,5\n")
    write(tmp_path / "b", "words.csv", "hello,world\n")
    write(tmp_path / "b", "empty.csv", "")
    write(tmp_path / "b", "prices gone.csv", "2024-01-04,n/a\n")
    write(tmp_path / "c", "alone.csv", "2024-01-04,5\n")
    write(tmp_path / "d", "lacks.csv", "Date,Other\n2024-01-04,5\n")
    got = {os.path.basename(r.file): (r.reason, r.n_rows) for r in market_files.passed_over_files(spark, str(tmp_path)).collect()}
    assert got == {
        "rest.csv": ("no label row, and those of its folder differ", 2), "words.csv": ("no row begins with a date", 0),
        "prices%20gone.csv": ("no row has a price", 1), "alone.csv": ("no label row in its folder", 1),
        "lacks.csv": ("label row without all of the columns", 1)}
    os.remove(tmp_path / "d" / "lacks.csv")
    assert market_files.read_labelled_csv(spark, str(tmp_path)).count() == 5


def test_rows_of_market_files_stay_where_they_are_read(spark, tmp_path):
    """Two files: the rows are not dealt by file or folder, by which two tasks would get them all."""
    for i, head in enumerate(("Date,Secondary Market", "Date,x,Secondary Market")):
        write(tmp_path / str(i), "a.csv", f"{head}\n2024-01-0{i + 1},{',' * i}{i + 5}\n")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = market_files.read_labelled_csv(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(got)
        assert sorted((str(r.d), r.price) for r in got.collect()) == [("2024-01-01", 5.0), ("2024-01-02", 6.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_files_of_a_layout_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).selectExpr("concat(date_add(date '2024-01-01', int(id)), ',', id + 1) AS value")
    registry.labelled_lines(rows, ',"Title"\nDate,Secondary Market').write.text(str(tmp_path / "in"))
    files = [p.read_text() for p in (tmp_path / "in").iterdir() if p.name.startswith("part")]
    assert len(files) == 4 and all(f.startswith(',"Title"\nDate,Secondary Market\n2024') for f in files)
    assert market_files.read_labelled_csv(spark, str(tmp_path / "in")).count() == 40


def test_poor_log_files_are_written_by_many_tasks(spark, sf, monkeypatch):
    """Every task writes its own poor files; each is found."""
    found = []
    kept = logs.bad_log_files
    monkeypatch.setattr(logs, "bad_log_files", lambda *a: found.append(kept(*a).count()) or kept(*a))
    assert registry.QUERIES["bad_log_files"](spark, sf).count() == 7
    assert found[0] > 1
