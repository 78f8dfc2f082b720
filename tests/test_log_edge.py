"""Logs by way of a table, of files and of a stream: equal scores, equal failures, whatever was logged again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import day, plan
from tidemark.functions.parsing import hp_json, parse_dict, parse_list
from tidemark.operators import metrics
from tidemark.operators.clean import dedupe_last
from tidemark.session import remove_folder
from tidemark.sources import logs
from tidemark.streaming import scores as streaming
from workload import fixtures, registry

LOG = ("market string, model string, config_index int, window_id long, hp_json string, start_date date, end_date date, "
       "y_true array<double>, y_pred array<double>, error string, run_seq long")
D = day("2024-01-05")
NAMES = ["market", "model", "config_index", "n_windows", "n_samples", "hyperparams_json"]


def frame(spark, rows):
    """Rows of config, window, truth, forecast, error and run."""
    return spark.createDataFrame([("m", "x", c, w, f'{{"c":"{c}"}}', D, D, t, p, e, s) for c, w, t, p, e, s in rows], LOG)


def scores(df):
    return sorted((*(r[c] for c in NAMES), *(None if r[m] is None else round(r[m], 9) for m in ("MAPE", "MAE", "RMSE", "R2", "mean_price")))
                  for r in df.collect())


def failures(df):
    return sorted((r.config_index, r.n_windows, r.n_failed) for r in df.collect())


def first_run():
    """Config 0 fails three windows of four and is right in the last, 1 is well, 2 falls short once, 3 will be mended."""
    rows = [(0, w, [1.0 + w], None, "late", 1) for w in range(3)] + [(0, 3, [4.0], [4.0], None, 1)]
    rows += [(1, w, [2.0, 3.0 + w], [2.5, 3.0], None, 1) for w in range(4)]
    rows += [(2, w, [2.0, 3.0], [2.5, 3.0] if w else [2.5], None if w else "short", 1) for w in range(4)]
    rows += [(3, w, [5.0 + w], [9.0], "late" if w == 2 else None, 1) for w in range(4)]
    return [(c, w, t, None if e == "late" else p, e, s) for c, w, t, p, e, s in rows]


def second_run():
    """Lower forecasts than those of the first run, which must count nevertheless, and new windows."""
    rows = [(1, w, [2.0, 3.0 + w], [-2.5, -3.0], None, 2) for w in (1, 2)]
    rows += [(3, w, [5.0 + w], [4.0], None, 2) for w in range(6)]
    return rows + [(0, 4, [1.0], [1.0], None, 2), (4, 7, [1.0], [1.5], None, 2)]


def test_three_ways_agree(spark, tmp_path):
    rows = frame(spark, first_run() + second_run())
    table = metrics.dedupe_log(rows)
    logs.write_log_files(rows.coalesce(1).sortWithinPartitions("run_seq"), str(tmp_path / "in"))
    files = metrics.dedupe_log(logs.read_logs(spark, str(tmp_path / "in")))
    stream = streaming.stream_log_scores(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert scores(metrics.config_scores(table)) == scores(metrics.config_scores(files)) == scores(stream)
    assert [r[2] for r in scores(stream)] == [1, 3, 4]
    assert failures(metrics.unscored_runs(table)) == failures(metrics.unscored_runs(files)) == [(0, 5, 3), (2, 4, 1)]
    assert {r.reason.split(": ")[1] for r in metrics.unscored_runs(files).collect()} == {"0 of 1 forecasts", "1 of 2 forecasts"}


def test_the_later_line_counts_for_any_split(spark, tmp_path):
    """Each window ten times in one file that is read in many pieces, by one task or by several."""
    rows = [(c, w, [10.0], [float(100 - k)], None, k) for k in range(10) for c in range(3) for w in range(60)]
    logs.write_log_files(frame(spark, rows).coalesce(1).sortWithinPartitions("run_seq"), str(tmp_path / "in"))
    size = max(os.path.getsize(e) for e in os.scandir(tmp_path / "in") if e.name.endswith(".csv"))
    pieces = []
    for split in (size * 2, size // 3, 4096):
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            got = logs.read_logs(spark, str(tmp_path / "in"))
            pieces.append(got.select("line.block").distinct().count())
            assert {r.y_pred[0] for r in metrics.dedupe_log(got).collect()} == {91.0}
            work = str(tmp_path / f"work{split}")
            assert {r.MAE for r in streaming.stream_log_scores(spark, str(tmp_path / "in"), work).collect()} == {81.0}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert pieces[0] == 1 and 2 <= pieces[1] <= 4 and pieces[2] > 10


def test_one_unit_of_time(spark, tmp_path):
    """A file that is newer than an appended table counts before it."""
    old, new = frame(spark, [(0, 0, [1.0], [2.0], None, None)]), frame(spark, [(0, 0, [1.0], [5.0], None, None)])
    logs.append_log(old, str(tmp_path / "table"))
    time.sleep(0.05)
    logs.write_log_files(new, str(tmp_path / "in"))
    both = logs.read_log_table(spark, str(tmp_path / "table")).unionByName(logs.read_logs(spark, str(tmp_path / "in")), allowMissingColumns=True)
    assert metrics.dedupe_log(both).first().y_pred == [5.0]


def batches(spark):
    """New windows, windows logged again with failures mended and made, an older run that comes late, gaps that close."""
    return [frame(spark, first_run()), frame(spark, second_run()),
            frame(spark, [(1, 9, [2.0, 1.0], [2.5, 3.0], None, 3), (4, 3, [8.0], [2.0], None, 3)]),
            frame(spark, [(4, 7, [1.0], None, "late", 4), (5, 0, [7.0], [7.0], None, 4)]),
            frame(spark, [(4, 7, [1.0], [99.0], None, 2), (1, 5, [1e9], [1.0], None, 4), (0, 0, [1.0], [3.0], None, 5),
                          (0, 1, [1.0], [3.0], None, 5), (0, 2, [1.0], [3.0], None, 5)])]


def test_merged_batches_equal_the_whole_log(spark, tmp_path):
    seen, table = None, str(tmp_path / "t")
    for k, batch in enumerate(batches(spark)):
        streaming.merge_batch(batch, k, table)
        seen = batch if seen is None else seen.unionByName(batch)
        want = metrics.config_scores(metrics.dedupe_log(seen))
        assert scores(streaming.current_scores(spark, table)) == scores(want)
    assert len(streaming.versions(spark, table)) <= 2
    assert [r[2] for r in scores(want)] == [0, 1, 3, 5]


@pytest.mark.parametrize("broken", ["windows", "configs"])
def test_a_batch_that_is_run_again(spark, tmp_path, broken, monkeypatch):
    """A batch that ended half-way is run again under its number, and one that was whole comes to the same."""
    table, all_batches = str(tmp_path / "t"), batches(spark)
    for k, batch in enumerate(all_batches[:3]):
        streaming.merge_batch(batch, k, table)
    before = scores(streaming.current_scores(spark, table))
    if broken == "configs":  # ended after its windows were written
        monkeypatch.setattr(streaming, "versions", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            streaming.merge_batch(all_batches[3], 3, table)
        monkeypatch.undo()
    else:
        streaming.merge_batch(all_batches[3], 3, table)
        os.remove(f"{table}/configs/3/_SUCCESS")
    assert scores(streaming.current_scores(spark, table)) == before
    streaming.merge_batch(all_batches[3], 3, table)
    streaming.merge_batch(all_batches[4], 4, table)
    want = scores(metrics.config_scores(metrics.dedupe_log(
        all_batches[0].unionByName(all_batches[1]).unionByName(all_batches[2]).unionByName(all_batches[3]).unionByName(all_batches[4]))))
    assert scores(streaming.current_scores(spark, table)) == want


def test_new_windows_alone_open_no_earlier_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    a = frame(spark, [(c, w, [1.0 + w], [2.0], None, 1) for c in range(3) for w in range(5)])
    b = frame(spark, [(c, w, [1.0 + w], [3.0], None, 2) for c in range(4) for w in range(5, 9)])
    streaming.merge_batch(a, 0, table)
    for e in os.scandir(f"{table}/windows/batch=0"):
        if e.name.startswith("bucket="):
            remove_folder(spark, e.path)
    streaming.merge_batch(b, 1, table)
    assert scores(streaming.current_scores(spark, table)) == scores(metrics.config_scores(a.unionByName(b)))


def test_restart_of_the_stream(spark, tmp_path):
    """Files in several rounds of one checkpoint, with failures and re-runs between them."""
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for batch in (first_run(), second_run(), [(0, w, [1.0 + w], [3.0], None, 3) for w in range(3)]):
        logs.write_log_files(frame(spark, batch).coalesce(2), source)
        got = streaming.stream_log_scores(spark, source, work, max_files=1)
        time.sleep(0.05)
    want = metrics.config_scores(metrics.dedupe_log(logs.read_logs(spark, source)))
    assert scores(got) == scores(want) and [r[2] for r in scores(got)] == [0, 1, 3, 4]
    with pytest.raises(ValueError):
        streaming.current_scores(spark, str(tmp_path / "none"))


def test_order_is_carried_once(spark):
    """Several order columns and several values: one struct in the buffer, the last row by all of the order."""
    rows = frame(spark, first_run() + second_run())
    last = metrics.dedupe_log(rows)
    assert plan(last).count("max_by(") == 0
    got = sorted((r.config_index, r.window_id, r.y_pred, r.error) for r in last.collect())
    best = {}
    for c, w, _, p, e, s in first_run() + second_run():
        if s >= best.get((c, w), (None, None, 0))[2]:
            best[c, w] = p, e, s
    assert got == sorted((c, w, p, e) for (c, w), (p, e, _) in best.items())


def test_order_of_rows_with_a_map(spark):
    """A map has no order: it comes with the last row nevertheless."""
    rows = spark.sql("SELECT * FROM VALUES (1, 1, 2, map('a', 1)), (1, 2, 1, map('a', 2)), (1, 1, 3, map('a', 3)) AS t(k, s, r, m)")
    assert dedupe_last(rows, ["k"], ["s", "r"], ["m", "r"]).collect() == [(1, {"a": 2}, 1)]


def test_rows_of_log_files_stay_where_they_are_read(spark, tmp_path):
    """One file or few: the rows are not dealt by their file, by which a few tasks would get them all."""
    logs.write_log_files(frame(spark, first_run()).coalesce(1), str(tmp_path), compression="gzip")
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("part")][0].endswith(".gz")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = logs.read_logs(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan(got) and got.count() == len(first_run())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tasks_of_the_line_log_are_bounded(spark, sf, tmp_path, monkeypatch):
    """As many tasks as the lines ask for, each config in one of them and in one file."""
    monkeypatch.setattr(fixtures, "TASK_ROWS", 300)
    log = fixtures.line_log(spark, sf)
    assert log.rdd.getNumPartitions() == 20
    assert log.withColumn("p", F.spark_partition_id()).groupBy(*metrics.CONFIG_KEYS) \
              .agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty()
    registry.as_log_files(log, str(tmp_path))
    names = logs.log_file_headers(spark, str(tmp_path))
    assert names.count() > 8 and names.filter(F.size("missing") > 0).isEmpty()


def test_touched_configs_are_dealt_once(spark):
    """Summed up anew: a config that logs a known window again, not one whose known windows were logged twice before."""
    partials = lambda rows: metrics.window_partials(frame(spark, rows))
    old = partials([(0, w, [2.0], [3.0], None, 1) for w in range(3)] + [(0, 1, [2.0], [4.0], None, 2)]
                   + [(1, w, [5.0], [7.0], None, 1) for w in range(3)])
    new = partials([(0, 5, [2.0], [2.5], None, 3), (1, 1, [5.0], [5.0], None, 3), (2, 0, [1.0], [1.0], None, 3)])
    touched = metrics.touched_partials(old, new)
    got = sorted((r.config_index, r.window_id, r.ae, r.again) for r in touched.collect())
    assert got == [(0, 5, 0.5, False), (1, 0, 2.0, True), (1, 1, 0.0, True), (1, 2, 2.0, True), (2, 0, 0.0, False)]
    states = metrics.config_states(touched, "again")
    assert plan(states).count("Exchange hashpartitioning") == 1
    known = metrics.config_states(metrics.latest_partials(old))
    after = {r.config_index: (r.n_windows, r.ae) for r in metrics.joined_states(known, states).collect()}
    assert after == {0: (4, 4.5), 1: (3, 4.0), 2: (1, 0.0)}


def test_windows_of_a_batch_are_dealt_once(spark):
    rows = metrics.latest_partials(streaming.dealt(metrics.window_partials(frame(spark, first_run() + second_run()))), "bucket", "slice")
    assert plan(rows).count("Exchange hashpartitioning") == 1 and "max_by" not in plan(rows)
    assert rows.groupBy(*metrics.CONFIG_KEYS).agg(F.count_distinct("bucket", "slice").alias("n")).filter("n > 1").isEmpty()


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    logs.write_log_files(frame(spark, first_run()).coalesce(1), str(tmp_path / "good"))
    (tmp_path / "poor.csv").write_text("market,model_name,z\nm,x,1\n")
    (tmp_path / "none.csv").write_text("1,2\n3,4\n")
    heads = logs.log_file_headers(spark, str(tmp_path))
    assert "Sort" not in plan(heads).split("Exchange")[-1]
    got = sorted((r.file.rsplit("/", 1)[1][:4], len(r.columns or []), len(r.missing)) for r in heads.collect())
    assert got == [("none", 0, len(logs.LOG_REQUIRED)), ("part", 11, 0), ("poor", 3, len(logs.LOG_REQUIRED) - 2)]


def test_rows_of_a_batch_are_dealt_once_to_tasks_by_their_size(spark, tmp_path, monkeypatch):
    """Rows are written where they are parsed, a repeated window too, and dealt when configs are summed up from them."""
    rows = frame(spark, first_run() + second_run())
    monkeypatch.setattr(streaming, "dealt", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        streaming.merge_batch(rows, 0, str(tmp_path / "t"))
    monkeypatch.undo()
    written = spark.read.parquet(str(tmp_path / "t/windows/batch=0"))
    assert written.count() == rows.count() > metrics.latest_partials(written).count()
    partials = metrics.window_partials(rows)
    assert streaming.tasks_for(spark, 100) is None and streaming.tasks_for(spark, 9 * streaming.TASK_BYTES - 1) == 9
    assert streaming.dealt(partials, 9).rdd.getNumPartitions() == 9
    assert metrics.touched_partials(partials, partials, 9).rdd.getNumPartitions() == 9


def test_many_tasks_come_to_the_same_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "TASK_BYTES", 1 << 10)
    seen = None
    for k, batch in enumerate(batches(spark)[:3]):
        streaming.merge_batch(batch, k, str(tmp_path / "t"))
        seen = batch if seen is None else seen.unionByName(batch)
    assert scores(streaming.current_scores(spark, str(tmp_path / "t"))) == scores(metrics.config_scores(metrics.dedupe_log(seen)))


def test_windows_are_summed_up_before_they_are_dealt(spark):
    """Also where windows differ in length and text, some without a forecast; the text of the first window stays."""
    rows = [(0, w, [100.0 + w, 90.0 - w * w, 7.0][:w % 4], [1.0, 2.0, 3.0][:w % 4], None, 1) for w in range(40)] + [(1, 3, [5.0], [5.0], None, 1)]
    log = frame(spark, rows).withColumn("hp_json", F.when(F.col("window_id") < 2, F.lit("{}")).otherwise(F.col("hp_json")))
    states = metrics.config_states(metrics.window_partials(log))
    below = plan(states).split("Exchange")[-1]
    assert "HashAggregate" in below and "Sort" not in below and "Window" not in below
    got = {r.config_index: r for r in states.collect()}
    truth = [t for c, _, ts, *_ in rows if c == 0 for t in ts]
    mean = sum(truth) / len(truth)
    assert (got[0].n, got[0].n_windows, got[0].hp_json, got[0].first_window, got[0].last_window) == (len(truth), 40, "{}", 0, 39)
    assert got[0].mean == pytest.approx(mean) and got[0].m2 == pytest.approx(sum((t - mean) ** 2 for t in truth))
    assert (got[1].n, got[1].mean, got[1].m2, got[1].hp_json) == (1, 5.0, 0.0, '{"c":"1"}')


def test_late_configs_are_seen_from_a_row_each(spark):
    """New windows before, after, within and on both sides of the known ones; no window is joined with the configs."""
    known = metrics.config_states(metrics.window_partials(frame(spark, [(c, w, [1.0], [1.0], None, 1) for c in range(4) for w in (5, 9)])))
    new = streaming.bucketed(metrics.window_partials(frame(spark, [(c, w, [1.0], [1.0], None, 2) for c, w in [(0, 4), (1, 10), (2, 7), (3, 1), (3, 12), (9, 7)]])))
    bucket = {r.config_index: r.bucket for r in new.collect()}
    assert set(streaming.late_buckets(new.filter("config_index IN (0, 1, 9)"), known)) == set()
    assert set(streaming.late_buckets(new, known)) == {bucket[2], bucket[3]}


def test_cells_read_together_are_as_those_read_alone(spark):
    """Lists and config texts that are whole, odd, cut short or go on: each comes out the same beside any other."""
    lists = ["[1.5]", " [1, -2.5e3 ] ", "[]", "[1,null]", "[NaN]", "[1,,2]", "[01]", "[1e999]", "[nul]", "[1] x", '[1],"p":[9]', "[[1]]", '["a"]', "1", "", None]
    texts = ['{"a": 0.0001}', "{'a': 1}", '{"a":1', '{"a":1}}', '{"a":"b}', '{"a":"b"},"t":[7]', '{"a":{"b":1}}', '{"a":1,"a":2}', '{"a" 1}', "{}", None]
    cells = [("m", "X", "1", "2", h, "2024-01-05", "2024-01-05", t, p) for h in texts for t in lists for p in lists]
    names = ["market", "model_name", "config_index", "window_id", "model_hyperparameters_dict", "start_date", "end_date",
             "test_data_values_list", "test_data_model_predictions_list"]
    raw = spark.createDataFrame(cells, ", ".join(f"{c} string" for c in names)).withColumn("run_seq", F.lit(1))
    keep = raw.withColumn("line", F.struct(*names[4:5], *names[7:]))
    got = {tuple(r.line): (r.hp_json, r.y_true, r.y_pred) for r in logs.from_log_file_columns(keep).collect()}
    alone = lambda column, values: dict(spark.createDataFrame([(v,) for v in values], "v string").select("v", column).collect())
    text = F.coalesce(F.trim("v"), F.lit("{}"))
    whole = F.when(F.from_json(text, "map<string,string>").isNotNull() & text.startswith('{"'), text)
    hp, numbers = alone(F.coalesce(whole, hp_json(parse_dict("v"))), texts), alone(parse_list("v"), lists)
    assert got == {(h, t, p): (hp[h], numbers[t], numbers[p]) for h in texts for t in lists for p in lists}
    assert numbers["[1,null]"] == [1.0, None] and hp['{"a": 0.0001}'] == '{"a": 0.0001}'
    assert logs.from_log_file_columns(raw)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
