"""Prediction logs: Parquet inside, the 11-column CSV form at the edge; resuming a run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.functions.parsing import hp_json, parse_dict, parse_list
from tidemark.functions.values import date_coerce, finite, model_name_case
from tidemark.operators.metrics import run_states
from tidemark.schema import LOG_FILE_COLUMNS, LOG_REQUIRED, LOG_SCHEMA
from tidemark.session import folder_names, read_text, remove_folder, write_new


def append_log(log: DataFrame, path: str, run_seq: int | None = None) -> None:
    """One append per run, one folder per (model, market); never one write per window.

    Every row gets the sequence number of the run, by default the time in microseconds, the unit of the
    times of log files; it decides between windows that were logged twice.

    Rows are written to a folder of this attempt, which readers pass over until the run is entered in the
    manifest.  So an append that ended half-way leaves nothing to be seen, one that is repeated under the
    same number changes nothing, and of two at a time one counts.
    """
    spark = log.sparkSession
    seq = time.time_ns() // 1000 if run_seq is None else run_seq
    if str(seq) in folder_names(spark, f"{path}/{MANIFEST}"):
        return
    attempt = f"{seq}-{uuid.uuid4().hex}"
    log.withColumn("run_seq", F.lit(seq).cast("long")) \
       .select(*[c for c in LOG_SCHEMA.fieldNames() if c in (*log.columns, "run_seq")]) \
       .write.partitionBy("model", "market").parquet(f"{path}/attempt={attempt}")
    write_new(spark, f"{path}/{MANIFEST}/{seq}", attempt)


#: The folder with one file per finished run, which holds the name of its attempt; Spark passes over such a name.
MANIFEST = "_runs"


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished runs, and those of a table that was written without a manifest."""
    done = [read_text(spark, f"{path}/{MANIFEST}/{n}") for n in folder_names(spark, f"{path}/{MANIFEST}") if n.isdigit()]
    older = [n for n in folder_names(spark, path) if n.startswith("model=")]
    parts = [names for names in ([f"attempt={a}" for a in done], older) if names]
    if not parts:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    tables = [spark.read.schema(LOG_SCHEMA).option("basePath", path).parquet(*[f"{path}/{n}" for n in names])
              .select(*LOG_SCHEMA.fieldNames()) for names in parts]
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def clear_attempts(spark: SparkSession, path: str) -> list[str]:
    """Remove what attempts left that were never finished, while no append is under way; returns their names."""
    done = {f"attempt={read_text(spark, f'{path}/{MANIFEST}/{n}')}"
            for n in folder_names(spark, f"{path}/{MANIFEST}") if n.isdigit()}
    left = [n for n in folder_names(spark, path) if n.startswith("attempt=") and n not in done]
    for name in left:
        remove_folder(spark, f"{path}/{name}")
    return left


def to_log_file_columns(log: DataFrame, timeframe: str = "daily") -> DataFrame:
    """The log as flat text cells, lists as JSON."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return log.select(
        F.lit(timeframe).alias("timeframe"), F.col("market").alias("ticker"), "market",
        model_name_case("model", upper=True).alias("model_name"), "config_index", "window_id",
        F.col("hp_json").alias("model_hyperparameters_dict"),
        stamp("start_date").alias("start_date"), stamp("end_date").alias("end_date"),
        F.to_json("y_true").alias("test_data_values_list"),
        F.to_json("y_pred").alias("test_data_model_predictions_list"))


def write_log_files(log: DataFrame, path: str, timeframe: str = "daily", compression: str = "none") -> None:
    to_log_file_columns(log, timeframe).select(*LOG_FILE_COLUMNS) \
        .write.mode("append").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def missing_forecasts(truth: Column, forecast: Column) -> Column:
    """The failure that a log row shows by its lists: fewer forecasts than days.

    Log files have no cell for the error of a window, and a window without forecasts must not make the
    others of its config look better.
    """
    n, m = F.size(truth), F.greatest(F.size(F.coalesce(forecast, F.array().cast("array<double>"))), F.lit(0))
    return F.when((n > 0) & (m < n), F.concat(m, F.lit(" of "), n, F.lit(" forecasts")))


def with_line(rows: DataFrame) -> DataFrame:
    """Adds ``line``, which orders the rows of a file as they lie in it, however the file was split.

    ``block`` says where the split of a row starts.  A task reads a split from its start, so its rows come in
    order; rows must not have been shuffled since they were read.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("line", F.struct("block", row.alias("row")))


#: Cells that stand side by side in one JSON document as they do alone: lists of numbers and nulls, a flat object.
PLAIN_CELLS = r'^\[[-+0-9.eEnul, ]*\]\n\[[-+0-9.eEnul, ]*\]\n\{"[^{}\[\]\n]*\}\z'


def from_log_file_columns(rows: DataFrame) -> DataFrame:
    """Flat text cells back to typed columns.  The config text is kept as it was written: it is
    a join key, and spelling it anew could split one config in two.  ``error`` is what the lists show.

    A JSON reader costs more to set up than a cell takes to read, so the three cells of a row are read by one where
    that comes to the same; each of the others is read by itself.  Of the config text only whether it can be read is
    asked, so its values are passed over.
    """
    text = F.coalesce(F.trim(F.col("model_hyperparameters_dict")), F.lit("{}"))
    truth, forecast = F.trim(F.col("test_data_values_list")), F.trim(F.col("test_data_model_predictions_list"))
    plain = F.concat_ws("\n", truth, forecast, text).rlike(PLAIN_CELLS)
    one = F.concat(F.lit('{"t":'), truth, F.lit(',"p":'), forecast, F.lit(',"h":'), text, F.lit("}"))
    kind = "t array<double>, p array<double>, h struct<_:string>"
    rows = rows.withColumn("read", F.when(plain, F.from_json(one, kind)))
    read = F.col("read")
    whole = F.when((read["h"].isNotNull() | F.from_json(text, "map<string,string>").isNotNull())
                   & text.startswith('{"'), text)
    listed = lambda name, cell: F.coalesce(F.transform(read[name], finite), parse_list(cell))
    return rows.select(
        "market", model_name_case("model_name").alias("model"),
        F.col("config_index").try_cast("int").alias("config_index"),
        F.col("window_id").try_cast("bigint").alias("window_id"),
        F.coalesce(whole, hp_json(parse_dict("model_hyperparameters_dict"))).alias("hp_json"),
        date_coerce(F.substring("start_date", 1, 10)).alias("start_date"),
        date_coerce(F.substring("end_date", 1, 10)).alias("end_date"),
        listed("t", "test_data_values_list").alias("y_true"),
        listed("p", "test_data_model_predictions_list").alias("y_pred"),
        F.lit(None).cast("double").alias("train_loss"), "run_seq",
        *(c for c in ("line", "block") if c in rows.columns)) \
        .withColumn("error", missing_forecasts(F.col("y_true"), F.col("y_pred")))


def log_file_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per file the names in its first line, which only the block that starts the file can hold,
    and the required names it lacks.  A file without any known name lacks all of them.  Lines that are no header are
    all alike, so a task keeps few rows and sorts none of its lines."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    names = F.transform(F.split("value", ","), lambda c: F.trim(F.translate(c, '"\r\ufeff', "")))
    known = F.size(F.array_intersect(names, F.array(*[F.lit(c) for c in LOG_FILE_COLUMNS])))
    head = F.when((F.col("block") == 0) & F.col("value").contains("market") & (known >= 2), names)
    required = F.array(*[F.lit(c) for c in LOG_REQUIRED])
    alike = lines.groupBy("file", head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    found = alike.groupBy("file").agg(F.min(F.when(F.col("n") > 0, F.col("head"))).alias("columns"))
    return found.select("file", "columns", F.array_except(
        required, F.coalesce("columns", F.array().cast("array<string>"))).alias("missing"))


def bad_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file that ``read_logs`` passes over, with the columns it lacks."""
    return log_file_headers(spark, path).filter(F.size("missing") > 0) \
        .select("file", F.concat_ws(",", "missing").alias("missing"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every log file under a folder, at any depth, its columns found by name.

    One pass finds the header of each file, one pass reads the cells of all files by position, and
    each row looks up by its file where the columns are: the cost does not depend on how many
    layouts there are.  Only files with all required columns take part (``bad_log_files`` lists the
    others).  There is one header per file, as there is one listed file on the driver, so the headers go to every task
    and the rows stay where they were read, however large a file is.  The time of the file is the ``run_seq`` of its rows and ``line`` their place in it: a re-run that was
    appended to the same file counts, not the rows above it.
    """
    heads = log_file_headers(spark, path).filter(F.size("missing") == 0)
    width = heads.agg(F.max(F.size("columns"))).first()[0]
    if width is None:
        raise ValueError(f"{path}: no file with all columns")
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = spark.read.schema(cells).option("recursiveFileLookup", True).option("header", False) \
        .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path) \
        .select(F.array(*cells.fieldNames()).alias("cells"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.unix_micros("_metadata.file_modification_time").alias("run_seq"))
    rows = with_line(rows)
    place = F.transform(F.array(*[F.lit(c) for c in LOG_FILE_COLUMNS]),
                        lambda c: F.array_position("columns", c))
    rows = rows.join(F.broadcast(heads.select("file", place.alias("place"))), "file")
    named = rows.select("run_seq", "line", *[
        F.when(F.col("place")[i] > 0, F.try_element_at("cells", F.col("place")[i].cast("int"))).alias(c)
        for i, c in enumerate(LOG_FILE_COLUMNS)])
    return from_log_file_columns(named).filter(
        F.col("market").isNotNull() & F.col("model").isNotNull()
        & F.col("config_index").isNotNull() & F.col("window_id").isNotNull())


def distinct_done(log: DataFrame, keys: Sequence[str] = ("market", "model", "config_index")
                  ) -> DataFrame:
    return log.select(*keys).filter(F.col("config_index").isNotNull()).distinct()


def resume_anti(todo: DataFrame, log: DataFrame,
                keys: Sequence[str] = ("market", "model", "config_index"),
                expected: DataFrame | None = None) -> DataFrame:
    """What is still to run: configs (or pairs) that the log does not hold in full.

    A run with a failed window is not done, nor is one with fewer windows than ``expected``
    (``market``, ``n_expected``) says.  Give a log in which each window counts once.  The done keys
    are reduced to distinct ones first, so a config with many windows joins as one row.  ``expected`` has one
    row per market and is broadcast: dealt by market, all runs of a market would lie in one task.
    """
    if expected is not None:
        whole = run_states(log).join(F.broadcast(expected), "market").filter("n_windows >= n_expected")
        return todo.join(whole.filter("n_failed = 0").select(*keys).distinct(), list(keys), "left_anti")
    done = log.select(*keys).distinct()
    if "error" in log.columns:
        done = log.groupBy(*keys).agg(F.count("error").alias("n_failed")).filter("n_failed = 0")
    return todo.join(done.select(*keys), list(keys), "left_anti")


def missing_windows(todo: DataFrame, log: DataFrame, expected: DataFrame,
                    keys: Sequence[str] = ("market", "model", "config_index")) -> DataFrame:
    """The windows that the runs of ``todo`` lack or that failed, as intervals ``first``..``last``.

    Give a log in which each window counts once; ``expected`` has ``n_expected`` windows per market, one row each, and
    is broadcast.  The end of a run counts as one more window, so every gap lies before a window.  A run has at most as many windows as its
    market has days, which bounds the window over it.
    """
    ends = todo.select(*keys).distinct().join(F.broadcast(expected), "market")
    good = log.filter("error IS NULL") if "error" in log.columns else log
    good = good.select(*keys, "window_id").join(ends, list(keys)).filter("window_id >= 0 AND window_id < n_expected")
    marks = good.select(*keys, "window_id").unionByName(ends.select(*keys, F.col("n_expected").cast("bigint").alias("window_id")))
    before = F.lag("window_id", 1, -1).over(Window.partitionBy(*keys).orderBy("window_id"))
    return marks.select(*keys, (before + 1).alias("first"), (F.col("window_id") - 1).alias("last")).filter("first <= last")
