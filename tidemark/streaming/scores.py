"""Scores kept current while log files arrive.

A table folder holds two things, both written by the batch that they come from:

* ``windows/batch=K/bucket=B``: one narrow row of partial sums per log row of batch K, by a hash of its config,
* ``configs/K``: one row per config after batch K, what its windows add up to and the range of their numbers.

The rows of a batch are written where they are parsed; they are dealt to tasks once, when configs are summed up from
them, which also leaves each window once.  There are as many tasks as the written windows ask for.

A batch merges the sums of its new windows into the rows of the configs: work in proportion to configs and
new windows.  Only windows that lie within the range a config has already may have been logged before; the windows of
such configs are looked up, in their buckets, and a config that did log one again is summed up anew from
its windows, so that what it replaced is gone whole.

A batch writes folders of its own number and reads those of smaller ones.  If it is run again after a failure or a
restart it overwrites what it had written and comes to the same rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.metrics import (
    CONFIG_KEYS, SUMS, config_states, joined_states, latest_partials, state_scores, touched_partials, window_partials)
from tidemark.schema import LOG_FILE_COLUMNS, LOG_SCHEMA
from tidemark.session import folder_bytes, folder_names, remove_folder
from tidemark.sources.logs import from_log_file_columns, with_line

BUCKETS, SLICES = 64, 4096
TASK_BYTES = 16 << 20  # of written windows, about 350,000 of them
#: Numbers that differ from row to row are written as they are: looking them up in a dictionary costs more than the rest of the writing.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("window_id", "line.row", "mean", "m2", *SUMS, "low", "high")}


def log_stream(spark: SparkSession, path: str, format: str = "csv",
               max_files: int | None = None) -> DataFrame:
    """Log files under a folder as a stream of typed log rows.

    A CSV file whose header is not the expected one stops the query instead of being misread.
    """
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    block = F.col("_metadata.file_block_start")
    if format != "csv":
        return reader.schema(LOG_SCHEMA).format(format).load(path).withColumn("block", block)
    text = T.StructType([T.StructField(c, T.StringType()) for c in LOG_FILE_COLUMNS])
    rows = reader.schema(text).option("header", True).option("escape", '"') \
                 .option("enforceSchema", False).csv(path) \
                 .withColumns({"run_seq": F.unix_micros("_metadata.file_modification_time"), "block": block})
    return from_log_file_columns(rows).filter("config_index IS NOT NULL")


def versions(spark: SparkSession, table: str) -> list[int]:
    """The batches whose configs are written whole, in order."""
    names = sorted(int(n) for n in folder_names(spark, f"{table}/configs") if n.isdigit())
    return [n for n in names if "_SUCCESS" in folder_names(spark, f"{table}/configs/{n}")]


def logged_windows(spark: SparkSession, table: str, before: int, schema: T.StructType) -> DataFrame | None:
    """The windows of all earlier batches, each as often as it was logged; only reading it opens their files."""
    batches = [n for n in folder_names(spark, f"{table}/windows")
               if n.startswith("batch=") and int(n[6:]) < before]
    if not batches:
        return None
    return spark.read.schema(schema).option("basePath", f"{table}/windows").parquet(*[f"{table}/windows/{n}" for n in batches])


def late_buckets(new: DataFrame, configs: DataFrame) -> list[int]:
    """The buckets, BUCKETS at most, of configs whose new windows do not all lie before or all after those they have already.

    A row per config tells that.  It may name a config whose new windows lie on both sides, which costs a look.
    """
    known = configs.select(*CONFIG_KEYS, "first_window", "last_window")
    late = new.groupBy(*CONFIG_KEYS, "bucket").agg(F.min("window_id").alias("low"), F.max("window_id").alias("high")) \
              .join(known, CONFIG_KEYS).filter("low <= last_window AND high >= first_window")
    return [r.bucket for r in late.select("bucket").distinct().collect()]


def bucketed(partials: DataFrame) -> DataFrame:
    return partials.withColumn("bucket", F.pmod(F.xxhash64(*CONFIG_KEYS), F.lit(BUCKETS)).cast("int"))


def dealt(partials: DataFrame, tasks: int | None = None) -> DataFrame:
    """The windows of a config in one task, those of a bucket in any."""
    slices = F.pmod(F.shiftright(F.xxhash64(*CONFIG_KEYS), 6), F.lit(SLICES)).cast("int")
    return bucketed(partials).withColumn("slice", slices) \
        .repartition(*([tasks] if tasks else []), "bucket", "slice")


def tasks_for(spark: SparkSession, size: int) -> int | None:
    """How many tasks so many bytes of windows are dealt to, if more than usual."""
    tasks = -(-size // TASK_BYTES)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def merge_batch(batch: DataFrame, number: int, table: str) -> None:
    """Write the windows of a batch and the configs after it."""
    spark = batch.sparkSession
    if "line" not in batch.columns and "block" in batch.columns:
        batch = with_line(batch)
    rows, mine = bucketed(window_partials(batch)), f"{table}/windows/batch={number}"
    rows.write.options(**PLAIN).mode("overwrite").partitionBy("bucket").parquet(mine)
    new = spark.read.schema(rows.schema).parquet(mine)
    before = [v for v in versions(spark, table) if v < number]
    configs = spark.read.parquet(f"{table}/configs/{before[-1]}") if before else None
    old = logged_windows(spark, table, number, rows.schema) if before else None
    late = old and late_buckets(new, configs)
    if late:
        old = old.filter(F.col("bucket").isin(late)).select(rows.columns).drop("bucket")
        size = folder_bytes(spark, *(f"{table}/windows/{n}" for n in folder_names(spark, f"{table}/windows")))
        states = config_states(touched_partials(old, new.drop("bucket"), tasks_for(spark, size)), "again")
    else:
        tasks = tasks_for(spark, folder_bytes(spark, mine))
        states = config_states(latest_partials(dealt(new, tasks), "bucket", "slice"))
    if before:
        states = joined_states(configs, states)
    states.write.options(**PLAIN).mode("overwrite").parquet(f"{table}/configs/{number}")
    for version in before[:-1]:
        remove_folder(spark, f"{table}/configs/{version}")


def ingest_logs(log: DataFrame, table: str, checkpoint: str) -> None:
    """Merge the log files that are new since the last call; each file is parsed once.

    The checkpoint remembers the files of a batch and its number before it is run, so a batch that
    failed is run again as it was.
    """
    query = log.writeStream.foreachBatch(partial(merge_batch, table=table)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_scores(spark: SparkSession, table: str) -> DataFrame:
    """Scores of everything ingested so far, from one row per config."""
    done = versions(spark, table)
    if not done:
        raise ValueError(f"{table}: nothing was ingested yet")
    return state_scores(spark.read.parquet(f"{table}/configs/{done[-1]}"))


def stream_log_scores(spark: SparkSession, path: str, work: str, format: str = "csv",
                      max_files: int | None = None) -> DataFrame:
    ingest_logs(log_stream(spark, path, format, max_files), f"{work}/windows", f"{work}/checkpoint")
    return current_scores(spark, f"{work}/windows")
