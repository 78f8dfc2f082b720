"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def use_utc(spark: SparkSession) -> SparkSession:
    """Dates are days, so timestamps must become dates in one fixed zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application inside the one that every executor can reach.

    That is the one named in ``spark.checkpoint.dir``, or the one the context was given with
    ``setCheckpointDir``.  Only a local-mode session with neither (tests) gets one of its own.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        own = sc._jsc.sc().getCheckpointDir()
        given = own.get() if own.isDefined() else None
    if not given:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(given)
    return f"{given.rstrip('/')}/tidemark-{sc.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application wrote with ``stored``.

    They belong to the caller, who knows when no result that reads them is needed any more.
    """
    remove_folder(spark, shared_folder(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any file system; none if it is not there."""
    folder, fs = _file(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def folder_bytes(spark: SparkSession, *paths: str) -> int:
    """The bytes of all files under some folders."""
    return sum(fs.getContentSummary(folder).getLength() for folder, fs in (_file(spark, p) for p in paths))


def remove_folder(spark: SparkSession, path: str) -> None:
    folder, fs = _file(spark, path)
    fs.delete(folder, True)


def _file(spark: SparkSession, path: str):
    """A path and its file system, whichever it is."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet; of two writers one fails."""
    file, fs = _file(spark, path)
    out = fs.create(file, False)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """All of a small file."""
    file, fs = _file(spark, path)
    stream = fs.open(file)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and go on from there.

    For results that are dear to compute and read more than once: the plan starts anew at a
    Parquet scan with known sizes and pushed-down filters, and a lost executor costs a read.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
