"""Tables, row keys and written intermediate results shared by the text operators."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of documents whose checksum leaves this remainder are held out from every fit.
HELD_OUT, FOLDS = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def row_key(docs: DataFrame) -> Column:
    """64 bits of id and text: spread evenly even if ids are null, and the same after a retry."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def keyed(docs: DataFrame) -> DataFrame:
    """Only ``doc_id``, ``text`` and the row key ``rk``, whatever other columns there are."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"),
                       row_key(docs).alias("rk"))


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as functions on batches import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="tidemark-code-"))
    with zipfile.ZipFile(folder / "tidemark_code.zip", "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(folder / "tidemark_code.zip"))
    _shipped.add(sc.applicationId)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
             schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
        pa.default_memory_pool().release_unused()  # the worker lives on, next to others
    return df.mapInArrow(run, schema)


def hex256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
