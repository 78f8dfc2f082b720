"""Small document tables, with columns whose names clash with those the operators make."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, rk string, n_words int, k int, runs string, score string, item_id string"


def frame(spark: SparkSession, data: list[tuple], schema: str = SCHEMA) -> DataFrame:
    """Rows of id and text, perhaps language; the other columns hold anything."""
    return spark.createDataFrame([(*r, *(None, 7, 7, "x", "y", "z")[:9 - len(r)]) if len(r) == 3 else
                                  (*r, None, None, 7, 7, "x", "y", "z") for r in data], schema)


def rows(df: DataFrame) -> list[dict]:
    """All rows as dictionaries, by id with null first, then by all values."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))
