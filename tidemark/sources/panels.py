"""Reading and writing feature panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.values import date_coerce, finite, numeric_coerce
from tidemark.operators.clean import business_days_only, date_slice, positive_price
from tidemark.schema import DATE_ALIASES


def as_panel(df: DataFrame, keep: tuple[str, ...] = ("market",)) -> DataFrame:
    """Any table with a date column under one of its usual names to ``d`` plus doubles.

    Columns that already have the right type are left as they are, so a Parquet panel keeps its
    pushed-down filters.
    """
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names)
    date = next((c for c in ["d", *DATE_ALIASES] if c in names), None)
    if date is None:
        raise ValueError(f"no date column in {names}")
    types = dict(df.dtypes)
    d = F.col(f"`{date}`")
    cols = [F.col(k) for k in keep if k in names]
    cols.append((d if types[date] == "date" else date_coerce(d)).alias("d"))
    for c in names:
        if c != date and c not in keep:
            v = F.col(f"`{c}`")
            cols.append((finite(v) if types[c] == "double" else numeric_coerce(v)).alias(c))
    return df.select(*cols).filter(F.col("d").isNotNull())


def model_input(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows a model may see: inside the slice, business days, positive price."""
    if "Price" not in panel.columns:
        raise ValueError("a panel needs the column 'Price'")
    return positive_price(business_days_only(date_slice(panel, start, end)))


def read_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
               format: str = "parquet", **options) -> DataFrame:
    """A stored panel, Parquet or CSV, ready for labelling."""
    if format == "csv":
        options = {"header": True, **options}
    return model_input(as_panel(spark.read.format(format).options(**options).load(path)),
                       start, end)


def write_panel(panel: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite"
                ) -> None:
    """One folder per market.  The rows are spread by (market, year) first, so a market is
    written by several tasks and a task does not write a file for every market."""
    panel.repartition("market", F.year("d")) \
         .write.mode(mode).partitionBy("market").option("header", True).format(format).save(path)
