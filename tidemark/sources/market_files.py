"""Readers of raw market files and of landed quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.values import date_coerce, finite, numeric_coerce
from tidemark.operators.clean import dedupe_last, find_column, normalise_headers

DEFAULT_VALUE = "Secondary Market"


def read_labelled_csv(spark: SparkSession, path: str, value: str = DEFAULT_VALUE,
                      carry: dict[str, str] | None = None, market: str | None = None) -> DataFrame:
    """CSV files whose labels are a data row (a title line comes before them).

    The label row of a file is the one whose first cell reads ``Date``; each file is read by its own
    labels, so a folder may hold several layouts.  A file without a label row is a part of the table
    in its folder, if all label rows there agree; else it is passed over (``passed_over_files``).  Data rows are those whose first cell is a date,
    wherever they are, so a file may be split among many tasks.  ``carry`` keeps more columns:
    label -> name in the result; ``market`` names a column for the name of the file, without ending.
    """
    placed, labels = _placed_rows(spark, path, value, carry)
    bad = labels.filter("lacks").first()
    if bad is not None:
        raise ValueError(f"{bad.file}: not all of the columns {[value, *(carry or {})]}")
    stem = F.regexp_extract(F.url_decode("file"), r"([^/]*?)(\.[^./]*)?$", 1)
    out = placed.filter("at IS NOT NULL").select(
        *([stem.alias(market)] if market else []), *[_cell(name).alias(name) for name in (carry or {}).values()],
        date_coerce(F.col("cells")[0]).alias("d"), numeric_coerce(_cell("price")).alias("price"))
    return out.filter(F.col("d").isNotNull() & F.col("price").isNotNull())


def _cell(name: str) -> Column:
    return F.when(F.col("at")[name] > 0, F.try_element_at("cells", F.col("at")[name]))


def _placed_rows(spark: SparkSession, path: str, value: str, carry: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """The rows of all files with where their columns are (``at``, NULL in a file that is passed over), and the files
    with labels, which may lack some (``lacks``)."""
    first = F.lower(F.trim(F.translate(F.split("value", ",").getItem(0), '"\ufeff', "")))
    lines = spark.read.option("recursiveFileLookup", True).text(path).filter(first == "date")
    width = lines.agg(F.max(F.size(F.split("value", ",")))).first()[0]
    if width is None:
        raise ValueError(f"{path}: no label row starting with 'Date'")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("escape", '"').csv(path) \
        .select(F.array(*schema.fieldNames()).alias("cells"), F.col("_metadata.file_path").alias("file"))
    names = F.transform("cells", lambda c: F.lower(F.trim(F.translate(c, "\ufeff", ""))))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    wanted = {"price": value, **{name: label for label, name in (carry or {}).items()}}
    places = F.struct(*[F.coalesce(F.array_position("labels", label.lower()).cast("int"), F.lit(0)).alias(name)
                        for name, label in wanted.items()])
    labels = rows.filter(names[0] == "date").groupBy("file").agg(F.min(names).alias("labels")) \
        .select("file", folder.alias("folder"), places.alias("own"))
    labels = labels.withColumn("lacks", F.least(*[F.col("own")[name] for name in wanted], F.lit(1)) == 0)
    shared = labels.groupBy("folder").agg(F.min("own").alias("shared"), F.max("own").alias("other")) \
        .withColumn("differ", F.col("shared") != F.col("other"))
    # One row per file, as the driver lists them, goes to every task: rows are not dealt by their file, of which there may be few.
    placed = rows.withColumn("folder", folder).join(F.broadcast(labels.select("file", "own", "lacks")), "file", "left") \
        .join(F.broadcast(shared.select("folder", "shared", "differ")), "folder", "left") \
        .withColumn("at", F.coalesce("own", F.when(~F.col("differ"), F.col("shared"))))
    return placed, labels


def passed_over_files(spark: SparkSession, path: str, value: str = DEFAULT_VALUE,
                      carry: dict[str, str] | None = None) -> DataFrame:
    """The files that give ``read_labelled_csv`` no price, with the reason and their rows that begin with a date.

    A file that makes it stop is listed too, so a folder can be mended in one go.  Spark does not see empty files.
    """
    placed, _ = _placed_rows(spark, path, value, carry)
    dated = date_coerce(F.col("cells")[0]).isNotNull()
    priced = dated & numeric_coerce(_cell("price")).isNotNull()
    found = placed.groupBy("file").agg(
        F.count_if(dated).alias("n_rows"), F.count_if(priced).alias("n_prices"), F.max("lacks").alias("lacks"),
        F.max(F.col("own").isNotNull()).alias("labelled"), F.max("differ").alias("differ"))
    reason = (F.when(F.col("lacks"), "label row without all of the columns")
              .when(~F.col("labelled") & F.col("differ"), "no label row, and those of its folder differ")
              .when(~F.col("labelled") & F.col("differ").isNull(), "no label row in its folder")
              .when(F.col("n_rows") == 0, "no row begins with a date")
              .when(F.col("n_prices") == 0, "no row has a price"))
    return found.withColumn("reason", reason).filter("reason IS NOT NULL").select("file", "reason", "n_rows")


def read_two_column(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Date and price by position: the first two columns that are not in ``keep``."""
    date, price = [c for c in df.columns if c not in keep][:2]
    return df.select(*keep, date_coerce(date).alias("d"), numeric_coerce(price).alias("price")) \
             .filter(F.col("d").isNotNull() & F.col("price").isNotNull())


def read_price_sheet(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Date from ``Date`` or the first column; price from ``Adj Close`` if there, else ``Close``."""
    df = normalise_headers(df)
    date = "Date" if "Date" in df.columns else [c for c in df.columns if c not in keep][0]
    price = find_column(df, "Adj Close", "Close")
    return df.select(*keep, date_coerce(date).alias("d"), numeric_coerce(price).alias("price")) \
             .filter(F.col("d").isNotNull() & F.col("price").isNotNull())


def quotes_series(quotes: DataFrame, seq: Sequence[str] | str = "seq",
                  tickers: Sequence[str] | None = None) -> DataFrame:
    """Landed quotes to one price per (ticker, date): adjusted close where the table has it,
    else close; the last row of a date counts."""
    price = find_column(quotes, "adj_close", "close")
    rows = quotes.filter(F.col("ticker").isNotNull() & F.col("d").isNotNull())
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
    rows = rows.withColumn("price", finite(price))
    return dedupe_last(rows, ["ticker", "d"], seq, ["price"])


def missing_inputs(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected inputs without any row.  The present keys are made distinct before the join."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")
