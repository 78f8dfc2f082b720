"""Score tables, metric files and the best-config document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.parsing import parse_dict
from tidemark.functions.values import finite, numeric_coerce
from tidemark.operators.clean import project_order
from tidemark.schema import METRIC_EXTRAS, METRICS, SCORE_SCHEMA

FRONT_TUNING = ["market", "model", "config_index", "window_size", "test_ratio", "n_windows",
                *METRICS]
FRONT_TEST = ["market", "model", "config_index", "window_size", "test_ratio", "n_windows",
              "train_loss_last_mean", *METRICS, *METRIC_EXTRAS]


def read_scores(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A score table with its declared types, columns found by name; NaN cells are NULL from
    here on and a column the file lacks is NULL."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    df = reader.load(path)

    def typed(field):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType)
        if field.dataType.typeName() == "double":
            return numeric_coerce(field.name) if format == "csv" else finite(field.name)
        return F.col(field.name).try_cast(field.dataType)
    return df.select(*[typed(f).alias(f.name) for f in SCORE_SCHEMA])


def write_metrics(df: DataFrame, path: str, front: list[str] = FRONT_TUNING,
                  mode: str = "overwrite") -> None:
    """CSV with the leading columns in their fixed order, then the rest."""
    project_order(df, front, rest=True).write.mode(mode).option("header", True) \
        .option("escape", '"').csv(path)


def best_configs_json(best: DataFrame) -> DataFrame:
    """One document per market, ``{market: {model: row}}`` with keys in order and the
    hyper-parameters as an object again.

    A document per line instead of one for all markets: no task has to hold them all.  A market
    has one row per model here, so its document is small.
    """
    cols = sorted([c for c in best.columns if c not in ("market", "model", "hyperparams_json")]
                  + ["hyperparams", "hyperparams_json", "market", "model"])
    row = F.struct(*cols).alias("row")
    by_model = lambda a, b: F.when(a["model"] < b["model"], -1).when(
        a["model"] > b["model"], 1).otherwise(0)
    return best.withColumn("hyperparams", F.try_parse_json("hyperparams_json")) \
        .groupBy("market") \
        .agg(F.array_sort(F.collect_list(F.struct("model", row)), by_model).alias("m")) \
        .select("market", F.to_json(F.create_map(
            F.col("market"), F.map_from_entries("m"))).alias("document"))


def write_best_configs(best: DataFrame, path: str, mode: str = "overwrite") -> None:
    best_configs_json(best).select(F.col("document").alias("value")).write.mode(mode).text(path)


def read_best_configs(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Documents ``{market: {model: row}}`` to one row per (market, model).

    ``lines``: one document per line, as written here.  Else each file is one document.
    """
    fields = [f"{f.name}: {f.dataType.simpleString()}" for f in SCORE_SCHEMA
              if f.name not in ("market", "model")]
    kind = f"map<string, map<string, struct<{', '.join(fields)}>>>"
    docs = spark.read.text(path, wholetext=not lines).select(
        F.explode(F.from_json("value", kind)).alias("market", "models"))
    rows = docs.select("market", F.explode("models").alias("model", "r"))
    return rows.select("market", "model", "r.*") \
               .withColumn("hyperparams", parse_dict("hyperparams_json"))
