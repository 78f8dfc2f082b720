"""Rankings: the house order, top-k per group, and exact ranks and quantiles of big groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import finite
from tidemark.session import stored


def lowest(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def highest(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def house_order() -> list[Column]:
    """MAPE, RMSE/mean, MAE from below, R2 from above, missing last; config_index decides ties."""
    return [*lowest("MAPE", "RMSE_over_mean_price", "MAE"), *highest("R2"),
            *lowest("config_index")]


def ranking_order(scores: DataFrame) -> DataFrame:
    return scores.orderBy(*lowest("market", "model"), *house_order())


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key.  Spark keeps at most ``n`` rows per key and task before the
    shuffle (window group limit), so no group is ever brought together whole."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
            .filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def best_by_market_model(scores: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    return top_n(scores, ["market", "model"], order or house_order(), 1)


def best_by_model(across: DataFrame) -> DataFrame:
    order = [*highest("markets_covered"),
             *lowest("mean_MAPE", "mean_RMSE_over_mean_price", "mean_MAE"),
             *highest("mean_R2"), *lowest("hyperparams_json")]
    return top_n(across, ["model"], order, 1)


def best_extremes(cfg_market: DataFrame) -> DataFrame:
    """Per (market, model): the smallest MAPE, the R2 of that row, and the largest R2.

    Metrics that are NULL or not finite do not compete; equal ones are decided by the config text.
    """
    rows = cfg_market.withColumns({m: finite(m) for m in ("MAPE", "R2")})
    return rows.groupBy("market", "model").agg(
        F.min("MAPE").alias("best_MAPE"),
        F.min_by("R2", F.when(F.col("MAPE").isNotNull(), F.struct("MAPE", "hyperparams_json")))
        .alias("R2_at_best_MAPE"),
        F.max("R2").alias("best_R2"))


# ---- ranks and quantiles of groups of any size ------------------------------------------

def sorted_runs(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows cut into runs of about equal size by range of ``order``, with the number of each
    run, as a written table.

    ``row_number`` over a whole key would sort one key in one task.  Runs cut a big key wherever its
    rows lie, and a written run stays what it is when a task is repeated.
    """
    return stored(df.repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "runs")


def run_offsets(runs: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """Per (key, run) the rows of the key in smaller runs (``offset``) and in all (``total``)."""
    sums = runs.groupBy(*keys, "run").agg(count.alias("in_run"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({"offset": F.coalesce(F.sum("in_run").over(before), F.lit(0)),
                             "total": F.sum("in_run").over(every)}).drop("in_run")


def ordered_rank(df: DataFrame, keys: Sequence[str], value: str, tie_break: Sequence[Column] = (),
                 rank: str = "rank") -> DataFrame:
    """1-based rank of each row within its key by ascending value; rows without one come last.

    Each run is ranked by itself and moved up by the rows of the key in the runs before it.  Rows
    that agree in value and ``tie_break`` are told apart by a hash of the row, so that neither equal
    nor missing values gather in one run.
    """
    order = [F.col(value).asc_nulls_last(), *tie_break, F.xxhash64(*df.columns)]
    runs = sorted_runs(df, [*[F.col(k) for k in keys], *order])
    here = Window.partitionBy(*keys, "run").orderBy(*[F.col(value).asc_nulls_last(), *tie_break],
                                                    F.xxhash64(*df.columns))
    return runs.withColumn("_place", F.row_number().over(here)) \
        .join(run_offsets(runs, keys, F.count(F.lit(1))), [*keys, "run"]) \
        .withColumn(rank, F.col("offset") + F.col("_place")).drop("run", "_place", "offset", "total")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each distinct value of a key with its rows ``n``, the rows ``before`` it and the ``total``.

    Equal values are counted before anything is sorted, so a value that half of all rows share is
    one row here.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    runs = sorted_runs(counts, [*[F.col(k) for k in keys], F.col(value)])
    here = Window.partitionBy(*keys, "run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_before", F.coalesce(F.sum("n").over(here), F.lit(0))) \
        .join(run_offsets(runs, keys, F.sum("n")), [*keys, "run"]) \
        .withColumn("before", F.col("offset") + F.col("_before")).drop("run", "_before", "offset")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one column per name in ``probs``.

    The built-in exact percentile would hold all values of a key in one task.
    """
    ranked = ranked_values(df.filter(finite(value).isNotNull()).select(*keys, value), keys, value)
    out = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
        below = F.max(F.when(holds(F.floor(at)), F.col(value)))
        above = F.max(F.when(holds(F.ceil(at)), F.col(value)))
        out.append((below + (above - below) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def rank_in_market(scores: DataFrame, tie_break: Sequence[str] = ("RMSE",)) -> DataFrame:
    """Running rank of the models of a market by MAPE, then ``tie_break``, then R2 from above."""
    order = [*lowest(*tie_break), *highest("R2"), *lowest("model", "config_index")]
    return ordered_rank(scores, ["market"], "MAPE", order, "rank_in_market")
