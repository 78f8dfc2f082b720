"""The tables behind the reports: averages, pivots, histograms, sensitivities, rank curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.parsing import hp_standardise, parse_dict
from tidemark.functions.values import finite, is_tcn
from tidemark.operators.clean import list_position
from tidemark.operators.ranking import (
    exact_quantiles, highest, lowest, ranked_values)
from tidemark.schema import (
    CURVE_CAP, CURVE_CAP_TCN, CURVE_MIN_MARKET, CURVE_MIN_POOLED, FINANCIAL_COLUMNS,
    GRID_ACTIVATIONS, HIST_BINS, HIST_XMAX, HIST_XMAX_TCN, HP_ALIASES, TECHNICAL_PREFIXES)


# ---- averages ---------------------------------------------------------------------------

def model_averages(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.count_distinct("market").alias("markets_covered"),
        F.avg("MAPE").alias("mean_MAPE"), F.avg("RMSE").alias("mean_RMSE"),
        F.avg("R2").alias("mean_R2"),
    ).orderBy(*lowest("mean_MAPE", "mean_RMSE"), *highest("mean_R2"))


def model_summary(scores: DataFrame) -> DataFrame:
    """Mean and exact median of MAPE and R2 per model."""
    means = scores.groupBy("model").agg(
        F.count_distinct("market").alias("markets_covered"),
        F.avg("MAPE").alias("mean_MAPE"), F.avg("R2").alias("mean_R2"))
    long = _metric_rows(scores, ["model"], signed=False)
    medians = exact_quantiles(long, ["model", "metric"], "value", {"median": 0.5})
    medians = medians.groupBy("model").agg(
        F.max(F.when(F.col("metric") == "MAPE", F.col("median"))).alias("median_MAPE"),
        F.max(F.when(F.col("metric") == "R2", F.col("median"))).alias("median_R2"))
    return means.join(medians, "model", "left") \
                .orderBy(*lowest("mean_MAPE"), *highest("mean_R2"))


def configs_across_markets(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "hyperparams_json").agg(
        F.count_distinct("market").alias("markets_covered"),
        *[F.avg(m).alias(f"mean_{m}")
          for m in ("MAPE", "RMSE_over_mean_price", "MAE", "R2")])


def cfg_market(scores: DataFrame) -> DataFrame:
    """One row per (market, model, config text): duplicates collapse to their mean."""
    return scores.groupBy("market", "model", "hyperparams_json").agg(
        F.avg("MAPE").alias("MAPE"), F.avg("R2").alias("R2"))


def cfg_overall(per_market: DataFrame) -> DataFrame:
    """One row per (model, config text).  Each market is one row of the input, so counting rows
    counts markets."""
    return per_market.groupBy("model", "hyperparams_json").agg(
        F.avg("MAPE").alias("mean_MAPE"), F.avg("R2").alias("mean_R2"),
        F.count("market").alias("markets_covered"))


def attach_hp(overall: DataFrame) -> DataFrame:
    """Hyper-parameters in one set of columns.  The config text is a grouping key, so its parsed
    form needs no join back to the scores."""
    out = overall.withColumn("hp", parse_dict("hyperparams_json"))
    return out.withColumns(hp_standardise("hp", "model")).drop("hp")


def ranked_configs(overall: DataFrame) -> DataFrame:
    return overall.orderBy(*lowest("model"), *highest("markets_covered"), *lowest("mean_MAPE"),
                           *highest("mean_R2"), *lowest("hyperparams_json"))


def run_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("market").alias("n_markets"),
        F.count_distinct("model").alias("n_models"),
        F.count_distinct("model", "hyperparams_json").alias("n_configs"))


# ---- pivots -----------------------------------------------------------------------------

def metric_pivot(scores: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """Market x model matrix of a metric; the model list is fixed, so no job looks for it."""
    return scores.groupBy("market").agg(
        *[F.max(F.when(F.col("model") == m, F.col(metric))).alias(m) for m in models])


def ordered_pivot(scores: DataFrame, metric: str, markets: Sequence[str],
                  models: Sequence[str]) -> DataFrame:
    """The same with exactly the listed markets, in their order; an absent one is all NULL."""
    rows = scores.sparkSession.createDataFrame(
        [(i + 1, m) for i, m in enumerate(markets)], "ord int, market string")
    wide = metric_pivot(scores.filter(F.col("market").isin(list(markets))), metric, models)
    return rows.join(wide, "market", "left").orderBy("ord")


def feature_group(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    technical = F.lit(False)
    for prefix in TECHNICAL_PREFIXES:
        technical = technical | c.startswith(prefix)
    return (F.when(technical, "technical")
            .when(c.isin(FINANCIAL_COLUMNS), "financial")
            .when(c.endswith("_F"), "commodities"))


def price_feature_pairs(panel: DataFrame, features: Sequence[str], price: str = "Price"
                        ) -> DataFrame:
    """Long (market, d, price, feature, value) with both values present."""
    long = panel.unpivot(["market", "d", price], list(features), "feature", "value")
    return long.filter(F.col(price).isNotNull() & F.col("value").isNotNull())


# ---- sensitivity and histogram ----------------------------------------------------------

def _value_order(hp: Column, value: Column) -> Column:
    place = list_position(value, GRID_ACTIVATIONS)
    return F.when(hp == "activation", F.coalesce(place.cast("double"), F.lit(999.0))) \
            .otherwise(value.try_cast("double"))


def hp_sensitivity(overall: DataFrame) -> DataFrame:
    """Mean of the config means per (model, hyper-parameter, value).  A hyper-parameter with one
    value only says nothing and gives no rows."""
    long = overall.select("model", "mean_MAPE", *[F.col(f"hp_{n}").alias(n) for n in HP_ALIASES]) \
                  .unpivot(["model", "mean_MAPE"], list(HP_ALIASES), "hp", "value") \
                  .filter(F.col("value").isNotNull())
    means = long.groupBy("model", "hp", "value").agg(F.avg("mean_MAPE").alias("mean_MAPE"))
    varied = long.groupBy("model", "hp").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo <> hi")
    return means.join(varied.select("model", "hp"), ["model", "hp"], "left_semi") \
                .withColumn("value_order", _value_order(F.col("hp"), F.col("value")))


def hist_xmax(model: Column | str) -> Column:
    return F.when(is_tcn(model), HIST_XMAX_TCN).otherwise(HIST_XMAX)


def error_histogram(overall: DataFrame, value: str = "mean_MAPE", bins: int = HIST_BINS
                    ) -> DataFrame:
    """Share of configs per bin of [0, xmax]; values outside go to the end bins, and every bin
    of a model is present."""
    v = finite(value)
    xmax = hist_xmax("model")
    clipped = F.greatest(F.least(v, xmax), F.lit(0.0))
    place = F.least(F.floor(clipped * bins / xmax), F.lit(bins - 1)).cast("int")
    counts = overall.filter(v.isNotNull()).groupBy("model", place.alias("bin")) \
                    .agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("model").agg(F.sum("n").alias("total")).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.col("n"), F.lit(0))
    return every.join(counts, ["model", "bin"], "left").select(
        "model", "bin", (F.col("bin") * hist_xmax("model") / bins).alias("left_edge"),
        n.alias("n"), (n / F.col("total")).alias("share"))


# ---- rank curves ------------------------------------------------------------------------

def _metric_rows(scores: DataFrame, keys: Sequence[str], signed: bool = True) -> DataFrame:
    """MAPE and R2 as rows of one column, finite ones only.  ``signed`` turns MAPE round, so
    that ascending means worst to best for both."""
    mape = -F.col("MAPE") if signed else F.col("MAPE")
    long = scores.select(*keys, mape.alias("MAPE"), F.col("R2").alias("R2")) \
                 .unpivot(list(keys), ["MAPE", "R2"], "metric", "value")
    return long.filter(finite("value").isNotNull())


def _curves(long: DataFrame, keys: Sequence[str], least: int, top_k: int | None) -> DataFrame:
    """MAPE and R2 of each rank per model: the mean over the other keys, for the ranks all reach.

    Curves shorter than ``least`` points do not count.  A value that several configs share is one
    row up to the end, where it is written out once for each rank it takes.
    """
    by = [*keys, "metric"]
    ranked = ranked_values(long, by, "value")
    n = {m: F.max(F.when(F.col("metric") == m, F.col("total"))) for m in ("MAPE", "R2")}
    points = ranked.groupBy(*keys).agg(
        F.when(n["MAPE"].isNotNull() & n["R2"].isNotNull(), F.least(n["MAPE"], n["R2"]))
        .alias("points")).filter(F.col("points") >= least)
    shortest = points.groupBy("model").agg(F.min("points").alias("reach"))
    if top_k is not None:
        shortest = shortest.withColumn("reach", F.least("reach", F.lit(top_k)))
    kept = ranked.join(points.select(*keys), list(keys), "left_semi").join(shortest, "model") \
                 .filter(F.col("before") < F.col("reach"))
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.col("reach")))
    placed = kept.select("model", "metric", "value", F.explode(ranks).alias("rank"))
    mean = {m: F.avg(F.when(F.col("metric") == m, F.col("value"))) for m in ("MAPE", "R2")}
    return placed.groupBy("model", "rank").agg((-mean["MAPE"]).alias("MAPE"),
                                               mean["R2"].alias("R2"))


def _clip(c: Column, low: float, high: Column | float) -> Column:
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), F.lit(low)))


def rank_curve_pooled(per_market: DataFrame, least: int = CURVE_MIN_POOLED) -> DataFrame:
    """All configs of a model pooled over markets; MAPE and R2 each sorted worst to best on its
    own, then put side by side by rank and clipped to the plotted range."""
    cap = F.when(is_tcn("model"), CURVE_CAP_TCN).otherwise(CURVE_CAP)
    return _curves(_metric_rows(per_market, ["model"]), ["model"], least, None).select(
        "model", "rank", _clip(F.col("MAPE"), 0.0, cap).alias("MAPE"),
        _clip(F.col("R2"), 0.0, 1.0).alias("R2"))


def rank_curve_by_market(per_market: DataFrame, least: int = CURVE_MIN_MARKET,
                         top_k: int | None = None) -> DataFrame:
    """The same per market, cut to the shortest market, and averaged at each rank.

    The range of the plot is the histogram's, or up to the worst point, but 0.10 at most; so
    0.10 is the only value that ever clips.
    """
    keys = ["model", "market"]
    return _curves(_metric_rows(per_market, keys), keys, least, top_k).select(
        "model", "rank", _clip(F.col("MAPE"), 0.0, 0.10).alias("MAPE"),
        _clip(F.col("R2"), 0.0, 1.0).alias("R2"))


def axis_bounds(curve: DataFrame, value: str = "R2") -> DataFrame:
    """Axis range of a curve: its 5th and 95th percentile with a margin, inside [0, 1]."""
    q = exact_quantiles(curve.withColumn(value, _clip(F.col(value), 0.0, 1.0)), ["model"], value,
                        {"q05": 0.05, "q95": 0.95})
    lo = F.greatest(F.lit(0.0), F.col("q05") - 0.03)
    hi = F.least(F.lit(1.0), F.col("q95") + 0.03)
    narrow = hi - lo < 0.06
    return q.select(
        "model",
        F.when(narrow, F.greatest(F.lit(0.0), lo - 0.03)).otherwise(lo).alias("lo"),
        F.when(narrow, F.least(F.lit(1.0), hi + 0.03)).otherwise(hi).alias("hi"))
