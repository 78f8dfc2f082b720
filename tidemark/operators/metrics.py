"""Forecast error metrics.  Every one is a set of mergeable aggregates: each task sends one
row per group to the shuffle, however many rows the group has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import finite, relative_error
from tidemark.operators.clean import dedupe_last
from tidemark.schema import ERROR_LIMIT, MAPE_FLOOR, REPORT_FLOOR


def score_columns(t: Column, p: Column) -> dict[str, Column]:
    """The scoring metrics as aggregate expressions over truth and prediction.

    Only pairs of two finite numbers count, in every metric.  R2 of a constant truth is 1 for a
    perfect forecast and 0 otherwise; below two rows it is NULL.  The normaliser of RMSE is the
    signed mean of the truth.
    """
    ok = finite(t).isNotNull() & finite(p).isNotNull()
    t, p = F.when(ok, t), F.when(ok, p)
    e = p - t
    n, mse, spread = F.count(e), F.avg(e * e), F.var_pop(t)
    return {
        "MAPE": F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(MAPE_FLOOR))),
        "RMSE_over_mean_price": F.try_divide(F.sqrt(mse), F.avg(t)),
        "MAE": F.avg(F.abs(e)),
        "R2": F.when(n < 2, None)
               .when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0))
               .otherwise(1 - F.try_divide(mse, spread)),
        "RMSE": F.sqrt(mse),
        "mean_price": F.avg(t),
        "n_samples": n,
    }


def forecast_metrics(df: DataFrame, keys: Sequence[str], truth: str = "y_true",
                     prediction: str = "y_pred") -> DataFrame:
    cols = score_columns(F.col(truth), F.col(prediction))
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


def dedupe_log(log: DataFrame, seq: str = "run_seq") -> DataFrame:
    """One row per (market, model, config, window): of re-runs the one of the highest ``seq``.

    Rows of one ``seq`` are told apart by their ``line`` in the file, if they have one, then by what they hold, so
    the result does not depend on how the log is laid out.  The keys are nearly unique and the lists make Spark aggregate by sorting, so
    the key that tells most rows apart, a number, comes first in the sort.
    """
    keys = ["window_id", "config_index", "model", "market"]
    values = [c for c in log.columns if c not in (*keys, seq)]
    content = [c for c in ("line", "y_pred", "y_true", "hp_json", "error", "end_date") if c in values]
    return dedupe_last(log, keys, [seq, *content], values)


def log_pairs(log: DataFrame, *carry: str) -> DataFrame:
    """One row per forecast day: the two lists of a window, zipped.

    A list that is longer than its partner has no partner for the rest, which is left out;
    ``uneven_cells`` reports such windows.
    """
    keys = [c for c in ("market", "model", "config_index", "window_id", *carry)
            if c in log.columns]
    both = F.arrays_zip(F.col("y_true").alias("t"), F.col("y_pred").alias("p"))
    return log.select(*keys, F.inline(both).alias("y_true", "y_pred")) \
              .filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def uneven_cells(log: DataFrame) -> DataFrame:
    return log.filter(F.size("y_true") != F.size("y_pred")) \
              .groupBy("market", "model", "config_index") \
              .agg(F.count(F.lit(1)).alias("n_uneven"))


PARTIAL = "n bigint, mean double, m2 double, e2 double, ae double, ape double, low double, high double"


def window_partials(log: DataFrame) -> DataFrame:
    """One narrow row per log row: what its forecasts add to the scores of their config.

    Sums over the lists of a row, so a stream can write them without any state.  The spread of the
    truth is kept as mean and sum of squared deviations, which merge without cancellation.
    """
    pairs = F.filter(F.arrays_zip(F.col("y_true").alias("t"), F.col("y_pred").alias("p")),
                     lambda x: finite(x["t"]).isNotNull() & finite(x["p"]).isNotNull())
    none = F.lit(None).cast("double")
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in ("mean", "m2", "e2", "ae", "ape")],
                    none.alias("low"), none.alias("high"))

    def add(a: Column, x: Column) -> Column:
        t, e, n = x["t"], x["p"] - x["t"], a["n"] + 1
        mean = a["mean"] + (t - a["mean"]) / n
        return F.struct(
            n.alias("n"), mean.alias("mean"), (a["m2"] + (t - a["mean"]) * (t - mean)).alias("m2"),
            (a["e2"] + e * e).alias("e2"), (a["ae"] + F.abs(e)).alias("ae"),
            (a["ape"] + F.abs(e) / F.greatest(F.abs(t), F.lit(MAPE_FLOOR))).alias("ape"),
            F.least(a["low"], t).alias("low"), F.greatest(a["high"], t).alias("high"))

    fields = "struct<" + PARTIAL.replace(", ", ",").replace(" ", ":") + ">"
    line = F.col("line") if "line" in log.columns else F.lit(None).cast("struct<block:bigint,row:bigint>")
    return log.select("market", "model", "config_index", "window_id", "hp_json", "run_seq", line.alias("line"),
                      _error(log).alias("error"), F.aggregate(pairs, zero, add).cast(fields)
                      .alias("part")).select("*", "part.*").drop("part")


CONFIG_KEYS = ["market", "model", "config_index"]
SUMS = ("e2", "ae", "ape")


def latest_partials(partials: DataFrame, *places: str) -> DataFrame:
    """Each window once: the row of the highest ``run_seq``, then ``line``.

    ``places`` are columns that follow from the config; rows that lie dealt by them are not shuffled.
    """
    values = [c for c in partials.columns if c not in (*CONFIG_KEYS, "window_id", "run_seq", "line", *places)]
    return dedupe_last(partials, ["window_id", *reversed(CONFIG_KEYS), *places], ["run_seq", "line", *values],
                       [*values, "run_seq", "line"])


def touched_partials(old: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """The windows that configs with ``new`` windows are to be summed up from, each once, and ``again``.

    A config that logs a window of ``old`` once more has ``again`` and comes with all its windows, any other with
    those that are new.  Either table may hold a window several times.  Both are dealt by config, once, to so many
    ``tasks``, and sorted once: by a number that tells configs apart, then by config and window.
    """
    place = ["place", *reversed(CONFIG_KEYS)]
    both = old.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
    both = both.repartition(*([tasks] if tasks else []), *CONFIG_KEYS).withColumn("place", F.xxhash64(*CONFIG_KEYS))
    values = [c for c in old.columns if c not in (*CONFIG_KEYS, "window_id", "run_seq", "line")]
    rows = both.groupBy(*place, "window_id").agg(
        F.max(F.struct("run_seq", "line", *values)).alias("last"), F.max("new").alias("new"), F.min("new").alias("only"))
    twice = F.max(F.col("new") & ~F.col("only")).over(Window.partitionBy(*place))
    return rows.withColumn("again", twice).filter(F.col("again") | F.col("new")) \
        .select(*CONFIG_KEYS, "window_id", "again", "last.*")


def config_states(partials: DataFrame, *flags: str) -> DataFrame:
    """What the windows of a config add up to; each window is there once.  ``flags`` are equal in a config.

    ``mean`` and ``m2`` are those of the truth of all its rows: the spread within the windows and that of
    their means.  Windows of one length and text are summed up first, in buffers of fixed width, so that tasks neither
    sort windows nor send them; how far the means of such windows lie apart is their variance, and a config has few lengths.
    """
    alike = partials.groupBy(*CONFIG_KEYS, "hp_json", "n", *flags).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count("error").alias("n_failed"), F.avg("mean").alias("mean"),
        F.sum("m2").alias("m2"), F.var_pop("mean").alias("apart"), *[F.sum(c).alias(c) for c in SUMS],
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"))
    size = F.col("n") * F.col("n_windows")
    alike = alike.withColumns({"m2": F.col("m2") + F.coalesce(size * F.col("apart"), F.lit(0.0)), "n": size}).drop("apart")
    every = Window.partitionBy(*CONFIG_KEYS)
    rows = alike.withColumn("middle", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(every), F.sum("n").over(every)))
    shift = F.when(F.col("n") > 0, F.col("mean") - F.col("middle"))
    return rows.groupBy(*CONFIG_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n_windows", "n_failed", "n")], F.coalesce(F.max("middle"), F.lit(0.0)).alias("mean"),
        F.sum(F.col("m2") + F.coalesce(F.col("n") * shift * shift, F.lit(0.0))).alias("m2"),
        *[F.sum(c).alias(c) for c in SUMS], F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first_window").alias("first_window"), F.max("last_window").alias("last_window"),
        F.min_by("hp_json", "first_window").alias("hp_json"), *[F.max(c).alias(c) for c in flags])


def joined_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The states of two disjoint sets of windows as one; a config may be in either or both.

    A config of ``new`` with ``again`` was summed up from all its windows and takes the place of the old one.
    """
    a = old.select(*CONFIG_KEYS, F.struct(*[c for c in old.columns if c not in CONFIG_KEYS]).alias("a"))
    b = new.select(*CONFIG_KEYS, F.struct(*[c for c in new.columns if c not in CONFIG_KEYS]).alias("b"))
    x, y = F.col("a"), F.col("b")
    n = x["n"] + y["n"]
    apart = y["mean"] - x["mean"]
    both = {
        "n_windows": x["n_windows"] + y["n_windows"], "n_failed": x["n_failed"] + y["n_failed"], "n": n,
        "mean": F.when(n > 0, (x["n"] * x["mean"] + y["n"] * y["mean"]) / n).otherwise(0.0),
        "m2": x["m2"] + y["m2"] + F.coalesce(F.try_divide(apart * apart * x["n"] * y["n"], n), F.lit(0.0)),
        **{c: x[c] + y[c] for c in SUMS},
        "low": F.least(x["low"], y["low"]), "high": F.greatest(x["high"], y["high"]),
        "first_window": F.least(x["first_window"], y["first_window"]),
        "last_window": F.greatest(x["last_window"], y["last_window"]),
        "hp_json": F.when(y["first_window"] < x["first_window"], y["hp_json"]).otherwise(x["hp_json"])}
    anew = F.coalesce(y["again"], F.lit(False)) if "again" in new.columns else F.lit(False)
    one = [F.when(x.isNull() | anew, y[c]).when(y.isNull(), x[c]).otherwise(v).alias(c) for c, v in both.items()]
    return a.join(b, CONFIG_KEYS, "full").select(*CONFIG_KEYS, *one)


def state_scores(states: DataFrame, *keep: str) -> DataFrame:
    """The scores of ``config_scores`` from states of configs, and the columns to ``keep``."""
    n = F.col("n")
    mse, price = F.try_divide("e2", n), F.when(n > 0, F.col("mean"))
    spread = F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.try_divide("m2", n))
    return states.filter((n > 0) & (F.col("n_failed") == 0)).select(
        *CONFIG_KEYS, "n_windows", F.try_divide("ape", n).alias("MAPE"),
        F.try_divide(F.sqrt(mse), price).alias("RMSE_over_mean_price"), F.try_divide("ae", n).alias("MAE"),
        F.when(n < 2, None).when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(mse, spread)).alias("R2"),
        F.sqrt(mse).alias("RMSE"), price.alias("mean_price"), n.alias("n_samples"),
        F.col("hp_json").alias("hyperparams_json"), *keep)


def merged_scores(partials: DataFrame) -> DataFrame:
    """The scores of ``config_scores`` from partials; a window that is there twice counts by its
    highest ``run_seq``, then ``line``."""
    return state_scores(config_states(latest_partials(partials)))


def _error(log: DataFrame) -> Column:
    return F.col("error") if "error" in log.columns else F.lit(None).cast("string")


def config_scores(log: DataFrame, with_loss: bool = False) -> DataFrame:
    """One score row per (market, model, config) whose windows all went well.

    A config with a failed window has no score, since what is left would be scored on easier days
    than its rivals; ``unscored_runs`` reports it.  The number of windows is exact without a second
    shuffle, because windows are unique in a deduplicated log: count the first forecast of each, or
    the one row an empty list leaves.  ``with_loss`` adds ``train_loss_last_mean`` in the same pass.
    """
    both = F.arrays_zip(F.col("y_true").alias("t"), F.col("y_pred").alias("p"))
    loss = [finite("train_loss").alias("loss")] if with_loss else []
    pairs = log.select(*CONFIG_KEYS, "window_id", "hp_json", _error(log).alias("error"), *loss,
                       F.posexplode_outer(both).alias("i", "pair"))
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    t, p = finite(F.col("pair.t")), finite(F.col("pair.p"))
    ok = t.isNotNull() & p.isNotNull()
    t, p = F.when(ok, t), F.when(ok, p)
    e, none = p - t, F.lit(0.0)
    sums = {"e2": e * e, "ae": F.abs(e), "ape": F.abs(e) / F.greatest(F.abs(t), F.lit(MAPE_FLOOR))}
    more = {"loss_sum": F.sum(F.when(first, F.col("loss"))), "n_loss": F.count(F.when(first, F.col("loss")))} if with_loss else {}
    states = pairs.groupBy(*CONFIG_KEYS, "hp_json").agg(
        F.count_if(first).alias("n_windows"), F.count("error").alias("n_failed"), F.count(e).alias("n"),
        F.coalesce(F.avg(t), none).alias("mean"), F.coalesce(F.var_pop(t) * F.count(e), none).alias("m2"),
        *[F.coalesce(F.sum(x), none).alias(c) for c, x in sums.items()], F.min(t).alias("low"), F.max(t).alias("high"),
        F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"),
        *[x.alias(c) for c, x in more.items()])
    merged = one_text(states, more)
    scores = state_scores(merged, *more)
    if not with_loss:
        return scores
    return scores.withColumn("train_loss_last_mean", F.try_divide("loss_sum", "n_loss")).drop(*more)


def one_text(states: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """States per config and text as one per config, with the text of its first window.

    A text in the key of an aggregate costs nothing, one among its results would make it sort its rows.
    Nearly every config has one text, so this goes over a row per config.
    """
    every = Window.partitionBy(*CONFIG_KEYS)
    total = lambda c: F.sum(c).over(every)
    rows = states.withColumns({
        "k": F.row_number().over(every.orderBy("first_window", "hp_json")), "all_n": total("n"),
        "middle": F.coalesce(F.try_divide(total(F.col("n") * F.col("mean")), total("n")), F.lit(0.0))})
    apart = F.col("mean") - F.col("middle")
    rows = rows.withColumns({
        **{c: total(c) for c in ("n_windows", "n_failed", *SUMS, *more)},
        "m2": total(F.col("m2") + F.col("n") * apart * apart), "low": F.min("low").over(every), "high": F.max("high").over(every),
        "first_window": F.min("first_window").over(every), "last_window": F.max("last_window").over(every)})
    return rows.filter("k = 1").withColumns({"n": F.col("all_n"), "mean": F.col("middle")}).drop("k", "all_n", "middle")


def run_states(log: DataFrame) -> DataFrame:
    """Per (market, model, config): its windows, the failed ones, and the forecasts it made."""
    usable = F.exists("y_pred", lambda p: finite(p).isNotNull())
    return log.groupBy("market", "model", "config_index").agg(
        F.count_distinct("window_id").alias("n_windows"), F.count(_error(log)).alias("n_failed"),
        F.count_if(usable).alias("n_forecast"), F.min(_error(log)).alias("first_error"))


def unscored_runs(log: DataFrame) -> DataFrame:
    """The runs that ``config_scores`` leaves out of a deduplicated log, with the reason."""
    reason = F.when(F.col("n_failed") > 0, F.concat(
        "n_failed", F.lit(" of "), "n_windows", F.lit(" windows failed: "), "first_error")) \
        .when(F.col("n_forecast") == 0, F.lit("no forecast"))
    return run_states(log).withColumn("reason", reason).filter("reason IS NOT NULL") \
        .select("market", "model", "config_index", "n_windows", "n_failed", "reason")


def failed_fits(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error").isNotNull()).groupBy("market", "model", "error") \
              .agg(F.count(F.lit(1)).alias("n"))


def log_windows(log: DataFrame) -> DataFrame:
    """Distinct windows per config and the hyper-parameters of its first window."""
    return log.groupBy("market", "model", "config_index").agg(
        F.count_distinct("window_id").alias("n_windows"),
        F.min_by("hp_json", "window_id").alias("hyperparams_json"))


def mean_train_loss(log: DataFrame) -> DataFrame:
    return log.groupBy("market", "model", "config_index").agg(
        F.avg(finite("train_loss")).alias("train_loss_last_mean"))


def report_columns(t: Column, p: Column) -> dict[str, Column]:
    """The report's own metrics: finite pairs only, the normaliser is the mean of absolutes,
    and R2 is NULL below two pairs or for a constant truth."""
    ok = finite(t).isNotNull() & finite(p).isNotNull()
    t, p = F.when(ok, t), F.when(ok, p)
    e = p - t
    mse, spread = F.avg(e * e), F.var_pop(t)
    return {
        "MAPE": F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(REPORT_FLOOR))),
        "RMSE_over_mean_price": F.when(F.count(e) > 0, F.try_divide(
            F.sqrt(mse), F.greatest(F.avg(F.abs(t)), F.lit(REPORT_FLOOR)))),
        "R2": F.when((F.count(e) >= 2) & (spread > 0), 1 - F.try_divide(mse, spread)),
        "n_points": F.count(e),
    }


def safe_metrics(df: DataFrame, keys: Sequence[str], truth: str = "y_true",
                 prediction: str = "y_pred") -> DataFrame:
    cols = report_columns(F.col(truth), F.col(prediction))
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


def _chunk_column(trace: DataFrame, k: int, keys: Sequence[str], date: str) -> DataFrame:
    """Adds ``chunk``: 0..k-1 by cutting at floor(n*i/k), NULL for rows that belong to none.

    Only finite pairs count, and a piece needs two rows.  A trace has one row per date, which
    bounds the window over it.
    """
    ok = finite("y_true").isNotNull() & finite("y_pred").isNotNull()
    every = Window.partitionBy(*keys, "_ok")
    rows = trace.withColumn("_ok", ok).withColumns({
        "_r": F.row_number().over(every.orderBy(date)) - 1,
        "_n": F.count(F.lit(1)).over(every)})
    cut = [F.floor(F.col("_n") * i / k) for i in range(k + 1)]
    chunk = sum([(F.col("_r") >= c).cast("int") for c in cut[1:k]], F.lit(0))
    sizes = F.array(*[cut[i + 1] - cut[i] for i in range(k)])
    kept = F.col("_ok") & (F.col("_n") >= k) & (F.element_at(sizes, chunk + 1) >= 2)
    return rows.withColumn("chunk", F.when(kept, chunk)).drop("_ok", "_r", "_n")


def trace_chunks(trace: DataFrame, k: int = 3, keys: Sequence[str] = ("market", "model"),
                 date: str = "target_date") -> DataFrame:
    """The rows of each trace in ``k`` contiguous pieces."""
    return _chunk_column(trace, k, keys, date).filter(F.col("chunk").isNotNull())


def gold_metrics(trace: DataFrame, k: int = 3, keys: Sequence[str] = ("market", "model"),
                 date: str = "target_date") -> DataFrame:
    """Report metrics per chunk, averaged over the chunks, next to those of the whole trace.

    The whole counts as one more chunk (-1), so one pass gives both.
    """
    rows = _chunk_column(trace, k, keys, date).withColumn(
        "chunk", F.explode(F.array_compact(F.array(F.lit(-1), F.col("chunk")))))
    parts = safe_metrics(rows, [*keys, "chunk"])
    whole, names = F.col("chunk") == -1, ("MAPE", "RMSE_over_mean_price", "R2")
    return parts.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("n_points"))).alias("n_points"),
        *[F.avg(F.when(~whole, F.col(m))).alias(m) for m in names],
        *[F.max(F.when(whole, F.col(m))).alias(f"{m}_raw") for m in names])


def clipped_errors(trace: DataFrame, limit: float = ERROR_LIMIT) -> DataFrame:
    """Relative error of each forecast and the same clipped to the plotted range."""
    e = relative_error("y_true", "y_pred")
    return trace.withColumn("rel_error", e).withColumn(
        "clipped", F.when(F.col("rel_error").isNotNull(), F.greatest(
            F.least("rel_error", F.lit(limit)), F.lit(-limit))))


def clipped_error_counts(trace: DataFrame, limit: float = ERROR_LIMIT,
                         keys: Sequence[str] = ("market", "model")) -> DataFrame:
    return clipped_errors(trace, limit).groupBy(*keys).agg(
        F.count_if(F.abs("rel_error") > limit).alias("n_clipped"),
        F.count("rel_error").alias("n_points"),
        F.min("clipped").alias("min_clipped"), F.max("clipped").alias("max_clipped"))
