"""Configuration grids and walk-forward forecasts over them."""

from __future__ import annotations

import heapq
import json
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.indicators import series_window
from tidemark.operators.ranking import ordered_rank
from tidemark.operators.windows import number_rows, split_point, test_rows, train_frame
from tidemark.schema import (
    BASELINE, BASELINE_CONFIG, GRID_ACTIVATIONS, GRID_BATCHES, GRID_EPOCHS, GRID_LAYERS,
    GRID_RATES, GRID_UNITS, LOG_SCHEMA, NETS, TCN_KERNEL)
from tidemark.session import stored

# The fit function and its helpers travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Config:
    """A config of the grid; ``text``, if given, is how its parameters are spelt everywhere."""

    model: str
    config_index: int
    hp: tuple[tuple[str, object], ...] = ()
    text: str | None = None

    @property
    def hp_json(self) -> str:
        return self.text if self.text is not None else json.dumps(dict(self.hp), sort_keys=True)


BASELINE_ONLY = Config(BASELINE, BASELINE_CONFIG)


def net_value_lists(model: str) -> dict[str, list]:
    """The value lists of one net, outermost first."""
    tcn = model.lower() == "tcn"
    lists = {("channels" if tcn else "hidden_units"): GRID_UNITS,
             ("blocks" if tcn else "num_layers"): GRID_LAYERS}
    if tcn:
        lists["kernel_size"] = [TCN_KERNEL]
    return {**lists, "activation": GRID_ACTIVATIONS, "learning_rate": GRID_RATES,
            "batch_size": GRID_BATCHES, "epochs": GRID_EPOCHS}


def _config_columns(lists: dict[str, Sequence], index: Column) -> tuple[Column, Column]:
    """Map and text of the config at a place of the grid.

    The place counts like an odometer whose last list turns fastest, so each value is one of its
    digits.  Values are kept as text, so that a config has one spelling only.
    """
    stride, value = math.prod(len(v) for v in lists.values()), {}
    for name, values in lists.items():
        stride //= len(values)
        digit = F.floor(index / stride) % len(values) + 1
        value[name] = F.element_at(F.array(*[F.lit(str(v)) for v in values]), digit.cast("int"))
    words = {n for n, values in lists.items() if n != "learning_rate"
             and any(isinstance(v, str) for v in values)}
    pieces = [F.concat(F.lit(f'"{n}": "'), value[n], F.lit('"')) if n in words
              else F.concat(F.lit(f'"{n}": '), value[n]) for n in sorted(lists)]
    return (F.create_map(*[c for n in sorted(lists) for c in (F.lit(n), value[n])]),
            F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}")))


def config_grid(spark: SparkSession, model: str, lists: dict[str, Sequence]) -> DataFrame:
    """All combinations of the value lists as ``(model, config_index, hp, hp_json)``: a range
    with columns computed from it, no join."""
    size = math.prod(len(v) for v in lists.values())
    hp, text = _config_columns(lists, F.col("config_index"))
    return spark.range(size, numPartitions=1).select(
        F.lit(model).alias("model"), F.col("id").cast("int").alias("config_index")).select(
        "model", "config_index", hp.alias("hp"), text.alias("hp_json"))


def full_grid(spark: SparkSession) -> DataFrame:
    """The grids of all nets and the baseline, which has one config without parameters."""
    core, tcn = net_value_lists("mlp"), net_value_lists("tcn")
    size = math.prod(len(v) for v in core.values())  # that of the tcn's lists, too
    place = F.col("config_index")
    (hp, text), (tcn_hp, tcn_text) = _config_columns(core, place), _config_columns(tcn, place)
    base, is_tcn = F.col("model") == BASELINE, F.col("model") == "tcn"
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    net = F.element_at(F.array(*[F.lit(m) for m in NETS]), (F.col("id") / size).cast("int") + 1)
    first = F.col("id") < 0
    return spark.range(-1, size * len(NETS), numPartitions=1).select(
        F.when(first, BASELINE).otherwise(net).alias("model"),
        F.when(first, BASELINE_CONFIG).otherwise(F.col("id") % size).cast("int")
        .alias("config_index")).select(
        "model", "config_index",
        F.when(base, none).when(is_tcn, tcn_hp).otherwise(hp).alias("hp"),
        F.when(base, "{}").when(is_tcn, tcn_text).otherwise(text).alias("hp_json"))


def limit_configs(grid: DataFrame, k: int | None) -> DataFrame:
    return grid if k is None else grid.filter(F.col("config_index") < k)


def grid_configs(grid: DataFrame, max_configs: int | None = None) -> list[Config]:
    """A grid table as the configs that learners take: parameters typed, their text as it is.

    The grid is what the caller asks to be fitted, config by config; its rows are few next to the
    fits they stand for.
    """
    rows = limit_configs(grid, max_configs).select("model", "config_index", "hp_json").collect()
    return sorted((Config(r.model, r.config_index, tuple(json.loads(r.hp_json).items()), r.hp_json)
                   for r in rows), key=lambda c: (c.model, c.config_index))


def config_table(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    """Configs as a table, numbered by their ``place`` in the list."""
    return spark.createDataFrame([(i, c.model, c.config_index, c.hp_json) for i, c in enumerate(configs)],
                                 "place int, model string, config_index int, hp_json string")


def grid_cross(windows: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """Every window with every config: each window is numbered through the places of the grid, and
    the grid is looked up by place.  No join without a key, and no constant per config in the plan."""
    if not configs:
        return windows.select("*", F.lit(None).cast("string").alias("model"),
                              F.lit(None).cast("int").alias("config_index"),
                              F.lit(None).cast("string").alias("hp_json")).limit(0)
    place = F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))).alias("place")
    grid = config_table(windows.sparkSession, configs)
    return windows.select("*", place).join(grid, "place").select(
        *windows.columns, "model", "config_index", "hp_json")


def _log(rows: DataFrame, forecasts: Sequence[tuple[Config, Column]], places: bool = False) -> DataFrame:
    """Windows with one forecast column per config to log rows; with ``places`` only those that a row lists."""
    cells = [F.struct(
        F.lit(c.model).alias("model"), F.lit(c.config_index).alias("config_index"),
        F.lit(c.hp_json).alias("hp_json"), y.alias("y_pred")) for c, y in forecasts]

    def cell(place: Column) -> Column:
        out = F.when(place == 0, cells[0])
        for k, one in enumerate(cells[1:], 1):
            out = out.when(place == k, one)
        return out
    each = F.transform("places", cell) if places else F.array(*cells)
    return rows.select("market", "window_id", "start_date", "end_date", "y_true",
                       F.inline(each), F.lit(None).cast("double").alias("train_loss"),
                       F.lit(None).cast("string").alias("error"),
                       F.lit(None).cast("long").alias("run_seq")) \
               .select(*LOG_SCHEMA.fieldNames())


def places_of(todo: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """Per market the places in the list of configs that it is to run."""
    grid = config_table(todo.sparkSession, configs).select("place", "model", "config_index")
    return todo.select(*RUN_KEYS).join(grid, ["model", "config_index"]) \
        .groupBy("market").agg(F.sort_array(F.collect_set("place")).alias("places"))


RUN_KEYS = ["market", "model", "config_index"]


def window_counts(labelled: DataFrame, window_size: int, max_windows: int | None = None) -> DataFrame:
    """Per market the windows that a complete run has."""
    n = F.greatest(F.count(F.lit(1)) - (window_size - 1), F.lit(0))
    return labelled.groupBy("market").agg(
        (n if max_windows is None else F.least(n, F.lit(max_windows))).alias("n_expected"))


def all_runs(labelled: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """Every (market, model, config) of a grid run."""
    return grid_cross(labelled.select("market").distinct(), configs).select(*RUN_KEYS)


def native_log(labelled: DataFrame, configs: Sequence[Config], window_size: int,
               test_ratio: float, max_windows: int | None = None,
               todo: DataFrame | None = None) -> DataFrame:
    """Walk-forward log of the learners that are window functions, in one pass for all configs.

    * ``naive_last_price``: today's price,
    * ``rolling_mean`` (``lookback`` k): mean of the last k train labels,
    * ``rolling_ols``: straight line of y on Price over the train rows; where Price is constant
      in them, the mean of y.

    ``todo`` (market, model, config_index, perhaps ``first`` and ``last`` window) restricts the log to those runs: markets without any are not
    read, and of the others only the listed forecasts are made.
    """
    split = split_point(window_size, test_ratio)
    train = train_frame(window_size, test_ratio)
    w = series_window()
    extra: dict[str, Column] = {}
    forecasts: list[tuple[Config, Column]] = []
    ols = None
    for c in configs:
        if c.model == BASELINE:
            forecasts.append((c, F.col("prices")))
        elif c.model == "rolling_mean":
            k = int(dict(c.hp)["lookback"])
            if not 1 <= k <= split:
                raise ValueError(f"lookback {k} outside 1..{split}")
            extra[f"mean_{k}"] = F.avg("y").over(w.rowsBetween(-k, -1))
            forecasts.append((c, F.array_repeat(f"mean_{k}", F.size("prices"))))
        elif c.model == "rolling_ols":
            flat = F.min("Price").over(train) == F.max("Price").over(train)
            extra["slope"] = F.when(flat, 0.0).otherwise(
                F.regr_slope("y", "Price").over(train))
            extra["base"] = F.when(flat, F.avg("y").over(train)).otherwise(
                F.regr_intercept("y", "Price").over(train))
            forecasts.append((c, F.transform(
                "prices", lambda x: F.col("base") + F.col("slope") * x)))
        else:
            raise ValueError(f"{c.model} is not a native learner; use walk_forward_fit")
    if todo is None:
        return _log(test_rows(labelled, window_size, test_ratio, max_windows, extra=extra), forecasts)
    places = stored(places_of(todo, configs), "places")
    mine = labelled.join(places.select("market"), "market", "left_semi")
    rows = test_rows(mine, window_size, test_ratio, max_windows, extra=extra)
    log = _log(rows.join(places, "market"), forecasts, places=True)
    if "first" not in todo.columns:
        return log
    return log.join(todo.select(*RUN_KEYS, "first", "last"), RUN_KEYS) \
        .filter("window_id BETWEEN first AND last").select(log.columns)


def walk_forward_naive(labelled: DataFrame, window_size: int, test_ratio: float,
                       max_windows: int | None = None) -> DataFrame:
    return native_log(labelled, [BASELINE_ONLY], window_size, test_ratio, max_windows)


# ---- learners supplied by the caller ----------------------------------------------------

FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray, dict, int],
                      tuple[np.ndarray, float | None]]

def robust_scale(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q1, median, q3 = np.percentile(train, [25, 50, 75], axis=0)
    scale = np.where(q3 - q1 < 10 * np.finfo(float).eps, 1.0, q3 - q1)
    return (train - median) / scale, (test - median) / scale


def fit_window(x: np.ndarray, y: np.ndarray, split: int, hps: list[dict],
               fit_predict: FitPredict, seed: int):
    """Scale by the train rows only; per config fit, predict the test rows, undo the scaling of
    the labels.  Yields (forecast, loss, error); a forecast that is not one finite number per test
    row is an error."""
    x_train, x_test = robust_scale(x[:split], x[split:])
    mean, sd = y[:split].mean(), y[:split].std()
    sd = sd if sd > 0 else 1.0
    y_train = (y[:split] - mean) / sd
    for hp in hps:
        try:
            y_hat, loss = fit_predict(x_train, y_train, x_test, hp, seed)
            forecast = np.asarray(y_hat, dtype=float) * sd + mean
            if forecast.shape != (len(y) - split,) or not np.isfinite(forecast).all():
                raise ValueError("the forecast is not one finite number per test row")
            yield forecast.tolist(), loss, None
        except Exception as e:  # reported per fit, as data
            yield None, None, f"{type(e).__name__}: {e}"


Cost = Callable[[Config], float]


def config_parts(configs: Sequence[Config], size: int, cost: Cost | None = None) -> list[list[Config]]:
    """The configs in parts of at most ``size``, by ``cost`` of about equal cost: the dearest first, each
    into the cheapest part that has room.  Without a cost they stay in order."""
    if cost is None:
        return [list(configs[i:i + size]) for i in range(0, len(configs), size)]
    parts: list[list[Config]] = [[] for _ in range(-(-len(configs) // size))]
    room = [(0.0, k) for k in range(len(parts))]
    for c in sorted(configs, key=cost, reverse=True):
        total, k = heapq.heappop(room)
        parts[k].append(c)
        if len(parts[k]) < size:
            heapq.heappush(room, (total + cost(c), k))
    return parts


def work_units(counts: DataFrame, parts: Sequence[Sequence[Config]], block_windows: int, cost: Cost | None = None,
               todo: DataFrame | None = None) -> DataFrame:
    """What there is to fit: ``market``, ``block`` (of windows), ``part`` (of configs), ``runs`` and ``cost``.

    ``counts`` has ``n_expected`` windows per market.  ``runs`` lists the places in the part with the first and last
    window that each is to run, and is NULL where that is all of the block with all of the part.  ``todo`` has the runs, and if
    it has ``first`` and ``last`` the windows of each; a unit that nothing is to be done in is not there.
    """
    costs = [[float(cost(c)) if cost else 1.0 for c in part] for part in parts]
    windows = F.least(F.col("n_expected"), (F.col("block") + 1) * block_windows) - F.col("block") * block_windows
    blocks = counts.filter("n_expected > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_expected") - 1) / block_windows))))
    if todo is None:
        sums = F.array(*[F.lit(sum(part)) for part in costs])
        return blocks.select("market", "block", windows.alias("windows"), F.posexplode(sums).alias("part", "each")) \
            .select("market", "block", "part", F.lit(None).cast("array<struct<place:int,first:bigint,last:bigint>>").alias("runs"),
                    (F.col("windows") * F.col("each")).alias("cost"))
    grid = counts.sparkSession.createDataFrame(
        [(c.model, c.config_index, p, i, costs[p][i]) for p, part in enumerate(parts) for i, c in enumerate(part)],
        "model string, config_index int, part int, place int, each double")
    if "first" not in todo.columns:
        todo = todo.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(2**62)})
    runs = todo.select(*RUN_KEYS, "first", "last").join(grid, ["model", "config_index"]).join(counts, "market") \
        .withColumn("last", F.least("last", F.col("n_expected") - 1)).filter("first <= last")
    each = runs.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("first") / block_windows), F.floor(F.col("last") / block_windows)))) \
        .withColumns({"first": F.greatest("first", F.col("block") * block_windows),
                      "last": F.least("last", (F.col("block") + 1) * block_windows - 1)})
    return each.groupBy("market", "block", "part").agg(
        F.sort_array(F.collect_set(F.struct("place", "first", "last"))).alias("runs"),
        F.sum((F.col("last") - F.col("first") + 1) * F.col("each")).alias("cost"))


def slot_keys(spark: SparkSession, tasks: int) -> list[int]:
    """Per task a number that Spark's hash deals to it, so that work can be placed and its place be known to the planner."""
    found = spark.range(tasks * 64).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("task")) \
        .groupBy("task").agg(F.min("id").alias("id")).collect()
    keys = {r.task: r.id for r in found}
    return [keys[k] for k in range(tasks) if k in keys]


def placed(units: DataFrame, tasks: int) -> DataFrame:
    """Adds ``slot``, the key of the task that is to do a unit.

    Units in order of cost, the dearest first, are dealt out to the tasks there and back again, so that each
    task gets as many, dear and cheap ones alike.
    """
    keys = slot_keys(units.sparkSession, tasks)
    n = len(keys)
    ranked = ordered_rank(units.withColumn("_less", -F.col("cost")), [], "_less", ["market", "block", "part"], "_k").drop("_less")
    turn, at = F.floor((F.col("_k") - 1) / n), (F.col("_k") - 1) % n
    task = F.when(turn % 2 == 0, at).otherwise(n - 1 - at)
    return ranked.withColumn("slot", F.element_at(F.array(*map(F.lit, keys)), (task + 1).cast("int")).cast("long")).drop("_k")


def walk_forward_fit(labelled: DataFrame, features: Sequence[str], configs: Sequence[Config],
                     fit_predict: FitPredict, window_size: int, test_ratio: float,
                     max_windows: int | None = None, block_windows: int = 256,
                     block_configs: int = 256, seed: int = 42,
                     tasks: int | None = None, todo: DataFrame | None = None,
                     cost: Cost | None = None) -> DataFrame:
    """Walk-forward log of a learner the caller brings, one fit per (window, config).

    The work unit is a block of windows of one market with a part of the configs.  A unit gets the
    rows of its windows (the W-1 rows at an edge are in two blocks), never rows times configs;
    the grid travels with the function.  Units are bounded, so a market that holds a third of
    all rows is simply more units.  A fit that raises gives a row with ``error`` set and no
    forecast, and the job goes on.

    Little data means much work here, so the number of tasks (``tasks``, by default three per
    core) is set, and units are placed by what they cost (``cost`` of a config, by default the same
    for all) and not by a hash.  ``todo`` (market, model, config_index, perhaps ``first`` and ``last`` window) names the
    runs to fit; all others cost nothing.
    """
    split = split_point(window_size, test_ratio)
    block_windows = max(block_windows, window_size)
    grid = config_parts(configs, block_configs, cost)
    labels = [[(c.model, c.config_index, c.hp_json) for c in part] for part in grid]
    hps = [[dict(c.hp) for c in part] for part in grid]
    features = list(features)
    tasks = tasks or 3 * labelled.sparkSession.sparkContext.defaultParallelism

    labelled = labelled.select("market", "d", "y", *features)
    counts = window_counts(labelled, window_size, max_windows)
    units = stored(placed(work_units(counts, grid, block_windows, cost, todo), tasks), "units")
    rows = number_rows(labelled)
    if max_windows is not None:
        rows = rows.filter(F.col("r") < max_windows + window_size - 1)
    first = F.floor(F.greatest(F.col("r") - (window_size - 1), F.lit(0)) / block_windows)
    last = F.floor(F.col("r") / block_windows)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    # one row of a unit carries its runs
    work = rows.join(units.drop("cost"), ["market", "block"]) \
        .withColumn("runs", F.when(F.col("r") == F.col("block") * block_windows, F.col("runs"))) \
        .repartition(tasks, "slot")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, market, block, part = key
        pdf = pdf.sort_values("r")
        x, y = pdf[features].to_numpy(float), pdf["y"].to_numpy(float)
        d, r0 = pdf["d"].to_numpy(), int(pdf["r"].iloc[0])
        runs = pdf["runs"].iloc[0]
        out = []
        for k in range(block * block_windows, (block + 1) * block_windows):
            a, b = k - r0, k - r0 + window_size
            if b > len(pdf) or (max_windows is not None and k >= max_windows):
                break
            places = range(len(labels[part])) if runs is None else sorted(
                {int(u["place"]) for u in runs if u["first"] <= k <= u["last"]})
            if not places:
                continue
            mine, hp = [labels[part][i] for i in places], [hps[part][i] for i in places]
            truth = y[a + split:b].tolist()
            fits = fit_window(x[a:b], y[a:b], split, hp, fit_predict, seed)
            for (model, index, hp_json), (y_hat, loss, error) in zip(mine, fits):
                out.append((market, model, index, k, hp_json, d[a + split], d[b - 1], truth,
                            y_hat, loss, error, None))
        return pd.DataFrame(out, columns=LOG_SCHEMA.fieldNames()).astype({"run_seq": "Int64"})

    return work.groupBy("slot", "market", "block", "part").applyInPandas(run, LOG_SCHEMA)
