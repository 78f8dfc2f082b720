"""The inputs of the registered queries, derived by Spark from the given tables.

Everything reads whole tables: prices are the last order of a day per order priority, quotes the
last line of a ship date, logs are order lines (price against discounted price), and messy text
comes from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.clean import clean_prices, dedupe_last
from tidemark.operators.forecast import Config, full_grid, native_log
from tidemark.operators.metrics import config_scores
from tidemark.operators.traces import aligned_trace
from tidemark.operators.windows import next_price_label
from tidemark.plans.panel import build_panel
from tidemark.schema import BASELINE, NETS, PANEL_FEATURES
from tidemark.session import stored, use_utc
from tidemark.sources.market_files import quotes_series

START, END, OUTPUT_START = "1995-01-01", "2001-11-04", "1995-04-03"
HELD_OUT = "2000-01-01"
WINDOW, RATIO = 10, 0.1

MODELS = [BASELINE, *NETS, "mlp_wide"]  # one per line number 1..7
COMMODITIES = {"CL_F": "LN_1", "NG_F": "LN_2", "RB_F": "LN_3", "HRC_F": "LN_4", "ALI_F": "LN_5"}
MARKET_TICKERS = [
    ("1-URGENT", "RF_A", "RF_N"), ("2-HIGH", "RF_A", "RF_N"), ("3-MEDIUM", "RF_R", "RF_A"),
    ("4-NOT SPECIFIED", "RF_N", "RF_R"), ("5-LOW", "RF_R", "RF_N")]

LEARNERS = [
    Config(BASELINE, -1),
    Config("rolling_mean", 0, (("lookback", 3),)),
    Config("rolling_mean", 1, (("lookback", 5),)),
    Config("rolling_mean", 2, (("lookback", 9),)),
    Config("rolling_ols", 0)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf}/{name}.parquet")


def raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("market"), F.col("o_orderdate").cast("date").alias("d"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_prices(raw_prices(spark, sf), START, END)


def raw_quotes(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    ticker = F.explode(F.array(F.concat(F.lit("RF_"), "l_returnflag"),
                               F.concat(F.lit("LN_"), F.col("l_linenumber").cast("string"))))
    return lines.select(
        ticker.alias("ticker"), F.col("l_shipdate").cast("date").alias("d"),
        net.alias("adj_close"), F.col("l_extendedprice").alias("close"), line_number().alias("seq"))


def line_number() -> Column:
    """Place of a line among all lines: order, line, part; parts have at most 9 digits here."""
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Weekday quotes only: the calendar has no other days."""
    return quotes_series(raw_quotes(spark, sf)).filter(F.weekday("d") < 5)


def market_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        MARKET_TICKERS, "market string, equity_ticker string, fx_ticker string")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return build_panel(clean(spark, sf), market_config(spark), quotes(spark, sf), COMMODITIES,
                       START, END, OUTPUT_START)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return next_price_label(panel(spark, sf), PANEL_FEATURES)


def learner_log(spark: SparkSession, sf: str) -> DataFrame:
    return native_log(labelled(spark, sf), LEARNERS, WINDOW, RATIO)


def model_of_line() -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODELS]), F.col("l_linenumber").cast("int"))


def raw_line_log(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction log with one config per supplier; re-runs included.

    Truth is the list price of a line and the forecast its discounted, taxed price.
    """
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("market"), model_of_line().alias("model"),
        F.col("l_suppkey").cast("int").alias("config_index"),
        F.col("l_orderkey").alias("window_id"), F.col("l_partkey").alias("seq"),
        F.col("l_shipdate").cast("date").alias("end_date"),
        F.array(price).alias("y_true"),
        F.array(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred"))


RUN_WINDOW = ["market", "model", "config_index", "window_id"]
TASK_ROWS = 250_000


def line_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same with one row per window and the config text of the nets' grid.

    Every list has one value, so the last row of a window is picked by plain numbers.
    A supplier beyond the grid goes round to its start; a model outside the grid has no text.
    The grid is 2,026 rows.  Whole configs are dealt to tasks, of which there are as many as the lines ask
    for: no task grows with the table, and what goes by config or window needs no other shuffle.
    """
    tasks = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "lineitem").count() // TASK_ROWS))
    flat = raw_line_log(spark, sf).select(
        *RUN_WINDOW, "seq", "end_date", F.col("y_true")[0].alias("t"), F.col("y_pred")[0].alias("p")) \
        .repartition(tasks, *RUN_WINDOW[:3])
    log = dedupe_last(flat, RUN_WINDOW, "seq", ["end_date", "t", "p"]).select(
        *RUN_WINDOW, "end_date", F.array("t").alias("y_true"), F.array("p").alias("y_pred"))
    grid = full_grid(spark).select("model", F.col("config_index").alias("slot"), "hp_json")
    slot = F.when(F.col("model") == BASELINE, -1).otherwise(F.col("config_index") % 405)
    return log.withColumn("slot", slot).join(F.broadcast(grid), ["model", "slot"], "left") \
              .withColumn("hp_json", F.coalesce("hp_json", F.lit("{}"))).drop("slot")


def line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and forecast of every order line, without lists."""
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("market"), model_of_line().alias("model"),
        price.alias("y_true"),
        (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y_pred"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the order lines, at ten digits: equal scores are equal in their last bit, and
    what decides between them is the next key of the ranking."""
    df = config_scores(line_log(spark, sf))
    return df.withColumns({m: F.round(m, 10) for m in
                           ("MAPE", "RMSE_over_mean_price", "R2")}
                          | {m: F.round(m, 6) for m in ("MAE", "RMSE", "mean_price")})


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a written table, for reports that read their scores more than once."""
    return stored(scores(spark, sf), "scores")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """One forecast per (market, model, target date) of the order lines."""
    log = raw_line_log(spark, sf)
    newest = F.col("window_id") * 1_000_000_000 + F.col("seq")  # order, then part
    return aligned_trace(log.withColumn("window_id", newest))


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """Dates and prices as text, spoilt in a way that depends on the kind of event."""
    kind, value = F.col("event_type"), F.col("value").cast("decimal(18,2)").cast("string")
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), kind).alias("market"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.lit("2024-13-01")).otherwise(day).alias("raw_date"),
        F.when((kind == "error") & (F.col("value") < 10), "n/a")
        .when((kind == "error") & (F.col("value") < 20), "")
        .when((kind == "error") & (F.col("value") < 30), "0")
        .when(kind == "error", "inf")
        .when((kind == "view") & (F.col("value") < 5), F.concat(value, F.lit("d")))
        .otherwise(F.concat(F.lit(" "), value)).alias("raw_price"))


def hp_text(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary text in the forms that log files have."""
    props, kind = F.col("props"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind == "view", F.translate(props, '"', "'"))
        .when(kind == "error", F.translate(props, "}", ""))
        .when(kind == "signup", F.concat(F.lit('"'), F.replace(props, F.lit('"'), F.lit('""')),
                                         F.lit('"')))
        .otherwise(props).alias("text"), F.upper(kind).alias("model"))
