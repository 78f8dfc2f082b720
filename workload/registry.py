"""One query per operator: ``QUERIES[name](spark, sf_dir) -> DataFrame``.

Values are rounded at the very last step only, and days are shown as text, so that another
engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import parsing, values
from tidemark.operators import (
    calendar, clean, forecast, indicators, metrics, parts, ranking, reports, traces, windows)
from tidemark.plans import evaluate, panel as panels, tune as tuning
from tidemark.schema import (
    BASELINE, HP_ALIASES, MODEL_LABELS, NETS, PANEL_FEATURES)
from tidemark.session import fresh_path, stored, use_utc
from tidemark.sources import logs, market_files, panels as panel_files, results
from tidemark.streaming import scores as streaming
from workload import fixtures as fx
from workload.learners import line_and_mean, mean_of_layers, shifted_mean

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(use_utc(spark), sf)
    QUERIES[fn.__name__] = run
    return fn


def rd(c: Column | str, digits: int = 6) -> Column:
    """To a number of digits, up from .5129 instead of from one half.

    Prices and their means are short decimals, which lie on one half often; there the last bit
    would decide the digit shown.  Zero is never negative.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10.0 ** digits + 0.4871) / 10.0 ** digits + F.lit(0.0)


def day(c: Column | str = "d") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def show(df: DataFrame, *keys: str, **rounded: int) -> DataFrame:
    """Key columns as they are (dates as text), the others rounded to the given digits."""
    types = dict(df.dtypes)
    keep = [(day(k) if types[k] == "date" else F.col(k).cast("bigint")
             if types[k] == "int" else F.col(k)).alias(k) for k in keys]
    return df.select(*keep, *[rd(c, n).alias(c) for c, n in rounded.items()])


# ---- sources and sinks ------------------------------------------------------------------

@query
def read_labelled_csv(spark, sf):
    """Order lines written as text files with a title, a label row and blank cells, read back."""
    path = fresh_path(spark, "labelled")
    rows = fx.raw_prices(spark, sf).select(
        F.concat_ws(",", day(), F.lit(""), F.col("seq").cast("string"),
                    F.col("price").cast("string"), F.lit('" "'),
                    F.concat(F.lit('"'), "market", F.lit('"'))).alias("value"))
    heads = spark.createDataFrame([(',"Daily prices"',),
                                   ('Date,"Rate, fixed",Order,"Secondary Market"," ",Market',)],
                                  "value string")
    heads.union(rows).write.text(path)
    df = market_files.read_labelled_csv(spark, path, carry={"Market": "market"})
    df = df.groupBy("market", "d").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top"))
    return show(df, "market", "d", "n", top=2)


def labelled_lines(lines: DataFrame, head: str) -> DataFrame:
    """Lines of text files, each of which begins with the lines of ``head``, however many tasks write them."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(F.when(row == 0, F.concat(F.lit(f"{head}\n"), "value")).otherwise(F.col("value")).alias("value"))


@query
def read_labelled_folder(spark, sf):
    """Files of two layouts, the price in another place in each, read back whole."""
    path = fresh_path(spark, "layouts")
    rows = fx.raw_prices(spark, sf).withColumn("market", F.concat(F.lit('"'), "market", F.lit('"')))
    parts = [("seq % 2 = 0", 'Date,Order,"Secondary Market",Market', ["seq", "price", "market"]),
             ("seq % 2 = 1", 'Date,"Rate, fixed",Market,Other,Order,"Secondary Market"',
              [F.lit("1"), "market", F.lit(""), "seq", "price"])]
    for i, (mine, head, columns) in enumerate(parts):
        text = rows.filter(mine).select(F.concat_ws(",", day(), *[
            F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value"))
        head = f',"Layout {i}"\n{head}'
        empty = spark.createDataFrame([(head,)], "value string").coalesce(1)
        empty.union(labelled_lines(text, head)).write.text(f"{path}/{i}")
    df = market_files.read_labelled_csv(spark, path, carry={"Market": "market", "Order": "seq"})
    return show(df.withColumn("seq", F.col("seq").cast("bigint")), "market", "seq", "d", price=2)


@query
def passed_over_files(spark, sf):
    """Two folders of files without label rows beside others with them, which agree in one folder only."""
    path = fresh_path(spark, "parts")
    rows = fx.raw_prices(spark, sf).withColumn("market", F.concat(F.lit('"'), "market", F.lit('"')))
    heads = ["Date,Secondary Market,Market", "Date,Market,Secondary Market"]
    columns = [["price", "market"], ["market", "price"]]
    for folder, layouts in (("agree", (0, 0, 0)), ("differ", (0, 1, 0))):
        for part, layout in enumerate(layouts):
            text = rows.filter(F.col("seq") % 3 == part).select(
                F.concat_ws(",", day(), *[F.col(c).cast("string") for c in columns[layout]]).alias("value"))
            if part < 2:
                text = labelled_lines(text, heads[layout])
            text.write.mode("append").text(f"{path}/{folder}")
    df = market_files.passed_over_files(spark, path).withColumn("folder", F.regexp_extract("file", "/([^/]*)/[^/]*$", 1)) \
        .filter("file LIKE '%/part-%'").groupBy("folder", "reason").agg(F.sum("n_rows").alias("n_rows"))
    return show(df, "folder", "reason", "n_rows")


@query
def read_two_column(spark, sf):
    df = fx.messy(spark, sf).select("raw_date", "raw_price", "market", "seq")
    return show(market_files.read_two_column(df, keep=["market", "seq"]),
                "market", "seq", "d", price=2)


@query
def read_price_sheet(spark, sf):
    price = F.col("l_extendedprice")
    df = fx.table(spark, sf, "lineitem").select(
        day("l_shipdate").alias(" Date "), price.cast("string").alias("Close"),
        (price * (1 - F.col("l_discount"))).cast("string").alias(" Adj Close"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    df = market_files.read_price_sheet(
        df, keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return show(df, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d", price=3)


@query
def quotes_series(spark, sf):
    return show(market_files.quotes_series(fx.raw_quotes(spark, sf)),
                "ticker", "d", price=3)


@query
def read_panel(spark, sf):
    """A panel stored as CSV under another date name, read back with its slice."""
    path = fresh_path(spark, "panel-csv")
    fx.panel(spark, sf).withColumnRenamed("d", "Unnamed: 0").write.option("header", True).csv(path)
    df = panel_files.read_panel(spark, path, "1996-01-01", "2001-06-30", format="csv")
    return show(df, "market", "d", Price=2, equity_index=4, RSI_14=6, CO_chaikin_3_10=6)


@query
def read_logs(spark, sf):
    path = fresh_path(spark, "logs")
    logs.write_log_files(fx.learner_log(spark, sf), path)
    df = logs.read_logs(spark, path).withColumns({
        "t": parsing.list_first("y_true"), "p": parsing.list_first("y_pred")})
    return show(df, "market", "model", "config_index", "window_id", "hp_json", "start_date",
                "end_date", t=2, p=3)


@query
def read_scores(spark, sf):
    path = fresh_path(spark, "scores")
    results.write_metrics(fx.scores(spark, sf), path, results.SCORE_SCHEMA.fieldNames())
    return show(results.read_scores(spark, path), "market", "model", "config_index", "n_windows",
                "n_samples", "hyperparams_json", MAPE=8, RMSE_over_mean_price=8, R2=8, MAE=4)


@query
def read_best_configs(spark, sf):
    path = fresh_path(spark, "best")
    results.write_best_configs(ranking.best_by_market_model(fx.scores(spark, sf)), path)
    df = results.read_best_configs(spark, path).withColumn(
        "epochs", F.try_element_at("hyperparams", F.lit("epochs")))
    return show(df, "market", "model", "config_index", "epochs", "n_samples", MAPE=8, R2=8)


@query
def write_panel(spark, sf):
    path = fresh_path(spark, "panel")
    panel_files.write_panel(fx.panel(spark, sf), path)
    return show(spark.read.parquet(path), "market", "d", Price=2, equity_index=4, fx_rate=4, CL_F=4,
                RSI_14=6, CO_chaikin_3_10=6)


@query
def bad_log_files(spark, sf):
    """Log files of two runs, one of them without the forecasts."""
    path = fresh_path(spark, "mixed-logs")
    log = fx.line_log(spark, sf).withColumn("start_date", F.col("end_date"))
    logs.write_log_files(log.filter(F.col("model") != "tcn"), path, compression="gzip")
    poor = logs.to_log_file_columns(log.filter(F.col("model") == "tcn")) \
               .drop("window_id", "test_data_model_predictions_list")
    poor.write.mode("append").option("header", True).option("compression", "gzip").csv(f"{path}/poor")
    bad = logs.bad_log_files(spark, path).groupBy("missing").agg(F.lit("found").alias("kind"))
    read = logs.read_logs(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return read.select("model", "n").union(bad.select("missing", F.lit(0).cast("bigint")))


@query
def append_log(spark, sf):
    """Two runs appended to one log, then resumed: the second holds what the first lacked."""
    path = fresh_path(spark, "log")
    lab = fx.labelled(spark, sf)
    logs.append_log(forecast.native_log(lab, fx.LEARNERS[:2], fx.WINDOW, fx.RATIO), path)
    rest = forecast.native_log(lab, fx.LEARNERS, fx.WINDOW, fx.RATIO)
    logs.append_log(logs.resume_anti(rest, logs.read_log_table(spark, path)), path)
    return show_log(logs.read_log_table(spark, path))


@query
def write_metrics(spark, sf):
    path = fresh_path(spark, "metrics")
    scored = tuning.tuning_scores(fx.learner_log(spark, sf), fx.WINDOW, fx.RATIO)
    results.write_metrics(scored, path)
    df = spark.read.option("header", True).option("escape", '"').option("inferSchema", True) \
              .csv(path)
    return show(df, "market", "model", "config_index", "window_size", "n_windows",
                "hyperparams_json", test_ratio=2, MAPE=8, R2=8)


@query
def best_configs_json(spark, sf):
    docs = results.best_configs_json(ranking.best_by_market_model(fx.scores(spark, sf)))
    kind = ("map<string, map<string, struct<config_index: bigint, n_windows: bigint, n_samples: bigint, MAPE: double, "
            "R2: double, MAE: double, hyperparams: map<string, string>, hyperparams_json: string>>>")
    rows = docs.select(F.explode(F.from_json("document", kind)).alias("market", "models")) \
        .select("market", F.explode("models").alias("model", "row")).select("market", "model", "row.*") \
        .withColumn("epochs", F.try_element_at("hyperparams", F.lit("epochs")))
    return show(rows, "market", "model", "config_index", "n_windows", "n_samples", "epochs", "hyperparams_json",
                MAPE=8, R2=8, MAE=4)


@query
def resume_anti(spark, sf):
    """Grid configs that no order line has run yet."""
    grid = forecast.full_grid(spark).select("model", "config_index", "hp_json")
    return show(logs.resume_anti(grid, fx.raw_line_log(spark, sf), ["model", "config_index"]),
                "model", "config_index", "hp_json")


@query
def missing_inputs(spark, sf):
    """Customers without any urgent order."""
    expected = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    present = fx.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'") \
        .select(F.col("o_custkey").alias("custkey"))
    return market_files.missing_inputs(expected, present, ["custkey"])


# ---- projections, filters, predicates ---------------------------------------------------

@query
def numeric_coerce(spark, sf):
    df = fx.messy(spark, sf).select("seq", values.numeric_coerce("raw_price").alias("price"))
    return show(df, "seq", price=2)


@query
def date_coerce(spark, sf):
    df = fx.messy(spark, sf).select("seq", values.date_coerce("raw_date").alias("d"))
    return show(df.filter(F.col("d").isNotNull()), "seq", "d")


@query
def drop_null_zero(spark, sf):
    return show(clean.drop_null_zero(clean.coerce_rows(fx.messy(spark, sf))), "seq", price=2)


@query
def positive_price(spark, sf):
    """Balances below zero are no prices."""
    df = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return show(clean.positive_price(df, "c_acctbal"), "c_custkey", c_acctbal=2)


@query
def business_days(spark, sf):
    return show(clean.business_days_only(fx.raw_prices(spark, sf)), "market", "seq", "d")


@query
def date_slice(spark, sf):
    return show(clean.date_slice(fx.raw_prices(spark, sf), "1996-02-29", "1999-12-31"),
                "seq", "d", price=2)


@query
def dedupe_last(spark, sf):
    return show(clean.dedupe_last(fx.raw_prices(spark, sf), ["market", "d"], "seq", ["price"]),
                "market", "d", price=2)


@query
def clean_prices(spark, sf):
    return show(clean.clean_prices(clean.coerce_rows(fx.messy(spark, sf))), "market", "d", price=2)


@query
def normalise_headers(spark, sf):
    df = fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias(" key\u00a0"), F.col("s_name").alias("\u00a0 Name "), "s_nationkey")
    return show(clean.normalise_headers(df, {"Name": "name"}), "key", "name", "s_nationkey")


@query
def find_column(spark, sf):
    df = fx.table(spark, sf, "part")
    name = clean.find_column(df, "price", "P_RETAILPRICE", "p_size")
    return show(df.select("p_partkey", F.col(name).alias("price")), "p_partkey", price=2)


@query
def project_order(spark, sf):
    return clean.project_order(fx.table(spark, sf, "supplier"),
                               ["s_name", "absent", "s_suppkey", "s_nationkey"])


@query
def model_name_case(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", values.model_name_case("p_type").alias("lower_name"),
                    values.model_name_case(F.concat(F.lit(" "), "p_name"), upper=True)
                    .alias("upper_name"))


@query
def drop_baseline(spark, sf):
    df = clean.drop_baseline(fx.raw_line_log(spark, sf))
    return df.groupBy("market", "model").agg(F.count(F.lit(1)).alias("n"))


@query
def keep_listed(spark, sf):
    df = clean.keep_listed(fx.raw_line_log(spark, sf), "model", ["tcn", "gru", "absent", "mlp"])
    return show(df.groupBy("market", "model", "ord").agg(F.count(F.lit(1)).alias("n")),
                "market", "model", "ord", "n")


@query
def feature_columns(spark, sf):
    """Every column but the target and the dropped ones; rows with a missing one go."""
    lab = fx.panel(spark, sf).withColumn("y", F.col("Price") * 1.0)
    lab = clean.complete_rows(lab, clean.feature_columns(lab, drop=["market", "d"]))
    return show(lab, "market", "d", Price=2, RSI_14=6)


@query
def feature_groups(spark, sf):
    long = fx.panel(spark, sf).unpivot(["market", "d"], PANEL_FEATURES, "feature", "value")
    df = long.withColumn("kind", reports.feature_group("feature")) \
             .groupBy("feature", "kind").agg(F.count("value").alias("n"))
    return show(df, "feature", "kind", "n")


@query
def price_feature_pairs(spark, sf):
    df = reports.price_feature_pairs(
        clean.date_slice(fx.panel(spark, sf), "1995-09-01", "2001-01-02"),
        [c for c in PANEL_FEATURES if c != "Price"])
    return show(df, "market", "d", "feature", Price=2, value=4)


@query
def recode_labels(spark, sf):
    df = fx.raw_line_log(spark, sf).select(
        "market", values.recode("model", MODEL_LABELS).alias("label"),
        values.recode("market", {"AF": "closed A", "NO": "open N"}).alias("market_abbr"))
    return df.groupBy("market", "label", "market_abbr").agg(F.count(F.lit(1)).alias("n"))


@query
def log_floor(spark, sf):
    df = fx.table(spark, sf, "customer").select(
        "c_custkey", F.ln(values.log_floor("c_acctbal")).alias("ln_price"))
    return show(df, "c_custkey", ln_price=6)


@query
def target_date(spark, sf):
    df = fx.raw_prices(spark, sf).select("seq", "d", values.target_date("d").alias("target"))
    return show(df, "seq", "d", "target")


@query
def safe_slug(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", values.safe_slug("url").alias("slug"))


# ---- joins ------------------------------------------------------------------------------

@query
def calendar_reindex(spark, sf):
    return show(calendar.calendar_reindex(fx.clean(spark, sf), fx.START, fx.END),
                "market", "d", price=2)


@query
def market_config_join(spark, sf):
    df = panels.market_config_join(fx.clean(spark, sf), fx.market_config(spark))
    return show(df, "market", "d", "equity_ticker", "fx_ticker", price=2)


@query
def feature_join(spark, sf):
    prices = calendar.fill_calendar(fx.clean(spark, sf), fx.START, fx.END)
    df = panels.feature_join(prices, fx.market_config(spark), fx.quotes(spark, sf),
                             fx.COMMODITIES, fx.START, fx.END)
    return show(df, "market", "d", price=4, equity_index=4, fx_rate=4, CL_F=4, NG_F=4, RB_F=4,
                HRC_F=4, ALI_F=4)


@query
def unused_tickers(spark, sf):
    """Market and ticker pairs without quotes: nations as markets, line numbers as tickers."""
    config = fx.table(spark, sf, "nation").select(
        F.col("n_name").alias("market"), F.concat(F.lit("LN_"), F.col("n_nationkey").cast("string"))
        .alias("equity_ticker"), F.lit("RF_A").alias("fx_ticker"))
    return panels.unused_tickers(config, fx.quotes(spark, sf)).select("market", "ticker")


@query
def technicals_join(spark, sf):
    return show(fx.panel(spark, sf), "market", "d", Price=4, equity_index=4, fx_rate=4, CL_F=4,
                NG_F=4, RB_F=4, HRC_F=4, ALI_F=4, SMA_5=4, PPO_12_26=6, RSI_14=6, ROC_10=6,
                ATR_14=4, CO_chaikin_3_10=6)


@query
def grid_cross(spark, sf):
    w = windows.test_rows(fx.labelled(spark, sf), fx.WINDOW, fx.RATIO)
    return show(forecast.grid_cross(w, fx.LEARNERS), "market", "window_id", "start_date",
                "model", "config_index", "hp_json")


@query
def best_config_join(spark, sf):
    best = ranking.best_by_market_model(clean.drop_baseline(fx.stored_scores(spark, sf)))
    return show(evaluate.best_config_join(best), "market", "model", "config_index",
                "hyperparams_json")


@query
def observed_in_range(spark, sf):
    return show(calendar.observed_in_range(fx.raw_prices(spark, sf), fx.OUTPUT_START, fx.END),
                "market", "seq", "d")


@query
def attach_hp(spark, sf):
    overall = reports.cfg_overall(reports.cfg_market(
        clean.drop_baseline(fx.scores(spark, sf))))
    return show(reports.attach_hp(overall), "model", "hyperparams_json", "markets_covered",
                *[f"hp_{n}" for n in HP_ALIASES], mean_MAPE=8, mean_R2=8)


@query
def align_models(spark, sf):
    df = traces.align_models(fx.trace(spark, sf), fx.MODELS)
    return show(df, "market", "target_date", y_true=2, **{m: 4 for m in fx.MODELS})


@query
def align_models_outer(spark, sf):
    df = traces.align_models(fx.trace(spark, sf), fx.MODELS, how="outer")
    return show(df, "market", "target_date", y_true=2, **{m: 4 for m in fx.MODELS})


@query
def ordered_grid_join(spark, sf):
    best = ranking.best_by_market_model(fx.scores(spark, sf))
    df = reports.ordered_pivot(best, "MAPE", ["RO", "AF", "XX", "NF"], ["tcn", "mlp", "absent"])
    return show(df, "ord", "market", tcn=8, mlp=8, absent=8)


# ---- aggregations -----------------------------------------------------------------------

@query
def forecast_metrics(spark, sf):
    df = metrics.forecast_metrics(fx.line_pairs(spark, sf), ["market", "model"])
    return show(df, "market", "model", "n_samples", MAPE=8, RMSE_over_mean_price=8, MAE=4, R2=8,
                RMSE=4, mean_price=4)


def show_scores(df: DataFrame, *more: str) -> DataFrame:
    return show(df, "market", "model", "config_index", "n_windows", "n_samples",
                "hyperparams_json", *more, MAPE=8, RMSE_over_mean_price=8, MAE=4, R2=8, RMSE=4,
                mean_price=4)


@query
def config_scores(spark, sf):
    return show_scores(fx.scores(spark, sf))


@query
def learner_scores(spark, sf):
    return show_scores(metrics.config_scores(fx.learner_log(spark, sf)))


@query
def log_windows(spark, sf):
    return show(metrics.log_windows(fx.line_log(spark, sf)), "market", "model", "config_index",
                "n_windows", "hyperparams_json")


@query
def safe_metrics(spark, sf):
    df = metrics.safe_metrics(fx.line_pairs(spark, sf), ["market", "model"])
    return show(df, "market", "model", "n_points", MAPE=8, RMSE_over_mean_price=8, R2=8)


@query
def gold_metrics(spark, sf):
    df = metrics.gold_metrics(fx.trace(spark, sf))
    return show(df, "market", "model", "n_points", MAPE=8, RMSE_over_mean_price=8, R2=8,
                MAPE_raw=8, RMSE_over_mean_price_raw=8, R2_raw=8)


@query
def coverage_stats(spark, sf):
    df = calendar.coverage_stats(fx.clean(spark, sf), fx.OUTPUT_START, fx.END)
    return show(df, "market", "earliest", "latest", "total_bd", "observed_bd", "filled_bd",
                pct_filled=6)


def best(spark, sf):
    return ranking.best_by_market_model(fx.scores(spark, sf))


@query
def model_averages(spark, sf):
    return show(reports.model_averages(best(spark, sf)), "model", "markets_covered",
                mean_MAPE=8, mean_RMSE=4, mean_R2=8)


@query
def model_summary(spark, sf):
    return show(reports.model_summary(fx.stored_scores(spark, sf)), "model", "markets_covered",
                mean_MAPE=8, median_MAPE=8, mean_R2=8, median_R2=8)


@query
def configs_across_markets(spark, sf):
    return show(reports.configs_across_markets(fx.scores(spark, sf)), "model",
                "hyperparams_json", "markets_covered", mean_MAPE=8, mean_RMSE_over_mean_price=8,
                mean_MAE=4, mean_R2=8)


def per_market(spark, sf, written=False):
    scores = (fx.stored_scores if written else fx.scores)(spark, sf)
    return reports.cfg_market(clean.drop_baseline(scores))


@query
def cfg_market(spark, sf):
    return show(per_market(spark, sf), "market", "model", "hyperparams_json", MAPE=8, R2=8)


@query
def cfg_overall(spark, sf):
    return show(reports.cfg_overall(per_market(spark, sf)), "model", "hyperparams_json",
                "markets_covered", mean_MAPE=8, mean_R2=8)


@query
def hp_sensitivity(spark, sf):
    df = reports.hp_sensitivity(reports.attach_hp(reports.cfg_overall(per_market(spark, sf, True))))
    return show(df, "model", "hp", "value", mean_MAPE=8, value_order=6)


@query
def error_histogram(spark, sf):
    df = reports.error_histogram(reports.cfg_overall(per_market(spark, sf)))
    return show(df, "model", "bin", "n", left_edge=6, share=8)


@query
def clipped_errors(spark, sf):
    df = metrics.clipped_errors(fx.trace(spark, sf), limit=0.05)
    return show(df, "market", "model", "target_date", rel_error=8, clipped=8)


@query
def clipped_error_counts(spark, sf):
    df = metrics.clipped_error_counts(fx.trace(spark, sf), limit=0.05)
    return show(df, "market", "model", "n_clipped", "n_points", min_clipped=6, max_clipped=6)


@query
def axis_bounds(spark, sf):
    return show(reports.axis_bounds(reports.rank_curve_by_market(per_market(spark, sf, True))),
                "model", lo=8, hi=8)


@query
def mean_train_loss(spark, sf):
    """Loss of a window: the tax of its line, where there is one."""
    log = fx.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("market"), fx.model_of_line().alias("model"),
        F.col("l_suppkey").cast("int").alias("config_index"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(float("nan")).alias("train_loss"))
    return show(metrics.mean_train_loss(log), "market", "model", "config_index",
                train_loss_last_mean=8)


@query
def metric_pivot(spark, sf):
    df = reports.metric_pivot(best(spark, sf), "R2", fx.MODELS)
    return show(df, "market", **{m: 8 for m in fx.MODELS})


@query
def robust_scale_stats(spark, sf):
    """Features at eight digits, so that a flat stretch has no spread in its last bits."""
    lab = fx.labelled(spark, sf).withColumns({c: F.round(c, 8) for c in PANEL_FEATURES})
    df = windows.robust_scale_stats(lab, PANEL_FEATURES, fx.WINDOW, fx.RATIO)
    return show(df, "market", "feature", "window_id", median=4, iqr=4)


def rounded_labelled(spark, sf):
    return stored(fx.labelled(spark, sf).withColumns({c: F.round(c, 8) for c in PANEL_FEATURES}), "labelled")


@query
def robust_scales_sliding(spark, sf):
    """The same from sorted buffers."""
    df = parts.robust_scale_sliding(rounded_labelled(spark, sf), PANEL_FEATURES, fx.WINDOW, fx.RATIO, 300, BUCKET)
    return show(df, "market", "feature", "window_id", median=4, iqr=4)


@query
def robust_scales_wide(spark, sf):
    """Windows of 250 rows."""
    df = parts.robust_scale_sliding(rounded_labelled(spark, sf), PANEL_FEATURES, 250, fx.RATIO, 500, BUCKET)
    return show(df, "market", "feature", "window_id", median=4, iqr=4)


@query
def standard_scale_stats(spark, sf):
    df = windows.standard_scale_stats(fx.labelled(spark, sf), fx.WINDOW, fx.RATIO)
    return show(df, "market", "window_id", y_mean=4, y_scale=4)


def held_out(spark, sf):
    lab = stored(fx.labelled(spark, sf), "labelled")
    tuned = tuning.tune(clean.date_slice(lab, end="1999-12-31"), fx.LEARNERS, fx.WINDOW, fx.RATIO)
    return evaluate.evaluate_best(clean.date_slice(lab, fx.HELD_OUT), tuned, fx.LEARNERS,
                                  fx.WINDOW, fx.RATIO)


@query
def test_metrics(spark, sf):
    log = forecast.native_log(clean.date_slice(fx.labelled(spark, sf), fx.HELD_OUT), fx.LEARNERS,
                              fx.WINDOW, fx.RATIO)
    df = evaluate.held_out_metrics(log, fx.WINDOW, fx.RATIO)
    return show_scores(df, "window_size", "reason")


@query
def run_counts(spark, sf):
    return show(reports.run_counts(fx.scores(spark, sf)), "n_rows", "n_markets", "n_models",
                "n_configs")


# ---- the same by parts of a series -------------------------------------------------------

#: Days of a bucket and rows of a part: each series of the tables is cut into some twenty.
BUCKET, PART = 120, 90


@query
def fill_in_buckets(spark, sf):
    df = parts.fill_calendar_parts(fx.clean(spark, sf), fx.START, fx.END, BUCKET)
    return show(df.withColumn("is_filled", F.col("is_filled").cast("int")), "market", "d", "is_filled", price=4)


@query
def technicals_in_parts(spark, sf):
    df = stored(parts.fill_calendar_parts(fx.clean(spark, sf), fx.START, fx.END, BUCKET), "filled")
    return show(parts.technicals_parts(df.drop("is_filled"), PART, BUCKET), "market", "d", SMA_5=4, PPO_12_26=6,
                RSI_14=6, ROC_10=6, ATR_14=4, CO_chaikin_3_10=6)


@query
def labels_in_parts(spark, sf):
    df = parts.next_price_label_parts(stored(fx.panel(spark, sf), "panel"), PANEL_FEATURES, PART, BUCKET)
    return show(df, "market", "d", Price=4, y=4)


@query
def scales_in_parts(spark, sf):
    df = parts.standard_scale_parts(stored(fx.labelled(spark, sf), "labelled"), fx.WINDOW, fx.RATIO, PART, BUCKET)
    return show(df, "market", "window_id", y_mean=4, y_scale=4)


@query
def naive_score_in_parts(spark, sf):
    """The naive walk-forward score of every business day, from fill to forecast by parts."""
    df = stored(parts.fill_calendar_parts(fx.clean(spark, sf), fx.START, fx.END, BUCKET).select(
        "market", "d", F.col("price").alias("Price")), "filled")
    labelled = stored(parts.next_price_label_parts(df, ["Price", "y"], PART, BUCKET), "labelled")
    rows = parts.test_rows_parts(labelled, fx.WINDOW, fx.RATIO, PART, BUCKET)
    log = rows.select("market", F.lit("naive_last_price").alias("model"), F.lit(-1).alias("config_index"), "window_id",
                      "y_true", F.col("prices").alias("y_pred"), F.lit("{}").alias("hp_json"))
    return show_scores(metrics.config_scores(log))


# ---- window functions -------------------------------------------------------------------

def filled(spark, sf, **parts):
    return calendar.fill_calendar(fx.clean(spark, sf), fx.START, fx.END, **parts)


@query
def time_interpolate(spark, sf):
    return show(filled(spark, sf, leading=False, trailing=False), "market", "d", price=4)


@query
def fill_forward(spark, sf):
    return show(filled(spark, sf, leading=False), "market", "d", price=4)


@query
def fill_backward(spark, sf):
    df = filled(spark, sf).withColumn("is_filled", F.col("is_filled").cast("int"))
    return show(df, "market", "d", "is_filled", price=4)


def on_prices(spark, sf):
    return filled(spark, sf), indicators.series_window()


@query
def sma_5(spark, sf):
    df, w = on_prices(spark, sf)
    return show(df.withColumn("SMA_5", indicators.sma("price", 5, w)), "market", "d", SMA_5=4)


@query
def ema(spark, sf):
    df, w = on_prices(spark, sf)
    df = indicators.ewm(df, {"ema_12": ("price", indicators.span_alpha(12)),
                             "ema_26": ("price", indicators.span_alpha(26))}, w)
    return show(df, "market", "d", ema_12=4, ema_26=4)


@query
def ppo_12_26(spark, sf):
    return show(indicators.technicals(filled(spark, sf)), "market", "d", PPO_12_26=6)


@query
def price_delta(spark, sf):
    df, w = on_prices(spark, sf)
    return show(indicators.price_delta(df, w), "market", "d", delta=4, gain=4, loss=4)


@query
def rsi_14(spark, sf):
    return show(indicators.technicals(filled(spark, sf)), "market", "d", RSI_14=6)


@query
def roc_10(spark, sf):
    df, w = on_prices(spark, sf)
    return show(df.withColumn("ROC_10", indicators.roc("price", 10, w)), "market", "d", ROC_10=6)


@query
def atr_14(spark, sf):
    df, w = on_prices(spark, sf)
    df = indicators.price_delta(df, w).withColumn("ATR_14", indicators.atr("delta", 14, w))
    return show(df, "market", "d", ATR_14=4)


@query
def direction(spark, sf):
    df, w = on_prices(spark, sf)
    df = indicators.price_delta(df, w).withColumn("direction", indicators.direction("delta"))
    return show(df, "market", "d", "direction")


@query
def adl_cumsum(spark, sf):
    df, w = on_prices(spark, sf)
    df = indicators.price_delta(df, w).withColumn(
        "adl", F.sum(indicators.direction("delta")).over(w.rowsBetween(-2**63, 0)))
    return show(df, "market", "d", "adl")


@query
def chaikin_3_10(spark, sf):
    return show(indicators.technicals(filled(spark, sf)), "market", "d", CO_chaikin_3_10=6)


@query
def next_price_label(spark, sf):
    return show(fx.labelled(spark, sf), "market", "d", Price=4, y=4)


@query
def sliding_windows(spark, sf):
    df = windows.sliding_windows(fx.labelled(spark, sf), fx.WINDOW, fx.RATIO)
    return show(df, "market", "window_id", "pos", "d", y=4)


@query
def train_test_split(spark, sf):
    df = windows.sliding_windows(fx.labelled(spark, sf), 20, 0.15)
    df = df.groupBy("market", "window_id").agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        F.max(F.when(F.col("is_train"), F.col("d"))).alias("last_train"),
        F.min(F.when(~F.col("is_train"), F.col("d"))).alias("first_test"))
    return show(df, "market", "window_id", "n_train", "n_test", "last_train", "first_test")


@query
def short_series(spark, sf):
    """Customers with fewer orders than a window has rows."""
    df = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("market"))
    return windows.short_series(df, fx.WINDOW)


@query
def rank_in_market(spark, sf):
    return show(ranking.rank_in_market(fx.stored_scores(spark, sf)), "market", "model", "config_index",
                "rank_in_market", MAPE=8)


@query
def best_by_market_model(spark, sf):
    return show_scores(best(spark, sf))


@query
def best_by_model(spark, sf):
    df = ranking.best_by_model(reports.configs_across_markets(fx.scores(spark, sf)))
    return show(df, "model", "hyperparams_json", "markets_covered", mean_MAPE=8, mean_R2=8)


@query
def top_n_per_market(spark, sf):
    order = [*ranking.lowest("MAPE", "RMSE"), *ranking.highest("R2"),
             *ranking.lowest("model", "config_index")]
    df = ranking.top_n(fx.scores(spark, sf), ["market"], order, 50, rank="place")
    return show(df, "market", "place", "model", "config_index", MAPE=8)


@query
def trace_chunks(spark, sf):
    df = metrics.trace_chunks(fx.trace(spark, sf))
    return show(df, "market", "model", "target_date", "chunk", y_true=2, y_pred=4)


@query
def rank_curve_pooled(spark, sf):
    return show(reports.rank_curve_pooled(per_market(spark, sf, True)), "model", "rank", MAPE=8, R2=8)


@query
def rank_curve_by_market(spark, sf):
    return show(reports.rank_curve_by_market(per_market(spark, sf, True)), "model", "rank", MAPE=8, R2=8)


def show_log(log: DataFrame) -> DataFrame:
    df = log.withColumns({"t": parsing.list_first("y_true"), "p": parsing.list_first("y_pred")})
    return show(df, "market", "model", "config_index", "window_id", "start_date", "end_date",
                t=4, p=3)


@query
def walk_forward_naive(spark, sf):
    return show_log(forecast.walk_forward_naive(fx.labelled(spark, sf), fx.WINDOW, fx.RATIO))


# ---- sorts, limits, top-k ---------------------------------------------------------------

@query
def ranking_order(spark, sf):
    return show_scores(ranking.ranking_order(fx.scores(spark, sf)))


@query
def ranked_configs(spark, sf):
    overall = reports.cfg_overall(per_market(spark, sf))
    return show(reports.ranked_configs(reports.attach_hp(overall)), "model", "markets_covered",
                "hyperparams_json", "hp_hidden_units", mean_MAPE=8, mean_R2=8)


@query
def limit_configs(spark, sf):
    """The configs of the first grid places, counted over all order lines."""
    df = forecast.limit_configs(fx.scores(spark, sf), 20)
    return show_scores(df)


@query
def limit_windows(spark, sf):
    log = forecast.native_log(fx.labelled(spark, sf), fx.LEARNERS, fx.WINDOW, fx.RATIO,
                              max_windows=25)
    return show_log(log)


@query
def best_extreme(spark, sf):
    return show(ranking.best_extremes(per_market(spark, sf)), "market", "model", best_MAPE=8,
                R2_at_best_MAPE=8, best_R2=8)


@query
def preview(spark, sf):
    return show_scores(ranking.ranking_order(fx.scores(spark, sf)).limit(30))


# ---- set operations ---------------------------------------------------------------------

@query
def union_parts(spark, sf):
    a = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment") \
        .toDF("key", "balance", "segment")
    b = fx.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey") \
        .toDF("key", "balance", "nation")
    return show(clean.union_parts(a, b), "key", "segment", "nation", balance=2)


@query
def union_distinct_models(spark, sf):
    best_ = ranking.best_by_market_model(clean.drop_baseline(fx.stored_scores(spark, sf)))
    return evaluate.union_distinct_models(best_)


@query
def distinct_done(spark, sf):
    return show(logs.distinct_done(fx.raw_line_log(spark, sf)), "market", "model", "config_index")


@query
def index_intersection(spark, sf):
    return show(calendar.index_intersection(fx.raw_prices(spark, sf), fx.OUTPUT_START, fx.END), "d")


# ---- scalar functions -------------------------------------------------------------------

@query
def parse_list(spark, sf):
    """Lists as text in good and bad shape, from events."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("["), F.col("value").cast("string"))) \
        .when(F.col("event_type") == "signup", F.lit(None)) \
        .otherwise(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "),
                            (F.col("value") * 2).cast("string"), F.lit("]")))
    df = fx.table(spark, sf, "events").select("event_id", parsing.parse_list(text).alias("xs"))
    df = df.select("event_id", F.size("xs").alias("n"),
                   F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return show(df, "event_id", "n", total=4)


@query
def parse_dict(spark, sf):
    df = fx.hp_text(spark, sf).withColumn("hp", parsing.parse_dict("text"))
    return show(df.withColumns({"n": F.size("hp"), "k": F.try_element_at("hp", F.lit("k"))}),
                "id", "n", "k")


@query
def hp_json(spark, sf):
    """Maps built in no particular order of keys become one text."""
    c = fx.table(spark, sf, "customer")
    hp = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"),
                      F.col("c_nationkey").cast("string"), F.lit("a"), F.lit("x"))
    return c.select("c_custkey", parsing.hp_json(hp).alias("hp_json"))


@query
def hp_standardise(spark, sf):
    """Parts as models with differently named parameters."""
    p = fx.table(spark, sf, "part")
    tcn = F.col("p_size") > 25
    model = F.when(tcn, "TCN").otherwise("GRU")
    size = F.col("p_size").cast("string")
    hp = F.when(tcn, F.create_map(F.lit("channels"), size, F.lit("depth"), "p_brand",
                                  F.lit("act"), "p_type")) \
        .otherwise(F.create_map(F.lit("units"), size, F.lit("channels"), "p_brand",
                                F.lit("lr"), "p_type"))
    return p.select("p_partkey", model.alias("model"), *[
        c.alias(n) for n, c in parsing.hp_standardise(hp, model).items()])


@query
def list_first(spark, sf):
    """First element of the prices of an order of each customer; customers without one have none."""
    o = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array(F.max_by("o_totalprice", "o_orderkey")).alias("xs"))
    c = fx.table(spark, sf, "customer").select("c_custkey")
    df = c.join(o, c.c_custkey == o.o_custkey, "left").withColumn(
        "xs", F.coalesce("xs", F.array().cast("array<double>")))
    return show(df.withColumn("first", parsing.list_first("xs")), "c_custkey", first=2)


@query
def relative_error(spark, sf):
    df = fx.raw_line_log(spark, sf).withColumn("e", values.relative_error(
        parsing.list_first("y_true"), parsing.list_first("y_pred")))
    return show(df, "market", "model", "config_index", "window_id", "seq", e=8)


@query
def format_date(spark, sf):
    return fx.messy(spark, sf).select("seq", values.format_date(
        values.date_coerce("raw_date")).alias("shown"))


@query
def percent_filled(spark, sf):
    """Share of order lines with a discount, per order; 0 of 0 is unknown."""
    lines = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_discount") > 0).alias("filled"),
        F.count_if(F.col("l_quantity") > 10).alias("total"))
    return show(lines.withColumn("pct", values.percent_filled("filled", "total")),
                "l_orderkey", pct=6)


# ---- forecast jobs ----------------------------------------------------------------------

@query
def config_grid(spark, sf):
    """Every config of every grid and the number of order lines that ran it."""
    used = fx.raw_line_log(spark, sf).groupBy(
        "model", F.when(F.col("model") == BASELINE, -1).otherwise(F.col("config_index"))
        .alias("config_index")).agg(F.count(F.lit(1)).alias("n"))
    df = forecast.full_grid(spark).join(used, ["model", "config_index"], "left")
    return show(df.withColumn("n", F.coalesce("n", F.lit(0))), "model", "config_index",
                "hp_json", "n")


@query
def walk_forward_fit(spark, sf):
    """Learners run through the caller's fit function; the same forecasts as the native ones."""
    log = forecast.walk_forward_fit(fx.labelled(spark, sf), PANEL_FEATURES, fx.LEARNERS[1:],
                                    line_and_mean(), fx.WINDOW, fx.RATIO)
    return show_log(log)


@query
def walk_forward_grid(spark, sf):
    """Every size and depth of every net at one rate, activation and length, fitted on all features in all windows."""
    hp = F.from_json("hp_json", "activation string, learning_rate string, epochs int")
    configs = forecast.grid_configs(forecast.full_grid(spark).filter(F.col("model") != BASELINE).withColumn("p", hp)
                                    .filter("p.activation = 'tanh' AND p.learning_rate = '0.001' AND p.epochs = 32"))
    log = forecast.walk_forward_fit(fx.labelled(spark, sf), PANEL_FEATURES, configs, mean_of_layers(),
                                    fx.WINDOW, fx.RATIO, cost=net_cost)
    return show_log(log)


def net_cost(config: forecast.Config) -> float:
    """What a fit of a net costs: epochs times weights of its layers."""
    hp = dict(config.hp)
    return hp["epochs"] * hp.get("num_layers", hp.get("blocks", 1)) * hp.get("hidden_units", hp.get("channels", 1)) ** 2


@query
def tune_grid(spark, sf):
    """The whole default grid over all windows of every market: fitted, scored, the best config per market and net."""
    configs = forecast.grid_configs(forecast.full_grid(spark).filter(F.col("model") != BASELINE))
    learner = lambda labelled, grid, size, ratio, todo=None: forecast.walk_forward_fit(
        labelled, ["Price"], grid, shifted_mean(), size, ratio, todo=todo, cost=net_cost)
    labelled = stored(fx.labelled(spark, sf).select("market", "d", "Price", "y"), "labelled")
    best = tuning.tune(labelled, configs, fx.WINDOW, fx.RATIO, learner=learner)
    return show(best, "market", "model", "config_index", "n_windows", "n_samples", "hyperparams_json", MAPE=8, R2=6, MAE=1)


@query
def resume_by_window(spark, sf):
    """What is left of a log whose runs stopped somewhere, with some windows failed: intervals of windows."""
    lab = stored(fx.labelled(spark, sf), "labelled")
    log = forecast.native_log(lab, fx.LEARNERS, fx.WINDOW, fx.RATIO).filter(
        "window_id < 500 + 100 * config_index OR market = '2-HIGH' AND config_index = 1").withColumn(
        "error", F.when(F.col("window_id") % 250 == 7, "late"))
    left = logs.missing_windows(forecast.all_runs(lab, fx.LEARNERS), log, forecast.window_counts(lab, fx.WINDOW))
    return show(left, "market", "model", "config_index", "first", "last")


@query
def tune_by_window(spark, sf):
    """The best configs after only the windows that a broken run left were run."""
    lab = stored(fx.labelled(spark, sf), "labelled")
    done = forecast.native_log(lab, fx.LEARNERS, fx.WINDOW, fx.RATIO).filter("window_id < 500 + 100 * config_index").withColumn(
        "error", F.when(F.col("window_id") % 250 == 7, "late"))
    rest = tuning.grid_log(lab, fx.LEARNERS, fx.WINDOW, fx.RATIO, done, by_window=True)
    whole = done.filter("error IS NULL").unionByName(rest)
    return show_scores(ranking.best_by_market_model(metrics.config_scores(whole)))


@query
def committed_runs(spark, sf):
    """A log table after a run, the same run once more under its number, and one that ended half-way."""
    path = fresh_path(spark, "log")
    lab = stored(fx.labelled(spark, sf), "labelled")
    whole = forecast.native_log(lab, fx.LEARNERS[:2], fx.WINDOW, fx.RATIO)
    logs.append_log(whole, path, 7)
    logs.append_log(whole, path, 7)
    half = doubled(whole.filter("window_id % 2 = 0"))
    half.write.partitionBy("model", "market").parquet(f"{path}/attempt=8-broken")
    logs.append_log(forecast.native_log(lab, fx.LEARNERS[2:], fx.WINDOW, fx.RATIO), path, 9)
    return show_log(logs.read_log_table(spark, path))


def line_log_with_failures(spark, sf):
    """Order lines as a log in which every 97th window of the config failed."""
    failed = F.pmod("window_id", F.lit(97)) == 5
    return fx.line_log(spark, sf).withColumns({
        "error": F.when(failed, "late"), "y_pred": F.when(~failed, F.col("y_pred"))})


@query
def failed_runs(spark, sf):
    """Configs with a failed window, which have no score, and why."""
    return show(metrics.unscored_runs(line_log_with_failures(spark, sf)), "market", "model", "config_index",
                "n_windows", "n_failed", "reason")


def as_log_files(log: DataFrame, path: str, order: str = "window_id") -> None:
    """Written as log files, each config in one file and its rows in the given order.

    The line log lies in partitions of whole configs, of bounded size, each of which becomes a file.
    """
    rows = log.withColumn("start_date", F.col("end_date"))
    logs.write_log_files(rows.sortWithinPartitions(order), path, compression="gzip")


@query
def csv_failed_runs(spark, sf):
    """The same runs after the log went through files, which have no cell for an error."""
    path = fresh_path(spark, "failed")
    as_log_files(line_log_with_failures(spark, sf), path)
    return show(metrics.unscored_runs(metrics.dedupe_log(logs.read_logs(spark, path))), "market", "model", "config_index",
                "n_windows", "n_failed", "reason")


def doubled(log: DataFrame) -> DataFrame:
    return log.withColumn("y_pred", F.transform("y_pred", lambda p: p * 2))


@query
def csv_relogged(spark, sf):
    """Scores of files in which a run stands twice: the rows further down count."""
    path = fresh_path(spark, "relogged")
    log = fx.line_log(spark, sf).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    wrong = F.transform("y_pred", lambda p: p * 2)
    as_log_files(log.withColumn("y_pred", F.when(F.col("again") == 0, wrong).otherwise(F.col("y_pred"))), path, "again")
    return show_scores(metrics.config_scores(metrics.dedupe_log(logs.read_logs(spark, path))))


@query
def stream_relogged(spark, sf):
    """Scores kept while files arrive: two thirds of the windows with wrong forecasts and failures, then a part of
    the configs again as they should be, then the windows that were missing and the rest of the configs."""
    log, path, work = fx.line_log(spark, sf), fresh_path(spark, "arriving"), fresh_path(spark, "stream")
    wrong = doubled(line_log_with_failures(spark, sf)).filter("window_id % 3 > 0")
    for part in (wrong, log.filter("config_index % 2 = 0"), log.filter("config_index % 2 = 1 OR window_id % 3 = 0")):
        as_log_files(part, path)
        streaming.ingest_logs(streaming.log_stream(spark, path), f"{work}/windows", f"{work}/checkpoint")
    return show_scores(streaming.current_scores(spark, f"{work}/windows"))


@query
def scores_without_failures(spark, sf):
    return show_scores(metrics.config_scores(line_log_with_failures(spark, sf)))


@query
def resume_incomplete(spark, sf):
    """Runs to do again: those with a failed window or with fewer windows than the market expects."""
    log = line_log_with_failures(spark, sf)
    expected = log.groupBy("market").agg((F.count(F.lit(1)) / F.count_distinct("model", "config_index")).alias("n_expected"))
    todo = log.select("market", "model", "config_index").distinct()
    return show(logs.resume_anti(todo, log, expected=expected), "market", "model", "config_index")


@query
def held_out_log(spark, sf):
    """Log of the chosen configs on the later slice."""
    lab = stored(fx.labelled(spark, sf), "labelled")
    tuned = tuning.tune(clean.date_slice(lab, end="1999-12-31"), fx.LEARNERS, fx.WINDOW, fx.RATIO)
    return show_log(evaluate.held_out_log(clean.date_slice(lab, fx.HELD_OUT), tuned, fx.LEARNERS, fx.WINDOW, fx.RATIO))


def gappy_scores(spark, sf):
    """Scores of order lines some of whose forecasts are not a number, infinite or missing."""
    k = F.pmod("window_id", F.lit(7))
    odd = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, F.lit(None).cast("double"))
    return metrics.config_scores(fx.line_log(spark, sf).withColumn(
        "y_pred", F.when(k.between(1, 3), F.array(odd)).otherwise(F.col("y_pred"))))


@query
def scores_with_gaps(spark, sf):
    return show_scores(gappy_scores(spark, sf))


@query
def extremes_with_gaps(spark, sf):
    return show(ranking.best_extremes(reports.cfg_market(gappy_scores(spark, sf))), "market", "model", best_MAPE=8,
                R2_at_best_MAPE=8, best_R2=8)


@query
def rolling_ols_forecast(spark, sf):
    return show_log(forecast.native_log(fx.labelled(spark, sf), [fx.LEARNERS[4]], fx.WINDOW,
                                        fx.RATIO))


@query
def rolling_mean_forecast(spark, sf):
    return show_log(forecast.native_log(fx.labelled(spark, sf), fx.LEARNERS[1:4], fx.WINDOW,
                                        fx.RATIO))


@query
def rescore(spark, sf):
    """Best configs from a log that holds some windows twice."""
    log = fx.raw_line_log(spark, sf).withColumn("hp_json", F.lit("{}"))
    again = log.withColumns({"seq": F.col("seq") - 1_000_000,
                             "y_pred": F.transform("y_pred", lambda p: p * 2)})
    df = tuning.rescore(log.unionByName(again), "seq")
    return show(df, "market", "model", "n_windows", "n_samples", MAPE=8)


@query
def tune(spark, sf):
    return show_scores(tuning.tune(fx.labelled(spark, sf), fx.LEARNERS, fx.WINDOW, fx.RATIO))


@query
def evaluate_best(spark, sf):
    return show_scores(held_out(spark, sf), "window_size", "reason")


@query
def aligned_trace(spark, sf):
    return show(fx.trace(spark, sf), "market", "model", "target_date", y_true=2, y_pred=4)


@query
def naive_score(spark, sf):
    """The flagship: raw orders to the naive walk-forward score of every market."""
    prices = filled(spark, sf).withColumnRenamed("price", "Price")
    log = forecast.walk_forward_naive(
        windows.next_price_label(prices, ["Price"]), fx.WINDOW, fx.RATIO)
    return show_scores(metrics.config_scores(log))


# ---- streaming --------------------------------------------------------------------------

@query
def stream_log_scores(spark, sf):
    path, work = fresh_path(spark, "arriving"), fresh_path(spark, "stream")
    logs.write_log_files(fx.learner_log(spark, sf), path)
    df = streaming.stream_log_scores(spark, path, work, max_files=4)
    return show(df, "market", "model", "config_index", "n_samples", MAPE=8, R2=8, MAE=4)
