"""Raw prices and quotes to the feature panel of every market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.calendar import (
    MAX_CALENDAR_DAYS, check_bounds, fill_calendar)
from tidemark.operators.clean import date_slice
from tidemark.operators.indicators import technicals
from tidemark.schema import PANEL_FEATURES

MAX_COMMODITIES = 50


def market_config_join(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Attach the tickers of a market.  Which join it becomes is Spark's choice by size."""
    return rows.join(config, "market")


def unused_tickers(config: DataFrame, quotes: DataFrame) -> DataFrame:
    """Tickers a market is configured with that have no quotes: their column would be empty and
    the null-drop would remove every row of the market."""
    wanted = config.select("market", F.explode(F.array("equity_ticker", "fx_ticker"))
                           .alias("ticker"))
    return wanted.join(quotes.select("ticker").distinct(), "ticker", "left_anti")


def commodity_columns(filled: DataFrame, commodities: dict[str, str]) -> DataFrame:
    """``d`` plus one column per commodity: at most one row per calendar day."""
    if len(commodities) > MAX_COMMODITIES:
        raise ValueError(f"{len(commodities)} commodities, {MAX_COMMODITIES} allowed")
    return filled.groupBy("d").agg(*[
        F.max(F.when(F.col("ticker") == ticker, F.col("price"))).alias(name)
        for name, ticker in commodities.items()])


def feature_join(prices: DataFrame, config: DataFrame, quotes: DataFrame,
                 commodities: dict[str, str], start: str, end: str) -> DataFrame:
    """Equity, FX and commodity columns by date.

    Only tickers that a market or a commodity names are read and filled, each once, however many
    markets share it: the semi join on the few names sinks below the shuffle of the quotes, and being
    the same for all three uses it leaves that shuffle one.  The commodity table is keyed by
    date alone, so the calendar bounds it (``MAX_CALENDAR_DAYS`` rows of a few doubles) and it
    may be broadcast.  The equity and FX tables grow with the tickers and are left to Spark.
    """
    check_bounds(start, end)
    raw = config.sparkSession.createDataFrame([(t,) for t in commodities.values()], "ticker string")
    named = config.select(F.explode(F.array("equity_ticker", "fx_ticker")).alias("ticker")).union(raw)
    filled = fill_calendar(quotes.join(named, "ticker", "left_semi"), start, end, keys=["ticker"])
    daily = commodity_columns(filled, commodities)
    equity = filled.select(F.col("ticker").alias("equity_ticker"), "d",
                           F.col("price").alias("equity_index"))
    fx = filled.select(F.col("ticker").alias("fx_ticker"), "d", F.col("price").alias("fx_rate"))
    return market_config_join(prices, config) \
        .join(equity, ["equity_ticker", "d"], "left") \
        .join(fx, ["fx_ticker", "d"], "left") \
        .join(F.broadcast(daily), "d", "left")


def build_panel(series: DataFrame, config: DataFrame, quotes: DataFrame,
                commodities: dict[str, str], start: str, end: str,
                output_start: str | None = None,
                columns: Sequence[str] = PANEL_FEATURES) -> DataFrame:
    """Clean sparse prices to ``market, d`` and the feature columns.

    Fill and indicators come first and need one shuffle by market in all; the joins add columns
    to rows that already lie together.  Indicators warm up from ``start``; the output is cut to
    ``output_start`` afterwards.
    """
    prices = technicals(fill_calendar(series, start, end)) \
        .withColumnRenamed("price", "Price")
    out = feature_join(prices, config, quotes, commodities, start, end)
    return date_slice(out, output_start).select("market", "d", *columns)


assert MAX_CALENDAR_DAYS * MAX_COMMODITIES * 8 <= 100 * 2**20  # bytes a broadcast may reach
