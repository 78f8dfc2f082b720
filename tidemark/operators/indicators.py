"""Technical indicators of a filled price series.

All windows share one partitioning and one order, so a whole set of indicators costs one
shuffle and one sort, and none of either after ``fill_calendar`` has left the rows of a market
together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: A block of rows is so long that no weight within it grows beyond this power of ten...
SCALE = 200
#: ...and earlier blocks count until their weight falls below this, which at most so many of them reach.
NOTHING, MOST_BLOCKS = 1e-100, 8


def series_window(keys: Sequence[str] = ("market",), date: str = "d") -> WindowSpec:
    """The rows of a series in order; it remembers its keys and its date for ``ewm``."""
    w = Window.partitionBy(*keys).orderBy(date)
    w.series = tuple(keys), date
    return w


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def block_rows(q: float) -> int:
    """Rows in which the weight ``q`` per row falls by ``SCALE`` powers of ten."""
    return max(1, int(SCALE / -math.log10(q)))


def blocks_back(q: float, rows: int) -> int:
    """How many earlier blocks of ``rows`` rows have a weight worth adding."""
    q = q ** rows
    return 1 + (0 if q <= NOTHING else int(math.log(NOTHING) / math.log(q)) + 1)


def groups_of_weights(specs: dict[str, tuple[str, float]]) -> list[tuple[int, dict[str, tuple[str, float]]]]:
    """Weights that can share the length of a block, which suits the one that fades fastest, with that length."""
    out: list[tuple[int, dict[str, tuple[str, float]]]] = []
    for name, (value, q) in sorted(specs.items(), key=lambda s: s[1][1]):
        if not out or blocks_back(q, out[-1][0]) > MOST_BLOCKS:
            out.append((block_rows(q), {}))
        out[-1][1][name] = (value, q)
    return out


def block_sum(value: str, q: float, inside: str, place: str) -> str:
    """The sum of the rows of a block so far, each weighted by ``q`` to its distance, as SQL.

    ``sum_j q^(i-j) * x_j`` is ``q^i`` times a plain running sum of ``x_j / q^j``; ``place`` counts the rows of the block
    from 0 and must stay below ``block_rows(q)``.
    """
    return (f"pow({q!r}D, {place}) * sum(coalesce({value}, 0D) * pow({q!r}D, -{place})) "
            f"OVER ({inside} ROWS UNBOUNDED PRECEDING)")


def decayed(df: DataFrame, specs: dict[str, tuple[str, float]], keys: Sequence[str], order: str, number: str,
            also: Sequence[str] = ()) -> DataFrame:
    """Adds ``name -> (column, q)``: the sum over the series so far, each row weighted by ``q`` to its distance.

    ``number`` is the column that counts the rows of a series from 0 in the order of ``order``.  The rows of a
    series are cut into blocks: one window sums up each block by itself, a second one in the same order reads
    the sums at the ends of the blocks before.  ``also`` are further SQL expressions for that window, which
    stands as ``{series}`` in them.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    rest = list(df.columns)
    for rows, group in groups_of_weights({n: s for n, s in specs.items() if s[1] > 0.0}):
        block = f"PARTITION BY {by}, _block ORDER BY `{order}`"
        series = f"PARTITION BY {by} ORDER BY _block, `{order}`"
        df = df.selectExpr("*", f"`{number}` div {rows} AS _block", f"CAST(`{number}` % {rows} AS double) AS _place")
        df = df.selectExpr("*", *(f"{block_sum(f'`{x}`', q, block, '_place')} AS `_sum_{n}`" for n, (x, q) in group.items()))
        end = lambda n, k: f"lag(CASE WHEN _place = {rows - 1} THEN `_sum_{n}` END, {k + 1}) IGNORE NULLS OVER ({series})"
        carry = lambda n, q: " + ".join(f"coalesce({end(n, k)}, 0D) * {(q ** rows) ** k!r}D" for k in range(blocks_back(q, rows)))
        more = [e.format(series=series) for e in also]
        df = df.selectExpr(*(f"`{c}`" for c in rest), *more, *(
            f"`_sum_{n}` + ({carry(n, q)}) * pow({q!r}D, _place + 1) AS `{n}`" for n, (_, q) in group.items()))
        rest, also = list(df.columns), ()
    return df.selectExpr("*", *(f"coalesce(`{x}`, 0D) AS `{n}`" for n, (x, q) in specs.items() if q <= 0.0),
                         *(e.format(series=f"PARTITION BY {by} ORDER BY `{order}`") for e in also))


def first_known(value: str, number: str) -> str:
    """The first value of a series and its row, as SQL for the windows of ``decayed``."""
    return (f"first(CASE WHEN `{value}` IS NOT NULL THEN struct(`{value}` AS x, `{number}` AS r) END, true) "
            f"OVER ({{series}} ROWS UNBOUNDED PRECEDING) AS `_first_{value}`")


def averages(specs: dict[str, tuple[str, float]], number: str) -> list[str]:
    """The averages from the decayed sums ``_<name>``, as SQL: the first value has its whole weight, not ``alpha`` of it."""
    return [f"CASE WHEN `{x}` IS NOT NULL THEN `_{n}` * {a!r}D "
            f"+ `_first_{x}`.x * {1.0 - a!r}D * pow({1.0 - a!r}D, `{number}` - `_first_{x}`.r) END AS `{n}`"
            for n, (x, a) in specs.items()]


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], w: WindowSpec) -> DataFrame:
    """Add exponential averages ``name -> (column, alpha)``: e = alpha*x + (1-alpha)*e_before,
    started at the first value of each series.  Leading NULLs give NULL, a later NULL adds nothing.

    Window functions have no recurrence, so the averages are decayed sums (``w`` is a ``series_window``).
    No row's result depends on the length of the series or of the blocks but for rounding.
    """
    keys, order = w.series
    sums = {f"_{n}": (x, 1.0 - a) for n, (x, a) in specs.items()}
    firsts = [first_known(x, "_r") for x in dict.fromkeys(x for x, _ in specs.values())]
    wide = decayed(df.withColumn("_r", F.row_number().over(w) - 1), sums, keys, order, "_r", firsts)
    return wide.selectExpr(*(f"`{c}`" for c in df.columns), *averages(specs, "_r"))


def price_delta(df: DataFrame, w: WindowSpec, price: str = "price") -> DataFrame:
    """Change against the row before, its gain and its loss; NULL on the first row."""
    df = df.withColumn("delta", F.col(price) - F.lag(price).over(w))
    known = F.col("delta").isNotNull()  # greatest and least skip NULLs
    return df.withColumns({
        "gain": F.when(known, F.greatest("delta", F.lit(0.0))),
        "loss": F.when(known, -F.least("delta", F.lit(0.0)))})


def direction(delta: Column | str) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.coalesce(F.signum(d), F.lit(0.0)).cast("int")


def sma(price: str, rows: int, w: WindowSpec) -> Column:
    return F.avg(price).over(w.rowsBetween(1 - rows, 0))


def roc(price: str, rows: int, w: WindowSpec) -> Column:
    return (F.try_divide(F.col(price), F.lag(price, rows).over(w)) - 1) * 100


def atr(delta: str, rows: int, w: WindowSpec) -> Column:
    return F.avg(F.abs(delta)).over(w.rowsBetween(1 - rows, 0))


def rsi(gain: Column | str, loss: Column | str) -> Column:
    """From the two averages; NULL while there has been no loss."""
    ratio = F.try_divide(F.col(gain), F.col(loss))
    return 100 - 100 / (1 + ratio)


def technicals(df: DataFrame, keys: Sequence[str] = ("market",), date: str = "d",
               price: str = "price") -> DataFrame:
    """All six indicators on top of ``df``; the helper columns are gone again."""
    w = series_window(keys, date)
    wide = price_delta(df, w, price)
    wide = wide.withColumns({
        "SMA_5": sma(price, 5, w), "ROC_10": roc(price, 10, w), "ATR_14": atr("delta", 14, w),
        "adl": F.sum(direction("delta")).over(
            w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")})
    wide = ewm(wide, {
        "ema_12": (price, span_alpha(12)), "ema_26": (price, span_alpha(26)),
        "avg_gain": ("gain", 1.0 / 14), "avg_loss": ("loss", 1.0 / 14),
        "adl_3": ("adl", span_alpha(3)), "adl_10": ("adl", span_alpha(10))}, w)
    return wide.select(
        *df.columns, "SMA_5",
        (F.try_divide(F.col("ema_12") - F.col("ema_26"), F.col("ema_26")) * 100)
        .alias("PPO_12_26"),
        rsi("avg_gain", "avg_loss").alias("RSI_14"), "ROC_10", "ATR_14",
        (F.col("adl_3") - F.col("adl_10")).alias("CO_chaikin_3_10"))
