"""From raw text rows to one finite price per market and business day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import (
    as_column, date_coerce, is_baseline, is_business_day, numeric_coerce)


def coerce_rows(raw: DataFrame, date: str = "raw_date", price: str = "raw_price") -> DataFrame:
    """Text date and price to ``d DATE, price DOUBLE``; what cannot be read becomes NULL."""
    return raw.select(*[c for c in raw.columns if c not in (date, price)],
                      date_coerce(date).alias("d"), numeric_coerce(price).alias("price"))


def drop_null_zero(df: DataFrame, price: str = "price") -> DataFrame:
    return df.filter(F.col(price).isNotNull() & (F.col(price) != 0))


def positive_price(df: DataFrame, price: str = "Price") -> DataFrame:
    return df.filter(F.col(price) > 0)


def business_days_only(df: DataFrame, date: str = "d") -> DataFrame:
    return df.filter(is_business_day(date))


def date_slice(df: DataFrame, start: str | None = None, end: str | None = None,
               date: str = "d") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; None leaves that end open."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def dedupe_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str] | str,
                values: Sequence[str]) -> DataFrame:
    """One row per key, the one that comes last by ``seq``.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a day
    that holds a third of all raw rows costs no more than any other.  An order of several columns is
    carried once, in one struct with the values, and not once more with each value.
    """
    seq = [seq] if isinstance(seq, str) else list(seq)
    if len(seq) == 1:
        return df.groupBy(*keys).agg(*[F.max_by(v, seq[0]).alias(v) for v in values])
    rest, types = [v for v in values if v not in seq], dict(df.dtypes)
    if any("map<" in types[v] or types[v] == "variant" for v in rest):  # these have no order
        last = F.max_by(F.struct(*values), F.struct(*seq))
    else:
        last = F.max(F.struct(*seq, *rest))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col("_last")[v].alias(v) for v in values])


def clean_prices(raw: DataFrame, start: str | None = None, end: str | None = None,
                 seq: Sequence[str] | str = "seq") -> DataFrame:
    """``(market, d, price, seq)`` to the sparse clean series ``(market, d, price)``.

    The row filters run first: they are per row, so they commute with keeping the last row of
    a day, and they shrink what is shuffled.
    """
    size = F.abs("price")
    rows = raw.filter((size > 0) & (size < float("inf")))
    rows = business_days_only(date_slice(rows, start, end))
    return dedupe_last(rows, ["market", "d"], seq, ["price"])


def normalise_headers(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Column names without no-break spaces and outer blanks; then renamed by ``aliases``."""
    names = [c.replace("\u00a0", "").strip() for c in df.columns]
    return df.toDF(*[(aliases or {}).get(n, n) for n in names])


def find_column(df: DataFrame, *candidates: str) -> str:
    """The first of ``candidates`` that the table has, whatever the case."""
    present = {c.strip().lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name.strip().lower() in present:
            return present[name.strip().lower()]
    raise ValueError(f"none of the columns {list(candidates)} in {df.columns}")


def project_order(df: DataFrame, order: Sequence[str], rest: bool = False) -> DataFrame:
    """The columns of ``order`` the table has, in that order; ``rest`` keeps the others too."""
    front = [c for c in order if c in df.columns]
    back = [c for c in df.columns if c not in front] if rest else []
    return df.select(*front, *back)


def drop_baseline(df: DataFrame, model: str = "model") -> DataFrame:
    return df.filter(~is_baseline(model))


def list_position(key: Column | str, listed: Sequence[str]) -> Column:
    """1-based place of a key in a list, NULL when absent."""
    place = F.array_position(F.array(*[F.lit(x) for x in listed]), as_column(key))
    return F.when(place > 0, place)


def keep_listed(df: DataFrame, key: str, listed: Sequence[str],
                position: str = "ord") -> DataFrame:
    """Rows whose key is listed, with the key's place in the list."""
    return df.filter(F.col(key).isin(list(listed))) \
             .withColumn(position, list_position(key, listed))


def feature_columns(df: DataFrame, target: str = "y", drop: Sequence[str] = ()) -> list[str]:
    features = [c for c in df.columns if c != target and c not in drop]
    if target not in df.columns or not features:
        raise ValueError(f"need the target {target!r} and at least one feature: {df.columns}")
    return features


def complete_rows(df: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    return df.dropna(how="any", subset=[*features, target])


def union_parts(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; a column one of them lacks is NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
