"""Scalar functions on columns.  All are built-in expressions and stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.schema import LOG_SCALE_FLOOR, REPORT_FLOOR


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(value: Column | str) -> Column:
    """NaN and the infinities become NULL, the only missing value used after this point."""
    v = as_column(value)
    return F.when(F.abs(v) < float("inf"), v)  # NaN is above all numbers


def numeric_coerce(text: Column | str) -> Column:
    """Text to double; anything that is not a finite number is NULL.

    The pattern comes first because the cast alone would let Java literals such as ``1d`` and
    ``NaN`` through, and is slow on text it cannot read.
    """
    t = F.trim(as_column(text).cast("string"))
    return finite(F.when(t.rlike(NUMBER), t.try_cast("double")))


def date_coerce(text: Column | str) -> Column:
    return F.trim(as_column(text).cast("string")).try_cast("date")


def is_business_day(d: Column | str) -> Column:
    return F.weekday(as_column(d)) < 5


def target_date(d: Column | str) -> Column:
    """The next weekday after ``d``: Friday, Saturday and Sunday all lead to Monday."""
    d = as_column(d)
    day = F.weekday(d)
    return F.date_add(d, F.when(day == 4, 3).when(day == 5, 2).otherwise(1))


def log_floor(price: Column | str) -> Column:
    """Value to draw on a log scale: finite and at least the floor; NULL stays NULL."""
    p = finite(price)
    return F.when(p.isNotNull(), F.greatest(p, F.lit(LOG_SCALE_FLOOR)))


def relative_error(truth: Column | str, prediction: Column | str) -> Column:
    t, p = as_column(truth), as_column(prediction)
    return F.when(t.isNotNull(), (p - t) / F.greatest(F.abs(t), F.lit(REPORT_FLOOR)))


def percent_filled(filled: Column | str, total: Column | str) -> Column:
    return F.try_divide(as_column(filled) * F.lit(100.0), as_column(total))


def format_date(d: Column | str) -> Column:
    return F.coalesce(F.date_format(as_column(d), "yyyy-MM-dd"), F.lit("NaT"))


def model_name_case(name: Column | str, upper: bool = False) -> Column:
    n = F.trim(as_column(name))
    return F.upper(n) if upper else F.lower(n)


def is_baseline(model: Column | str) -> Column:
    return F.lower(as_column(model)).contains("naive")


def safe_slug(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), r"[^\p{L}\p{N}_-]", "_")


def recode(key: Column | str, labels: dict[str, str]) -> Column:
    """Label of a key; a key without a label stands for itself."""
    key = as_column(key)
    if not labels:
        return key
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def is_tcn(model: Column | str) -> Column:
    return F.lower(as_column(model)) == "tcn"
