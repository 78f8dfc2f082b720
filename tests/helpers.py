"""Small tables and plain-Python answers to compare with."""

import datetime as dt


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows):
    """(market, day text, price) rows to a typed table."""
    return spark.createDataFrame([(m, day(d), None if p is None else float(p)) for m, d, p in rows],
                                 "market string, d date, price double")


def prices(spark, values, market="m", start="2024-01-01"):
    """Consecutive days from ``start``, weekends included (indicators only look at the order)."""
    first = day(start)
    return spark.createDataFrame(
        [(market, first + dt.timedelta(i), float(v)) for i, v in enumerate(values)],
        "market string, d date, price double")


def column(df, name, order="d"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def plan(df):
    """The final plan of an executed query, without the initial one."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]
