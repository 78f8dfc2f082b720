import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import clean
from tests.helpers import day


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_numeric_coerce(spark):
    texts = ["1.5", " 2 ", "", None, "n/a", "inf", "-Infinity", "NaN", "1d", "2.5f", "1e3", "1e999",
             "-.5", "+7", "1,5"]
    assert values(spark, texts, "string", fn.numeric_coerce) == [
        1.5, 2.0, None, None, None, None, None, None, None, None, 1000.0, None, -0.5, 7.0, None]


def test_finite(spark):
    assert values(spark, [1.0, float("nan"), float("inf"), float("-inf"), None], "double",
                  fn.finite) == [1.0, None, None, None, None]


def test_date_coerce(spark):
    assert values(spark, ["2024-02-29", "2024-13-01", " 2024-01-05 ", "x", None], "string",
                  fn.date_coerce) == [day("2024-02-29"), None, day("2024-01-05"), None, None]


@pytest.mark.parametrize("d", ["2024-01-05", "2024-01-06", "2024-01-07"])
def test_target_date_weekend(spark, d):
    assert values(spark, [day(d)], "date", fn.target_date) == [day("2024-01-08")]


def test_target_date_midweek(spark):
    assert values(spark, [day("2024-01-03")], "date", fn.target_date) == [day("2024-01-04")]


def test_parse_list(spark):
    texts = ["[1.0, 2]", "[]", "[1.5", "", None, "{}", "[null, 3]"]
    assert values(spark, texts, "string", fn.parse_list) == [
        [1.0, 2.0], [], [], [], [], [], [None, 3.0]]


def test_parse_dict(spark):
    texts = ['{"a": 0.0001, "b": "x"}', "{'a': 3e-4, 'b': 'x'}", '"{""a"": 1, ""b"": ""y""}"',
             '{"a": 1', "", None, '{"k": "say 5, then"}']
    assert values(spark, texts, "string", fn.parse_dict) == [
        {"a": "0.0001", "b": "x"}, {"a": "3e-4", "b": "x"}, {"a": "1", "b": "y"}, {}, {}, {},
        {"k": "say 5, then"}]


def test_hp_json_is_one_spelling(spark):
    df = spark.range(1).select(
        fn.hp_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("x"))).alias("x"),
        fn.hp_json(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("1"))).alias("y"))
    assert df.first() == ('{"a":"x","b":"1"}',) * 2


def test_hp_standardise(spark):
    rows = [("TCN", {"channels": "32", "depth": "3", "lr": "0.1", "hidden_units": "9"}),
            ("GRU", {"channels": "32", "units": "64", "act": "relu", "n_epochs": "8"})]
    df = spark.createDataFrame(rows, "model string, hp map<string,string>")
    out = df.select(*[c.alias(n) for n, c in fn.hp_standardise("hp", "model").items()]).collect()
    assert tuple(out[0]) == ("32", "3", None, "0.1", None)
    assert tuple(out[1]) == ("64", None, "relu", None, "8")


def test_small_scalars(spark):
    row = spark.range(1).select(
        fn.safe_slug(F.lit("a b/é_9-%")), fn.format_date(F.lit(None).cast("date")),
        fn.percent_filled(F.lit(1), F.lit(0)), fn.percent_filled(F.lit(1), F.lit(4)),
        fn.relative_error(F.lit(0.0), F.lit(1e-12)), fn.log_floor(F.lit(-3.0)),
        fn.log_floor(F.lit(None).cast("double")), fn.recode(F.lit("q"), {"p": "P"}),
        fn.recode(F.lit("p"), {"p": "P"}), fn.list_first(F.array().cast("array<double>"))).first()
    assert tuple(row) == ("a_b_é_9-_", "NaT", None, 25.0, 1.0, 1e-9, None, "q", "P", None)


def test_headers_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], [" Adj Close ", "Volume"])
    df = clean.normalise_headers(df, {"Volume": "v"})
    assert df.columns == ["Adj Close", "v"]
    assert clean.find_column(df, "missing", "adj close") == "Adj Close"
    with pytest.raises(ValueError):
        clean.find_column(df, "missing")
    assert clean.project_order(df, ["v", "zz"], rest=True).columns == ["v", "Adj Close"]


def test_keep_listed_and_baseline(spark):
    df = spark.createDataFrame([("tcn",), ("Naive_Last",), ("mlp",), (None,)], "model string")
    assert {r.model for r in clean.drop_baseline(df).collect()} == {"tcn", "mlp"}
    out = {r.model: r.ord for r in clean.keep_listed(df, "model", ["mlp", "x", "tcn"]).collect()}
    assert out == {"mlp": 1, "tcn": 3}


def test_union_and_complete_rows(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, y double")
    b = spark.createDataFrame([(2, "z")], "k int, s string")
    u = clean.union_parts(a, b)
    assert sorted(map(tuple, u.collect()), key=str) == sorted([(1, 2.0, None), (2, None, "z")], key=str)
    assert clean.feature_columns(u, drop=["k"]) == ["s"]
    assert clean.complete_rows(u, ["s"]).count() == 0
