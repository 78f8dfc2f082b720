"""Every registered query agrees with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from workload.oracle import ORACLE, VIEWS

SAMPLE = ["read_labelled_csv", "read_best_configs", "dedupe_last", "technicals_join", "sliding_windows",
          "learner_scores", "walk_forward_fit", "evaluate_best", "gold_metrics", "rank_in_market",
          "rank_curve_by_market", "hp_sensitivity", "error_histogram", "best_extreme",
          "stream_log_scores", "read_labelled_folder", "missing_inputs", "unused_tickers", "write_panel",
          "append_log", "best_configs_json", "walk_forward_grid", "failed_runs", "scores_without_failures",
          "resume_incomplete", "held_out_log", "scores_with_gaps", "extremes_with_gaps", "feature_join"]


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.TEXT_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.TEXT_ORACLE) == set(ORACLE)
    assert len(VIEWS) > 20


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and df.filter("n_windows < 1000").count() == 0


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, sf, con, name):
    got = check.compare(name, entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert got.startswith("ok") and got != "ok 0", got


LAZY = ["resume_anti", "config_grid", "feature_join", "grid_cross", "sliding_windows", "calendar_reindex",
        "config_scores", "tune", "align_models", "error_histogram", "price_feature_pairs"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, sf, name):
    text = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_tickers_are_chosen_below_the_shuffle(spark, sf):
    """The semi join on the named tickers comes before the quotes are shuffled."""
    from tests.helpers import plan
    lines = plan(entry.queries()["feature_join"](spark, sf)).splitlines()
    depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in lines if word in x]
    semi = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    assert semi and all(any("Exchange hashpartitioning(ticker" in x for x in lines[:i]) for i in semi) and depth("LeftSemi")


def test_the_quotes_are_read_once(spark, sf):
    """Equity, FX and commodity columns come from one scan of the quotes."""
    from tests.helpers import plan
    assert plan(entry.queries()["technicals_join"](spark, sf)).count("FileScan") == 2
