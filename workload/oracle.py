"""The registered queries as SQL over the given tables.

``VIEWS`` are the shared inputs, each with the views it needs; ``ORACLE`` has one SELECT per
query.  ``oracle()`` puts the needed views in front of every SELECT.
"""

from __future__ import annotations

import re

from tidemark.schema import (
    COMMODITIES, GRID_ACTIVATIONS, GRID_EPOCHS, GRID_LAYERS, GRID_RATES, GRID_UNITS, NETS,
    PANEL_FEATURES)
from workload.fixtures import (
    COMMODITIES as TICKERS, END, HELD_OUT, MARKET_TICKERS, MODELS, OUTPUT_START, RATIO, START,
    WINDOW)

SPLIT = 9  # of a window of 10 rows with ratio 0.1


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Up from .5129 instead of from one half, which short decimals lie on."""
    return f"floor(({expr}) * {10 ** digits}.0 + 0.4871) / {10 ** digits}.0 + 0.0 AS {name or expr}"


def day(expr: str = "d", name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"


def rows(values, *names: str) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in values)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def last_of(source: str, keys: str, order: str, columns: str) -> str:
    order = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
    return (f"SELECT {keys}, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY {order}) AS k_ FROM {source}) WHERE k_ = 1")


def neighbours(source: str, key: str) -> str:
    """Every day of the calendar with its last and next known value."""
    back = f"OVER (PARTITION BY {key} ORDER BY d ROWS UNBOUNDED PRECEDING)"
    ahead = (f"OVER (PARTITION BY {key} ORDER BY d "
             "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    known = "CASE WHEN price IS NOT NULL THEN d END"
    return f"""SELECT {key}, d, price,
        last_value(price IGNORE NULLS) {back} AS pv,
        last_value({known} IGNORE NULLS) {back} AS pd,
        first_value(price IGNORE NULLS) {ahead} AS nv,
        first_value({known} IGNORE NULLS) {ahead} AS nd
      FROM (SELECT g.{key}, g.d, s.price
            FROM (SELECT {key}, cal.d FROM (SELECT DISTINCT {key} FROM {source}), cal) g
            LEFT JOIN {source} s ON s.{key} = g.{key} AND s.d = g.d)"""


LINE = "pv + (nv - pv) * date_diff('day', pd, d) / date_diff('day', pd, nd)"
INTERIOR = (f"CASE WHEN price IS NOT NULL THEN price "
            f"WHEN pv IS NOT NULL AND nv IS NOT NULL THEN {LINE} END")
W = "OVER (PARTITION BY market ORDER BY d)"


def frame(a: str, b: str, key: str = "market", order: str = "d") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {a} AND {b})"


TRAIN = frame(f"{SPLIT} PRECEDING", "1 PRECEDING")


def metrics(t: str = "t", p: str = "p") -> str:
    e = f"({p} - {t})"
    return f"""avg(abs({e}) / greatest(abs({t}), 2.220446049250313e-16)) AS MAPE,
        sqrt(avg({e} * {e})) / nullif(avg({t}), 0) AS RMSE_over_mean_price,
        avg(abs({e})) AS MAE,
        CASE WHEN count(*) < 2 THEN NULL
             WHEN var_pop({t}) = 0 THEN CASE WHEN avg({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1 - avg({e} * {e}) / var_pop({t}) END AS R2,
        sqrt(avg({e} * {e})) AS RMSE, avg({t}) AS mean_price, count(*) AS n_samples"""


def report_metrics(suffix: str = "") -> str:
    return f"""avg(abs(p - t) / greatest(abs(t), 1e-12)) AS MAPE{suffix},
        sqrt(avg((p - t) * (p - t))) / greatest(avg(abs(t)), 1e-12) AS RMSE_over_mean_price{suffix},
        CASE WHEN count(*) >= 2 AND var_pop(t) > 0
             THEN 1 - avg((p - t) * (p - t)) / var_pop(t) END AS R2{suffix}"""


SCORE_OUT = (f"market, model, CAST(config_index AS BIGINT) AS config_index, n_windows, n_samples, "
             f"hyperparams_json, {r('MAPE', 8)}, {r('RMSE_over_mean_price', 8)}, {r('MAE', 4)}, "
             f"{r('R2', 8)}, {r('RMSE', 4)}, {r('mean_price', 4)}")
HOUSE = "MAPE NULLS LAST, RMSE_over_mean_price NULLS LAST, MAE NULLS LAST, R2 DESC NULLS LAST, config_index"
CI = "CAST(config_index AS BIGINT) AS config_index"


def scores_of(log: str) -> str:
    return f"""SELECT market, model, config_index, count(DISTINCT window_id) AS n_windows,
        {metrics()}, arg_min(hp_json, window_id) AS hyperparams_json
      FROM {log} GROUP BY market, model, config_index"""


def best_of(scores: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, model "
            f"ORDER BY {HOUSE}) AS k_ FROM {scores}) WHERE k_ = 1")


def log_of(lab: str) -> str:
    """Forecasts of all learners, one row per (window, config)."""
    mean = lambda k: f"avg(y) {frame(f'{k} PRECEDING', '1 PRECEDING')}"
    flat = f"(min(Price) {TRAIN} = max(Price) {TRAIN})"
    parts = [("naive_last_price", -1, "{}", "naive"),
             ("rolling_mean", 0, '{"lookback": 3}', "mean_3"),
             ("rolling_mean", 1, '{"lookback": 5}', "mean_5"),
             ("rolling_mean", 2, '{"lookback": 9}', "mean_9"),
             ("rolling_ols", 0, "{}", "line")]
    wide = f"""SELECT market, d, y AS t, row_number() {W} - 1 - {SPLIT} AS window_id,
        Price AS naive, {mean(3)} AS mean_3, {mean(5)} AS mean_5, {mean(9)} AS mean_9,
        CASE WHEN {flat} THEN avg(y) {TRAIN}
             ELSE regr_intercept(y, Price) {TRAIN} + regr_slope(y, Price) {TRAIN} * Price END AS line
      FROM {lab}"""
    return " UNION ALL ".join(
        f"SELECT market, '{m}' AS model, {c} AS config_index, window_id, '{hp}' AS hp_json, "
        f"d AS start_date, d AS end_date, t, {col} AS p FROM ({wide}) WHERE window_id >= 0"
        for m, c, hp, col in parts)


def grid_sql() -> str:
    lists = {
        "u": [str(x) for x in GRID_UNITS], "l": [str(x) for x in GRID_LAYERS],
        "a": GRID_ACTIVATIONS, "lr": GRID_RATES, "e": [str(x) for x in GRID_EPOCHS]}
    src = ", ".join("(" + rows([(i, v) for i, v in enumerate(vs)], f"{n}_i", f"{n}_v") + f") {n}"
                    for n, vs in lists.items())
    index = "CAST((((u_i * 3 + l_i) * 3 + a_i) * 5 + lr_i) * 3 + e_i AS INTEGER)"
    net = ("""'{"activation": "' || a_v || '", "batch_size": 32, "epochs": ' || e_v || """
           """', "hidden_units": ' || u_v || ', "learning_rate": ' || lr_v || """
           """', "num_layers": ' || l_v || '}'""")
    tcn = ("""'{"activation": "' || a_v || '", "batch_size": 32, "blocks": ' || l_v || """
           """', "channels": ' || u_v || ', "epochs": ' || e_v || ', "kernel_size": 5, """
           """"learning_rate": ' || lr_v || '}'""")
    parts = [f"SELECT '{m}' AS model, {index} AS config_index, {tcn if m == 'tcn' else net} "
             f"AS hp_json FROM {src}" for m in NETS]
    return "SELECT 'naive_last_price' AS model, -1 AS config_index, '{}' AS hp_json UNION ALL " \
        + " UNION ALL ".join(parts)


MODEL_OF_LINE = "CASE l_linenumber " + " ".join(
    f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"
NEXT_DAY = "CASE isodow({d}) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END"
KIND = "event_type"
VALUE_TEXT = "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"

VIEWS = {
    "cal": f"""SELECT CAST(x AS DATE) AS d
        FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) t(x)
        WHERE isodow(CAST(x AS DATE)) < 6""",
    "raw_prices": """SELECT o_orderpriority AS market, CAST(o_orderdate AS DATE) AS d,
        o_totalprice AS price, o_orderkey AS seq FROM orders""",
    "clean": last_of(f"""(SELECT * FROM raw_prices WHERE price IS NOT NULL AND price <> 0
        AND isodow(d) < 6 AND d BETWEEN DATE '{START}' AND DATE '{END}')""",
                     "market, d", "seq", "price"),
    "near": neighbours("clean", "market"),
    "filled": f"SELECT market, d, coalesce({INTERIOR}, pv, nv) AS price, "
              f"CAST(price IS NULL AS INTEGER) AS is_filled FROM near",
    "raw_quotes": """SELECT ticker, CAST(l_shipdate AS DATE) AS d,
        l_extendedprice * (1 - l_discount) AS adj_close, l_orderkey, l_linenumber, l_partkey, l_suppkey
      FROM (SELECT 'RF_' || l_returnflag AS ticker, * FROM lineitem
            UNION ALL SELECT 'LN_' || l_linenumber AS ticker, * FROM lineitem)""",
    "last_quotes": last_of("raw_quotes", "ticker, d",
                           "l_orderkey, l_linenumber, l_partkey",
                           "adj_close AS price"),
    "quotes": "SELECT * FROM last_quotes WHERE isodow(d) < 6",
    "near_quotes": neighbours("quotes", "ticker"),
    "filled_quotes": f"SELECT ticker, d, coalesce({INTERIOR}, pv, nv) AS price FROM near_quotes",
    "config": rows(MARKET_TICKERS, "market", "equity_ticker", "fx_ticker"),
    "features": "SELECT f.market, f.d, f.price, e.price AS equity_index, x.price AS fx_rate, "
                + ", ".join(f"{c.lower()}_q.price AS {c}" for c in COMMODITIES)
                + " FROM filled f JOIN config c ON c.market = f.market"
                + " LEFT JOIN filled_quotes e ON e.ticker = c.equity_ticker AND e.d = f.d"
                + " LEFT JOIN filled_quotes x ON x.ticker = c.fx_ticker AND x.d = f.d"
                + "".join(f" LEFT JOIN filled_quotes {c.lower()}_q ON {c.lower()}_q.ticker = "
                          f"'{TICKERS[c]}' AND {c.lower()}_q.d = f.d" for c in COMMODITIES),
    "deltas": f"""SELECT market, d, price, row_number() {W} - 1 AS r,
        price - lag(price) {W} AS delta FROM filled""",
    "moves": f"""SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0.0) END AS gain,
        CASE WHEN delta IS NOT NULL THEN -least(delta, 0.0) END AS loss,
        CASE WHEN delta > 0 THEN 1 WHEN delta < 0 THEN -1 ELSE 0 END AS direction FROM deltas""",
    "steps": f"SELECT *, CAST(sum(direction) {W} AS BIGINT) AS adl FROM moves",
    # A fold over the rows of each market, one row number after the other.
    "fold": """SELECT market, r, d, price AS e12, price AS e26, CAST(NULL AS DOUBLE) AS g,
        CAST(NULL AS DOUBLE) AS l, CAST(adl AS DOUBLE) AS a3, CAST(adl AS DOUBLE) AS a10
      FROM steps WHERE r = 0
      UNION ALL
      SELECT s.market, s.r, s.d,
        CAST(2 AS DOUBLE) / 13 * s.price + CAST(11 AS DOUBLE) / 13 * f.e12,
        CAST(2 AS DOUBLE) / 27 * s.price + CAST(25 AS DOUBLE) / 27 * f.e26,
        CASE WHEN f.g IS NULL THEN s.gain
             ELSE CAST(1 AS DOUBLE) / 14 * s.gain + CAST(13 AS DOUBLE) / 14 * f.g END,
        CASE WHEN f.l IS NULL THEN s.loss
             ELSE CAST(1 AS DOUBLE) / 14 * s.loss + CAST(13 AS DOUBLE) / 14 * f.l END,
        CAST(0.5 AS DOUBLE) * s.adl + CAST(0.5 AS DOUBLE) * f.a3,
        CAST(2 AS DOUBLE) / 11 * s.adl + CAST(9 AS DOUBLE) / 11 * f.a10
      FROM fold f JOIN steps s ON s.market = f.market AND s.r = f.r + 1""",
    "indicators": f"""SELECT s.market, s.d,
        avg(s.price) {frame('4 PRECEDING', 'CURRENT ROW', 's.market', 's.d')} AS SMA_5,
        (e12 - e26) / e26 * 100 AS PPO_12_26,
        100 - 100 / (1 + g / nullif(l, 0)) AS RSI_14,
        (s.price / lag(s.price, 10) OVER (PARTITION BY s.market ORDER BY s.d) - 1) * 100 AS ROC_10,
        avg(abs(s.delta)) {frame('13 PRECEDING', 'CURRENT ROW', 's.market', 's.d')} AS ATR_14,
        a3 - a10 AS CO_chaikin_3_10
      FROM steps s JOIN fold f ON f.market = s.market AND f.r = s.r""",
    "panel": f"""SELECT market, d, price AS Price, * EXCLUDE (market, d, price)
      FROM features JOIN indicators USING (market, d) WHERE d >= DATE '{OUTPUT_START}'""",
    "labelled": "SELECT * FROM (SELECT *, lead(Price) " + W + " AS y FROM panel) WHERE y IS NOT NULL AND "
                + " AND ".join(f"{c} IS NOT NULL" for c in PANEL_FEATURES),
    "log": log_of("labelled"),
    "line_raw": f"""SELECT l_returnflag || l_linestatus AS market, {MODEL_OF_LINE} AS model,
        CAST(l_suppkey AS INTEGER) AS config_index, l_orderkey AS window_id, l_partkey AS seq,
        CAST(l_shipdate AS DATE) AS end_date, l_extendedprice AS t,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS p FROM lineitem""",
    "line_once": last_of("line_raw", "market, model, config_index, window_id", "seq",
                         "end_date, t, p"),
    "grid": grid_sql(),
    "layer_means": f"""SELECT market, d AS start_date, d AS end_date, y AS t, row_number() {W} - 1 - {SPLIT} AS window_id,
        avg(y) {frame('2 PRECEDING', '1 PRECEDING')} AS m2, avg(y) {frame('3 PRECEDING', '1 PRECEDING')} AS m3,
        avg(y) {frame('4 PRECEDING', '1 PRECEDING')} AS m4 FROM labelled""",
    "shifted": f"""SELECT market, model, config_index, hp_json, window_id, t,
        CASE layers WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE m4 END + moved * CASE WHEN sd > 0 THEN sd ELSE 1 END AS p
      FROM (SELECT *, stddev_pop(t) {frame('9 PRECEDING', '1 PRECEDING', order='start_date')} AS sd FROM layer_means) w,
        (SELECT model, config_index, hp_json, CAST(coalesce(hp_json ->> '$.num_layers', hp_json ->> '$.blocks') AS INTEGER) AS layers,
           CAST(coalesce(hp_json ->> '$.hidden_units', hp_json ->> '$.channels') AS DOUBLE) / 10000
           + CAST(hp_json ->> '$.epochs' AS DOUBLE) / 100000 + CAST(hp_json ->> '$.learning_rate' AS DOUBLE) / 10
           + CASE hp_json ->> '$.activation' WHEN 'tanh' THEN 0.0001 WHEN 'swish' THEN 0.0002 ELSE 0 END AS moved
         FROM grid WHERE model <> 'naive_last_price') g WHERE window_id >= 0""",
    "line_log": """SELECT l.*, coalesce(g.hp_json, '{}') AS hp_json FROM line_once l
        LEFT JOIN grid g ON g.model = l.model AND g.config_index =
          CASE WHEN l.model = 'naive_last_price' THEN -1 ELSE l.config_index % 405 END""",
    "exact_scores": scores_of("line_log"),
    "scores": """SELECT * REPLACE (round(MAPE, 10) AS MAPE, round(R2, 10) AS R2, round(MAE, 6) AS MAE,
        round(RMSE_over_mean_price, 10) AS RMSE_over_mean_price, round(RMSE, 6) AS RMSE,
        round(mean_price, 6) AS mean_price) FROM exact_scores""",
    "best": best_of("scores"),
    "nets": "SELECT * FROM scores WHERE NOT contains(lower(model), 'naive')",
    "cfg_market": """SELECT market, model, hyperparams_json, avg(MAPE) AS MAPE, avg(R2) AS R2
        FROM nets GROUP BY market, model, hyperparams_json""",
    "cfg_overall": """SELECT model, hyperparams_json, avg(MAPE) AS mean_MAPE, avg(R2) AS mean_R2,
        count(DISTINCT market) AS markets_covered FROM cfg_market GROUP BY model, hyperparams_json""",
    "hp": """SELECT *, CASE WHEN lower(model) = 'tcn' THEN hyperparams_json ->> '$.channels'
          ELSE hyperparams_json ->> '$.hidden_units' END AS hp_hidden_units,
        CASE WHEN lower(model) = 'tcn' THEN hyperparams_json ->> '$.blocks'
          ELSE hyperparams_json ->> '$.num_layers' END AS hp_num_layers,
        hyperparams_json ->> '$.activation' AS hp_activation,
        hyperparams_json ->> '$.learning_rate' AS hp_learning_rate,
        hyperparams_json ->> '$.epochs' AS hp_epochs FROM cfg_overall""",
    "trace": last_of(f"(SELECT *, end_date + {NEXT_DAY.format(d='end_date')} AS target_date FROM line_raw)",
                     "market, model, target_date", "window_id, seq", "t, p"),
    "chunks": """SELECT *, CAST(r >= floor(n / 3.0) AS INTEGER) + CAST(r >= floor(2 * n / 3.0) AS INTEGER) AS chunk
      FROM (SELECT *, row_number() OVER (PARTITION BY market, model ORDER BY target_date) - 1 AS r,
              count(*) OVER (PARTITION BY market, model) AS n FROM trace)""",
    "kept_chunks": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY market, model, chunk) AS size
        FROM chunks) WHERE n >= 3 AND size >= 2""",
    "line_pairs": f"""SELECT l_returnflag || l_linestatus AS market, {MODEL_OF_LINE} AS model,
        l_extendedprice AS t, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS p FROM lineitem""",
    "messy": f"""SELECT 'U' || {KIND} AS market, event_id AS seq,
        CASE WHEN {KIND} = 'signup' THEN '2024-13-01' ELSE strftime(ts, '%Y-%m-%d') END AS raw_date,
        CASE WHEN {KIND} = 'error' AND value < 10 THEN 'n/a' WHEN {KIND} = 'error' AND value < 20 THEN ''
             WHEN {KIND} = 'error' AND value < 30 THEN '0' WHEN {KIND} = 'error' THEN 'inf'
             WHEN {KIND} = 'view' AND value < 5 THEN {VALUE_TEXT} || 'd'
             ELSE ' ' || {VALUE_TEXT} END AS raw_price FROM events""",
    "coerced": """SELECT market, seq, TRY_CAST(raw_date AS DATE) AS d,
        CASE WHEN isfinite(v) THEN v END AS price
      FROM (SELECT *, TRY_CAST(trim(raw_price) AS DOUBLE) AS v FROM messy)""",
    "curve_m": """SELECT model, MAPE, row_number() OVER (PARTITION BY model ORDER BY MAPE DESC) AS rank
        FROM cfg_market WHERE MAPE IS NOT NULL""",
    "curve_r": """SELECT model, R2, row_number() OVER (PARTITION BY model ORDER BY R2) AS rank
        FROM cfg_market WHERE R2 IS NOT NULL""",
    "sizes": """SELECT model, market, least(count(MAPE), count(R2)) AS n FROM cfg_market
        GROUP BY model, market HAVING least(count(MAPE), count(R2)) >= 5""",
    "mm": """SELECT model, rank, avg(MAPE) AS MAPE FROM (SELECT model, MAPE, row_number() OVER (
          PARTITION BY model, market ORDER BY MAPE DESC) AS rank
        FROM cfg_market JOIN sizes USING (model, market) WHERE MAPE IS NOT NULL) GROUP BY model, rank""",
    "mr": """SELECT model, rank, avg(R2) AS R2 FROM (SELECT model, R2, row_number() OVER (
          PARTITION BY model, market ORDER BY R2) AS rank
        FROM cfg_market JOIN sizes USING (model, market) WHERE R2 IS NOT NULL) GROUP BY model, rank""",
    "market_curve": """SELECT model, rank, greatest(least(MAPE, least(greatest(
            CASE WHEN model = 'tcn' THEN 0.08 ELSE 0.04 END, max(MAPE) OVER (PARTITION BY model)), 0.10)), 0.0) AS MAPE,
          greatest(least(R2, 1.0), 0.0) AS R2
        FROM mm JOIN mr USING (model, rank)
        JOIN (SELECT model, min(n) AS shortest FROM sizes GROUP BY model) USING (model)
        WHERE rank <= shortest""",
}

LOG_OUT = (f"market, model, {CI}, window_id, {day('start_date')}, {day('end_date')}, "
           f"{r('t', 4)}, {r('p', 3)}")
FEATURE_OUT = ", ".join(r(c, 4) for c in ["equity_index", "fx_rate", *COMMODITIES])
TRACE_WIDE = ("SELECT market, " + day("target_date") + ", " + r("max(t) FILTER (model = 'naive_last_price')", 2, "y_true") + ", "
              + ", ".join(r(f"max(p) FILTER (model = '{m}')", 4, m) for m in MODELS)
              + " FROM trace GROUP BY market, target_date")
LAB_LOG = f"(SELECT * FROM log WHERE model {{}})"
HELD = f"(SELECT * FROM labelled WHERE d >= DATE '{HELD_OUT}')"
EARLY = "(SELECT * FROM labelled WHERE d <= DATE '1999-12-31')"
MEAN_4 = ("avg(MAPE) AS mean_MAPE, avg(RMSE_over_mean_price) AS mean_RMSE_over_mean_price, "
          "avg(MAE) AS mean_MAE, avg(R2) AS mean_R2")
ACROSS = (f"SELECT model, hyperparams_json, count(DISTINCT market) AS markets_covered, {MEAN_4} "
          "FROM scores GROUP BY model, hyperparams_json")

GAPPY = f"""SELECT s.* REPLACE (n AS n_windows, hp AS hyperparams_json)
      FROM ({scores_of('(SELECT * FROM line_log WHERE window_id % 7 NOT BETWEEN 1 AND 3)')}) s
      JOIN (SELECT market, model, config_index, count(*) AS n, arg_min(hp_json, window_id) AS hp FROM line_log
            GROUP BY market, model, config_index) USING (market, model, config_index)"""

ORACLE = {
    # sources and sinks
    "read_labelled_csv": f"SELECT market, {day()}, count(*) AS n, {r('max(price)', 2, 'top')} "
                         "FROM raw_prices GROUP BY market, raw_prices.d",
    "read_labelled_folder": f"SELECT market, seq, {day()}, {r('price', 2)} FROM raw_prices",
    "passed_over_files": "SELECT 'differ' AS folder, 'no label row, and those of its folder differ' AS reason, count(*) AS n_rows "
                         "FROM raw_prices WHERE seq % 3 = 2",
    "read_two_column": f"SELECT market, seq, {day()}, {r('price', 2)} FROM coerced "
                       "WHERE coerced.d IS NOT NULL AND price IS NOT NULL",
    "read_price_sheet": f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, "
                        f"l_suppkey, {day('l_shipdate', 'd')}, "
                        f"{r('l_extendedprice * (1 - l_discount)', 3, 'price')} FROM lineitem",
    "quotes_series": f"SELECT ticker, {day()}, {r('price', 3)} FROM last_quotes",
    "read_panel": f"SELECT market, {day()}, {r('Price', 2)}, {r('equity_index', 4)}, "
                  f"{r('RSI_14', 6)}, {r('CO_chaikin_3_10', 6)} FROM panel "
                  "WHERE panel.d BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'",
    "read_logs": f"SELECT market, model, {CI}, window_id, hp_json, {day('start_date')}, "
                 f"{day('end_date')}, {r('t', 2)}, {r('p', 3)} FROM log",
    "read_scores": f"SELECT market, model, {CI}, n_windows, n_samples, hyperparams_json, "
                   f"{r('MAPE', 8)}, {r('RMSE_over_mean_price', 8)}, {r('R2', 8)}, {r('MAE', 4)} FROM scores",
    "read_best_configs": f"SELECT market, model, {CI}, hyperparams_json ->> '$.epochs' AS epochs, "
                         f"n_samples, {r('MAPE', 8)}, {r('R2', 8)} FROM best",
    "write_panel": f"SELECT market, {day()}, {r('Price', 2)}, {r('equity_index', 4)}, {r('fx_rate', 4)}, "
                   f"{r('CL_F', 4)}, {r('RSI_14', 6)}, {r('CO_chaikin_3_10', 6)} FROM panel",
    "bad_log_files": "SELECT model, count(*) AS n FROM line_once WHERE model <> 'tcn' GROUP BY model "
                     "UNION ALL SELECT 'window_id,test_data_model_predictions_list', 0",
    "append_log": f"SELECT {LOG_OUT} FROM log",
    "write_metrics": f"SELECT market, model, {CI}, CAST({WINDOW} AS BIGINT) AS window_size, n_windows, "
                     f"hyperparams_json, CAST({RATIO} AS DOUBLE) AS test_ratio, {r('MAPE', 8)}, "
                     f"{r('R2', 8)} FROM ({scores_of('log')})",
    "best_configs_json": f"SELECT market, model, {CI}, n_windows, n_samples, hyperparams_json ->> '$.epochs' AS epochs, "
                         f"hyperparams_json, {r('MAPE', 8)}, {r('R2', 8)}, {r('MAE', 4)} FROM best",
    "resume_anti": f"SELECT model, {CI}, hp_json FROM grid g WHERE NOT EXISTS (SELECT 1 FROM line_raw l "
                   "WHERE l.model = g.model AND l.config_index = g.config_index)",
    "missing_inputs": "SELECT c_custkey AS custkey, c_name FROM customer "
                      "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    # projections, filters, predicates
    "numeric_coerce": f"SELECT seq, {r('price', 2)} FROM coerced",
    "date_coerce": f"SELECT seq, {day()} FROM coerced WHERE coerced.d IS NOT NULL",
    "drop_null_zero": f"SELECT seq, {r('price', 2)} FROM coerced WHERE coerced.price <> 0",
    "positive_price": f"SELECT c_custkey, {r('c_acctbal', 2)} FROM customer WHERE customer.c_acctbal > 0",
    "business_days": f"SELECT market, seq, {day()} FROM raw_prices WHERE isodow(raw_prices.d) < 6",
    "date_slice": f"SELECT seq, {day()}, {r('price', 2)} FROM raw_prices "
                  "WHERE raw_prices.d BETWEEN DATE '1996-02-29' AND DATE '1999-12-31'",
    "dedupe_last": f"SELECT market, {day()}, {r('price', 2)} FROM ("
                   + last_of("raw_prices", "market, d", "seq", "price") + ")",
    "clean_prices": f"SELECT market, {day()}, {r('price', 2)} FROM (" + last_of(
        "(SELECT * FROM coerced WHERE price <> 0 AND d IS NOT NULL AND isodow(d) < 6)",
        "market, d", "seq", "price") + ")",
    "normalise_headers": "SELECT s_suppkey AS key, s_name AS name, CAST(s_nationkey AS BIGINT) AS s_nationkey "
                         "FROM supplier",
    "find_column": f"SELECT p_partkey, {r('p_retailprice', 2, 'price')} FROM part",
    "project_order": "SELECT s_name, s_suppkey, s_nationkey FROM supplier",
    "model_name_case": "SELECT p_partkey, lower(trim(p_type)) AS lower_name, "
                       "upper(trim(' ' || p_name)) AS upper_name FROM part",
    "drop_baseline": "SELECT market, model, count(*) AS n FROM line_raw "
                     "WHERE lower(model) NOT LIKE '%naive%' GROUP BY market, model",
    "keep_listed": "SELECT market, model, CAST(CASE model WHEN 'tcn' THEN 1 WHEN 'gru' THEN 2 ELSE 4 END "
                   "AS BIGINT) AS ord, count(*) AS n FROM line_raw "
                   "WHERE model IN ('tcn', 'gru', 'mlp') GROUP BY ALL",
    "feature_columns": f"SELECT market, {day()}, {r('Price', 2)}, {r('RSI_14', 6)} FROM panel WHERE "
                       + " AND ".join(f"panel.{c} IS NOT NULL" for c in PANEL_FEATURES),
    "feature_groups": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {kind} AS kind, count({c}) AS n FROM panel"
        for c, kind in zip(PANEL_FEATURES, ["NULL", *["'financial'"] * 2, *["'commodities'"] * 5,
                                            *["'technical'"] * 6])),
    "price_feature_pairs": " UNION ALL ".join(
        f"SELECT market, {day()}, '{c}' AS feature, {r('Price', 2)}, {r(c, 4, 'value')} FROM panel "
        f"WHERE panel.d BETWEEN DATE '1995-09-01' AND DATE '2001-01-02' AND panel.{c} IS NOT NULL"
        for c in PANEL_FEATURES[1:]),
    "recode_labels": "SELECT market, CASE WHEN model IN ('mlp', 'rnn', 'lstm', 'gru', 'tcn') "
                     "THEN upper(model) ELSE model END AS label, CASE market WHEN 'AF' THEN 'closed A' "
                     "WHEN 'NO' THEN 'open N' ELSE market END AS market_abbr, count(*) AS n "
                     "FROM line_raw GROUP BY ALL",
    "log_floor": f"SELECT c_custkey, {r('ln(greatest(c_acctbal, 1e-9))', 6, 'ln_price')} FROM customer",
    "target_date": f"SELECT seq, {day()}, {day('d + ' + NEXT_DAY.format(d='d'), 'target')} FROM raw_prices",
    "safe_slug": "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS slug FROM pages",
    # joins
    "calendar_reindex": f"SELECT market, {day()}, {r('price', 2)} FROM near",
    "market_config_join": f"SELECT market, {day()}, equity_ticker, fx_ticker, {r('price', 2)} "
                          "FROM clean JOIN config USING (market)",
    "feature_join": f"SELECT market, {day()}, {r('price', 4)}, {FEATURE_OUT} FROM features",
    "unused_tickers": "SELECT n_name AS market, 'LN_' || n_nationkey AS ticker FROM nation "
                      "WHERE 'LN_' || n_nationkey NOT IN (SELECT ticker FROM quotes)",
    "technicals_join": f"SELECT market, {day()}, {r('Price', 4)}, {FEATURE_OUT}, {r('SMA_5', 4)}, "
                       f"{r('PPO_12_26')}, {r('RSI_14')}, {r('ROC_10')}, {r('ATR_14', 4)}, "
                       f"{r('CO_chaikin_3_10')} FROM panel",
    "grid_cross": f"SELECT market, window_id, {day('start_date')}, model, {CI}, hp_json FROM log",
    "best_config_join": f"SELECT market, model, {CI}, hyperparams_json FROM ({best_of('nets')}) "
                        "UNION ALL SELECT DISTINCT market, 'naive_last_price', -1, '{}' FROM nets",
    "observed_in_range": f"SELECT market, seq, {day()} FROM raw_prices WHERE isodow(raw_prices.d) < 6 "
                         f"AND raw_prices.d BETWEEN DATE '{OUTPUT_START}' AND DATE '{END}'",
    "attach_hp": "SELECT model, hyperparams_json, markets_covered, hp_hidden_units, hp_num_layers, "
                 f"hp_activation, hp_learning_rate, hp_epochs, {r('mean_MAPE', 8)}, {r('mean_R2', 8)} FROM hp",
    "align_models": TRACE_WIDE + " HAVING count(*) = 7",
    "align_models_outer": TRACE_WIDE,
    "ordered_grid_join": f"SELECT CAST(ord AS BIGINT) AS ord, o.market, {r('tcn', 8)}, {r('mlp', 8)}, "
                         "CAST(NULL AS DOUBLE) AS absent FROM ("
                         + rows([(1, "RO"), (2, "AF"), (3, "XX"), (4, "NF")], "ord", "market")
                         + ") o LEFT JOIN (SELECT market, max(MAPE) FILTER (model = 'tcn') AS tcn, "
                           "max(MAPE) FILTER (model = 'mlp') AS mlp FROM best GROUP BY market) b "
                           "ON b.market = o.market",
    # aggregations
    "forecast_metrics": f"SELECT market, model, n_samples, {r('MAPE', 8)}, {r('RMSE_over_mean_price', 8)}, "
                        f"{r('MAE', 4)}, {r('R2', 8)}, {r('RMSE', 4)}, {r('mean_price', 4)} FROM "
                        f"(SELECT market, model, {metrics()} FROM line_pairs GROUP BY market, model)",
    "config_scores": f"SELECT {SCORE_OUT} FROM scores",
    "learner_scores": f"SELECT {SCORE_OUT} FROM ({scores_of('log')})",
    "log_windows": f"SELECT market, model, {CI}, n_windows, hyperparams_json FROM scores",
    "safe_metrics": f"SELECT market, model, n_points, {r('MAPE', 8)}, {r('RMSE_over_mean_price', 8)}, "
                    f"{r('R2', 8)} FROM (SELECT market, model, count(*) AS n_points, {report_metrics()} "
                    "FROM line_pairs GROUP BY market, model)",
    "gold_metrics": f"""SELECT market, model, n_points, {r('MAPE', 8)}, {r('RMSE_over_mean_price', 8)},
          {r('R2', 8)}, {r('MAPE_raw', 8)}, {r('RMSE_over_mean_price_raw', 8)}, {r('R2_raw', 8)}
        FROM (SELECT market, model, count(*) AS n_points, {report_metrics('_raw')} FROM trace
              GROUP BY market, model)
        LEFT JOIN (SELECT market, model, avg(MAPE) AS MAPE, avg(RMSE_over_mean_price) AS RMSE_over_mean_price,
              avg(R2) AS R2 FROM (SELECT market, model, chunk, {report_metrics()} FROM kept_chunks
              GROUP BY market, model, chunk) GROUP BY market, model) USING (market, model)""",
    "coverage_stats": f"""SELECT market, {day('min(d) FILTER (price IS NOT NULL)', 'earliest')},
          {day('max(d) FILTER (price IS NOT NULL)', 'latest')}, count(*) AS total_bd,
          count(price) AS observed_bd, count(*) - count(price) AS filled_bd,
          {r('(count(*) - count(price)) * 100.0 / count(*)', 6, 'pct_filled')}
        FROM near WHERE d >= DATE '{OUTPUT_START}' GROUP BY market""",
    "model_averages": f"SELECT model, markets_covered, {r('mean_MAPE', 8)}, {r('mean_RMSE', 4)}, "
                      f"{r('mean_R2', 8)} FROM (SELECT model, count(DISTINCT market) AS markets_covered, "
                      "avg(MAPE) AS mean_MAPE, avg(RMSE) AS mean_RMSE, avg(R2) AS mean_R2 FROM best GROUP BY model)",
    "model_summary": f"SELECT model, markets_covered, {r('mean_MAPE', 8)}, {r('median_MAPE', 8)}, "
                     f"{r('mean_R2', 8)}, {r('median_R2', 8)} FROM (SELECT model, count(DISTINCT market) "
                     "AS markets_covered, avg(MAPE) AS mean_MAPE, median(MAPE) AS median_MAPE, "
                     "avg(R2) AS mean_R2, median(R2) AS median_R2 FROM scores GROUP BY model)",
    "configs_across_markets": f"SELECT model, hyperparams_json, markets_covered, {r('mean_MAPE', 8)}, "
                              f"{r('mean_RMSE_over_mean_price', 8)}, {r('mean_MAE', 4)}, {r('mean_R2', 8)} "
                              f"FROM ({ACROSS})",
    "cfg_market": f"SELECT market, model, hyperparams_json, {r('MAPE', 8)}, {r('R2', 8)} FROM cfg_market",
    "cfg_overall": f"SELECT model, hyperparams_json, markets_covered, {r('mean_MAPE', 8)}, "
                   f"{r('mean_R2', 8)} FROM cfg_overall",
    "hp_sensitivity": f"""SELECT model, hp, value, {r('mean_MAPE', 8)},
          CASE WHEN hp = 'activation' THEN CASE value WHEN 'relu' THEN 1.0 WHEN 'tanh' THEN 2.0
            WHEN 'swish' THEN 3.0 ELSE 999.0 END ELSE CAST(value AS DOUBLE) END AS value_order
        FROM (SELECT *, count(*) OVER (PARTITION BY model, hp) AS k FROM (
          SELECT model, hp, value, avg(mean_MAPE) AS mean_MAPE FROM ("""
        + " UNION ALL ".join(f"SELECT model, '{n}' AS hp, hp_{n} AS value, mean_MAPE FROM hp" for n in
                             ["hidden_units", "num_layers", "activation", "learning_rate", "epochs"])
        + ") WHERE value IS NOT NULL GROUP BY model, hp, value)) WHERE k >= 2",
    "error_histogram": f"""WITH b AS (SELECT model, xmax, CAST(least(floor(greatest(least(mean_MAPE, xmax), 0.0)
            * 40 / xmax), 39) AS INTEGER) AS bin FROM (SELECT *, CASE WHEN model = 'tcn' THEN CAST(0.08 AS DOUBLE)
            ELSE CAST(0.04 AS DOUBLE) END AS xmax FROM cfg_overall))
        SELECT m.model, CAST(g.bin AS BIGINT) AS bin, count(b.bin) AS n, {r('g.bin * any_value(m.xmax) / 40', 6, 'left_edge')},
          {r('count(b.bin) / any_value(m.total)', 8, 'share')}
        FROM (SELECT model, xmax, count(*) AS total FROM b GROUP BY model, xmax) m
        CROSS JOIN (SELECT unnest(range(40)) AS bin) g LEFT JOIN b ON b.model = m.model AND b.bin = g.bin
        GROUP BY m.model, g.bin""",
    "clipped_errors": f"""SELECT market, model, {day('target_date')}, {r('e', 8, 'rel_error')},
          {r('greatest(least(e, 0.05), -0.05)', 8, 'clipped')}
        FROM (SELECT *, (p - t) / greatest(abs(t), 1e-12) AS e FROM trace)""",
    "clipped_error_counts": f"""SELECT market, model, count(*) FILTER (abs(e) > 0.05) AS n_clipped,
          count(*) AS n_points, {r('min(greatest(least(e, 0.05), -0.05))', 6, 'min_clipped')},
          {r('max(greatest(least(e, 0.05), -0.05))', 6, 'max_clipped')}
        FROM (SELECT *, (p - t) / greatest(abs(t), 1e-12) AS e FROM trace) GROUP BY market, model""",
    "axis_bounds": f"""SELECT model, {r('CASE WHEN hi - lo < 0.06 THEN greatest(0.0, lo - 0.03) ELSE lo END', 8, 'lo')},
          {r('CASE WHEN hi - lo < 0.06 THEN least(1.0, hi + 0.03) ELSE hi END', 8, 'hi')}
        FROM (SELECT model, greatest(0.0, quantile_cont(R2, 0.05) - 0.03) AS lo,
                least(1.0, quantile_cont(R2, 0.95) + 0.03) AS hi FROM market_curve GROUP BY model)""",
    "mean_train_loss": f"""SELECT market, model, {CI}, {r('loss', 8, 'train_loss_last_mean')} FROM (
          SELECT l_returnflag || l_linestatus AS market, {MODEL_OF_LINE} AS model, l_suppkey AS config_index,
            avg(l_tax) FILTER (l_tax > 0) AS loss FROM lineitem GROUP BY ALL)""",
    "metric_pivot": "SELECT market, " + ", ".join(
        r(f"max(R2) FILTER (model = '{m}')", 8, m) for m in MODELS)
        + " FROM best GROUP BY market",
    "robust_scale_stats": f"""SELECT market, feature, window_id, {r('median', 4)},
          {r('CASE WHEN iqr < 2.220446049250313e-15 THEN 1.0 ELSE iqr END', 4, 'iqr')}
        FROM (SELECT market, feature, rr - {SPLIT} AS window_id,
            quantile_cont(v, 0.5) OVER f AS median,
            quantile_cont(v, 0.75) OVER f - quantile_cont(v, 0.25) OVER f AS iqr
          FROM ("""
        + " UNION ALL ".join(f"SELECT market, d, row_number() {W} - 1 AS rr, '{c}' AS feature, round({c}, 8) AS v "
                             "FROM labelled" for c in PANEL_FEATURES)
        + f""") WINDOW f AS (PARTITION BY market, feature ORDER BY d
            ROWS BETWEEN {SPLIT} PRECEDING AND 1 PRECEDING)) WHERE window_id >= 0""",
    "standard_scale_stats": f"""SELECT market, window_id, {r('m', 4, 'y_mean')},
          {r('CASE WHEN lo = hi THEN 1.0 ELSE s END', 4, 'y_scale')}
        FROM (SELECT market, row_number() {W} - 1 - {SPLIT} AS window_id, avg(y) {TRAIN} AS m,
            stddev_pop(y) {TRAIN} AS s, min(y) {TRAIN} AS lo, max(y) {TRAIN} AS hi FROM labelled)
        WHERE window_id >= 0""",
    "test_metrics": f"SELECT {SCORE_OUT}, CAST({WINDOW} AS BIGINT) AS window_size, '' AS reason "
                    f"FROM ({scores_of('(' + log_of(HELD) + ')')})",
    "run_counts": "SELECT count(*) AS n_rows, count(DISTINCT market) AS n_markets, "
                  "count(DISTINCT model) AS n_models, count(DISTINCT (model, hyperparams_json)) AS n_configs FROM scores",
    # window functions
    "time_interpolate": f"SELECT market, {day()}, {r(INTERIOR, 4, 'price')} FROM near",
    "fill_forward": f"SELECT market, {day()}, {r(f'coalesce({INTERIOR}, pv)', 4, 'price')} FROM near",
    "fill_backward": f"SELECT market, {day()}, CAST(is_filled AS BIGINT) AS is_filled, {r('price', 4)} FROM filled",
    "sma_5": f"SELECT market, {day()}, {r('SMA_5', 4)} FROM indicators",
    "ema": f"SELECT market, {day()}, {r('e12', 4, 'ema_12')}, {r('e26', 4, 'ema_26')} FROM fold",
    "ppo_12_26": f"SELECT market, {day()}, {r('PPO_12_26')} FROM indicators",
    "price_delta": f"SELECT market, {day()}, {r('delta', 4)}, {r('gain', 4)}, {r('loss', 4)} FROM moves",
    "rsi_14": f"SELECT market, {day()}, {r('RSI_14')} FROM indicators",
    "roc_10": f"SELECT market, {day()}, {r('ROC_10')} FROM indicators",
    "atr_14": f"SELECT market, {day()}, {r('ATR_14', 4)} FROM indicators",
    "direction": f"SELECT market, {day()}, CAST(direction AS BIGINT) AS direction FROM moves",
    "adl_cumsum": f"SELECT market, {day()}, adl FROM steps",
    "chaikin_3_10": f"SELECT market, {day()}, {r('CO_chaikin_3_10')} FROM indicators",
    "next_price_label": f"SELECT market, {day()}, {r('Price', 4)}, {r('y', 4)} FROM labelled",
    "sliding_windows": f"""SELECT market, rn - pos AS window_id, pos, {day()}, {r('y', 4)}
        FROM (SELECT *, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY market) AS n FROM labelled) x,
          (SELECT unnest(range({WINDOW})) AS pos)
        WHERE rn - pos BETWEEN 0 AND n - {WINDOW}""",
    "train_test_split": f"""SELECT market, k AS window_id, CAST(17 AS BIGINT) AS n_train, CAST(3 AS BIGINT) AS n_test,
          {day('d16', 'last_train')}, {day('d17', 'first_test')}
        FROM (SELECT market, row_number() {W} - 1 AS k, lead(d, 16) {W} AS d16, lead(d, 17) {W} AS d17,
                lead(d, 19) {W} AS d19 FROM labelled) WHERE d19 IS NOT NULL""",
    "short_series": f"SELECT o_custkey AS market, count(*) AS n_rows FROM orders GROUP BY o_custkey "
                    f"HAVING count(*) < {WINDOW}",
    "rank_in_market": f"""SELECT market, model, {CI}, row_number() OVER (PARTITION BY market ORDER BY
          scores.MAPE NULLS LAST, RMSE NULLS LAST, R2 DESC NULLS LAST, model, scores.config_index) AS rank_in_market,
          {r('MAPE', 8)} FROM scores""",
    "best_by_market_model": f"SELECT {SCORE_OUT} FROM best",
    "best_by_model": f"""SELECT model, hyperparams_json, markets_covered, {r('mean_MAPE', 8)}, {r('mean_R2', 8)}
        FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY markets_covered DESC,
          mean_MAPE NULLS LAST, mean_RMSE_over_mean_price NULLS LAST, mean_MAE NULLS LAST, mean_R2 DESC NULLS LAST,
          hyperparams_json) AS k FROM ({ACROSS})) WHERE k = 1""",
    "top_n_per_market": f"""SELECT * FROM (SELECT market, row_number() OVER (PARTITION BY market ORDER BY
          scores.MAPE NULLS LAST, RMSE NULLS LAST, R2 DESC NULLS LAST, model, scores.config_index) AS place, model, {CI},
          {r('MAPE', 8)} FROM scores) WHERE place <= 50""",
    "trace_chunks": f"SELECT market, model, {day('target_date')}, CAST(chunk AS BIGINT) AS chunk, "
                    f"{r('t', 2, 'y_true')}, {r('p', 4, 'y_pred')} FROM kept_chunks",
    "rank_curve_pooled": f"""SELECT model, rank, {r("greatest(least(MAPE, CASE WHEN model = 'tcn' THEN 0.10 ELSE 0.05 END), 0.0)", 8, 'MAPE')},
          {r('greatest(least(R2, 1.0), 0.0)', 8, 'R2')}
        FROM curve_m JOIN curve_r USING (model, rank) JOIN (SELECT model FROM cfg_market GROUP BY model
          HAVING least(count(MAPE), count(R2)) >= 20) USING (model)""",
    "rank_curve_by_market": f"SELECT model, rank, {r('MAPE', 8)}, {r('R2', 8)} FROM market_curve",
    "walk_forward_naive": f"SELECT {LOG_OUT} FROM log WHERE model = 'naive_last_price'",
    # sorts, limits, top-k
    "ranking_order": f"SELECT {SCORE_OUT} FROM scores",
    "ranked_configs": f"SELECT model, markets_covered, hyperparams_json, hp_hidden_units, "
                      f"{r('mean_MAPE', 8)}, {r('mean_R2', 8)} FROM hp",
    "limit_configs": f"SELECT {SCORE_OUT} FROM scores WHERE scores.config_index < 20",
    "limit_windows": f"SELECT {LOG_OUT} FROM log WHERE window_id < 25",
    "best_extreme": f"""SELECT market, model, {r('min(MAPE)', 8, 'best_MAPE')},
          {r('max(R2) FILTER (k = 1)', 8, 'R2_at_best_MAPE')}, {r('max(R2)', 8, 'best_R2')}
        FROM (SELECT *, row_number() OVER (PARTITION BY market, model ORDER BY MAPE NULLS LAST, hyperparams_json) AS k
              FROM cfg_market) GROUP BY market, model""",
    "preview": f"SELECT {SCORE_OUT} FROM (SELECT * FROM scores ORDER BY market, model, {HOUSE} LIMIT 30)",
    # set operations
    "union_parts": f"SELECT c_custkey AS key, {r('c_acctbal', 2, 'balance')}, c_mktsegment AS segment, "
                   "CAST(NULL AS BIGINT) AS nation FROM customer UNION ALL "
                   f"SELECT s_suppkey, {r('s_acctbal', 2, 'balance')}, NULL, s_nationkey FROM supplier",
    "union_distinct_models": "SELECT DISTINCT market, model FROM nets UNION "
                             "SELECT DISTINCT market, 'naive_last_price' FROM nets",
    "distinct_done": f"SELECT DISTINCT market, model, {CI} FROM line_raw",
    "index_intersection": f"SELECT {day()} FROM (SELECT d FROM raw_prices INTERSECT SELECT d FROM cal "
                          f"WHERE d >= DATE '{OUTPUT_START}')",
    # scalar functions
    "parse_list": f"""SELECT event_id, CAST(CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 2 END AS BIGINT) AS n,
          {r("CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE value + value * 2 END", 4, 'total')} FROM events""",
    "parse_dict": """SELECT event_id AS id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS n,
          CASE WHEN event_type <> 'error' THEN props ->> '$.k' END AS k FROM events""",
    "hp_json": """SELECT c_custkey, '{"a":"x","nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}'
          AS hp_json FROM customer""",
    "hp_standardise": """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'TCN' ELSE 'GRU' END AS model,
          CAST(p_size AS VARCHAR) AS hp_hidden_units, CASE WHEN p_size > 25 THEN p_brand END AS hp_num_layers,
          CASE WHEN p_size > 25 THEN p_type END AS hp_activation,
          CASE WHEN p_size <= 25 THEN p_type END AS hp_learning_rate, CAST(NULL AS VARCHAR) AS hp_epochs FROM part""",
    "list_first": f"""SELECT c_custkey, {r('price', 2, 'first')} FROM customer LEFT JOIN (
          SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey""",
    "relative_error": f"SELECT market, model, {CI}, window_id, seq, "
                      f"{r('(p - t) / greatest(abs(t), 1e-12)', 8, 'e')} FROM line_raw",
    "format_date": "SELECT seq, coalesce(strftime(d, '%Y-%m-%d'), 'NaT') AS shown FROM coerced",
    "percent_filled": f"""SELECT l_orderkey, {r('filled * 100.0 / nullif(total, 0)', 6, 'pct')} FROM (
          SELECT l_orderkey, count(*) FILTER (l_discount > 0) AS filled, count(*) FILTER (l_quantity > 10) AS total
          FROM lineitem GROUP BY l_orderkey)""",
    # forecast jobs
    "config_grid": f"""SELECT g.model, CAST(g.config_index AS BIGINT) AS config_index, g.hp_json, coalesce(n, 0) AS n
        FROM grid g LEFT JOIN (SELECT model, CASE WHEN model = 'naive_last_price' THEN -1 ELSE config_index END AS c,
          count(*) AS n FROM line_raw GROUP BY ALL) u ON u.model = g.model AND u.c = g.config_index""",
    "walk_forward_fit": f"SELECT {LOG_OUT} FROM log WHERE model <> 'naive_last_price'",
    "walk_forward_grid": f"""SELECT {LOG_OUT} FROM (SELECT g.model, g.config_index, w.* EXCLUDE (m2, m3, m4),
          CASE coalesce(g.hp_json ->> '$.num_layers', g.hp_json ->> '$.blocks') WHEN '2' THEN m2 WHEN '3' THEN m3 ELSE m4 END AS p
        FROM grid g, layer_means w WHERE g.model <> 'naive_last_price' AND window_id >= 0 AND g.hp_json ->> '$.activation' = 'tanh'
          AND g.hp_json ->> '$.learning_rate' = '0.001' AND g.hp_json ->> '$.epochs' = '32')""",
    "tune_grid": f"SELECT market, model, {CI}, n_windows, n_samples, hyperparams_json, {r('MAPE', 8)}, {r('R2', 6)}, {r('MAE', 1)} "
                 f"FROM ({best_of('(' + scores_of('shifted') + ')')})",
    "resume_by_window": f"""SELECT market, model, {CI}, min(window_id) AS first, max(window_id) AS last FROM (
          SELECT *, window_id - row_number() OVER (PARTITION BY market, model, config_index ORDER BY window_id) AS island
          FROM log WHERE NOT (window_id < 500 + 100 * config_index OR market = '2-HIGH' AND config_index = 1) OR window_id % 250 = 7)
        GROUP BY market, model, config_index, island""",
    "tune_by_window": f"SELECT {SCORE_OUT} FROM ({best_of('(' + scores_of('log') + ')')})",
    "committed_runs": f"SELECT {LOG_OUT} FROM log",
    "failed_runs": f"""SELECT market, model, {CI}, n_windows, n_failed,
          n_failed || ' of ' || n_windows || ' windows failed: late' AS reason
        FROM (SELECT market, model, config_index, count(*) AS n_windows, count(*) FILTER (window_id % 97 = 5) AS n_failed
              FROM line_once GROUP BY market, model, config_index) WHERE n_failed > 0""",
    "csv_failed_runs": f"""SELECT market, model, {CI}, n_windows, n_failed,
          n_failed || ' of ' || n_windows || ' windows failed: 0 of 1 forecasts' AS reason
        FROM (SELECT market, model, config_index, count(*) AS n_windows, count(*) FILTER (window_id % 97 = 5) AS n_failed
              FROM line_once GROUP BY market, model, config_index) WHERE n_failed > 0""",
    "csv_relogged": f"SELECT {SCORE_OUT} FROM exact_scores",
    "stream_relogged": f"SELECT {SCORE_OUT} FROM exact_scores",
    "scores_without_failures": f"""SELECT {SCORE_OUT} FROM exact_scores ANTI JOIN (
          SELECT * FROM line_once WHERE window_id % 97 = 5) USING (market, model, config_index)""",
    "resume_incomplete": f"""SELECT market, model, {CI} FROM (SELECT market, model, config_index, count(*) AS n,
            count(*) FILTER (window_id % 97 = 5) AS bad FROM line_once GROUP BY market, model, config_index)
          JOIN (SELECT market, count(*) / count(DISTINCT (model, config_index)) AS wanted FROM line_once GROUP BY market)
          USING (market) WHERE bad > 0 OR n < wanted""",
    "held_out_log": f"""SELECT {LOG_OUT} FROM ({log_of(HELD)})
        SEMI JOIN ({best_of('(' + scores_of('(' + log_of(EARLY) + ')') + ')')}) b USING (market, model, config_index)""",
    "scores_with_gaps": f"SELECT {SCORE_OUT} FROM ({GAPPY})",
    "extremes_with_gaps": f"""SELECT market, model, {r('min(MAPE)', 8, 'best_MAPE')},
          {r('max(R2) FILTER (k = 1)', 8, 'R2_at_best_MAPE')}, {r('max(R2)', 8, 'best_R2')}
        FROM (SELECT *, row_number() OVER (PARTITION BY market, model ORDER BY MAPE NULLS LAST, hyperparams_json) AS k
              FROM (SELECT market, model, hyperparams_json, avg(MAPE) AS MAPE, avg(R2) AS R2 FROM ({GAPPY}) GROUP BY ALL))
        GROUP BY market, model""",
    "rolling_ols_forecast": f"SELECT {LOG_OUT} FROM log WHERE model = 'rolling_ols'",
    "rolling_mean_forecast": f"SELECT {LOG_OUT} FROM log WHERE model = 'rolling_mean'",
    "rescore": f"""SELECT market, model, n_windows, n_samples, {r('MAPE', 8)} FROM (SELECT *, row_number() OVER (
          PARTITION BY market, model ORDER BY MAPE, config_index) AS k FROM exact_scores) WHERE k = 1""",
    "tune": f"SELECT {SCORE_OUT} FROM ({best_of('(' + scores_of('log') + ')')})",
    "evaluate_best": f"""SELECT {SCORE_OUT}, CAST({WINDOW} AS BIGINT) AS window_size, '' AS reason
        FROM ({scores_of('(' + log_of(HELD) + ')')})
        SEMI JOIN ({best_of('(' + scores_of('(' + log_of(EARLY) + ')') + ')')}) b USING (market, model, config_index)""",
    "aligned_trace": f"SELECT market, model, {day('target_date')}, {r('t', 2, 'y_true')}, "
                     f"{r('p', 4, 'y_pred')} FROM trace",
    "naive_score": f"""SELECT {SCORE_OUT} FROM ({scores_of(f'''(SELECT market, 'naive_last_price' AS model,
          -1 AS config_index, row_number() {W} - 1 - {SPLIT} AS window_id, lead(price) {W} AS t, price AS p,
          '{{}}' AS hp_json FROM filled QUALIFY window_id >= 0 AND t IS NOT NULL)''')})""",
    # streaming
    "stream_log_scores": f"SELECT market, model, {CI}, n_samples, {r('MAPE', 8)}, {r('R2', 8)}, {r('MAE', 4)} "
                         f"FROM ({scores_of('log')})",
}

_WIDE = ORACLE["robust_scale_stats"].replace(f"rr - {SPLIT} AS", "n, rr - 225 AS").replace(
    f"{SPLIT} PRECEDING", "225 PRECEDING").replace("- 1 AS rr,", f"- 1 AS rr, count(*) OVER (PARTITION BY market) AS n,").replace(
    "WHERE window_id >= 0", "WHERE window_id >= 0 AND window_id <= n - 250")
#: Queries that come to the same rows by other ways.
ORACLE |= {
    "fill_in_buckets": ORACLE["fill_backward"],
    "robust_scales_sliding": ORACLE["robust_scale_stats"],
    "robust_scales_wide": _WIDE,
    "labels_in_parts": ORACLE["next_price_label"],
    "scales_in_parts": ORACLE["standard_scale_stats"],
    "naive_score_in_parts": ORACLE["naive_score"],
    "technicals_in_parts": f"SELECT market, {day()}, {r('SMA_5', 4)}, {r('PPO_12_26')}, {r('RSI_14')}, {r('ROC_10')}, "
                           f"{r('ATR_14', 4)}, {r('CO_chaikin_3_10')} FROM indicators",
}

MATERIALIZED = {"steps"}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [v for v in VIEWS if v in words]


def with_views(select: str) -> str:
    """The SELECT with every view it names, directly or through others, in front."""
    wanted, todo = set(), _needs(select)
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo += _needs(VIEWS[v])
    if not wanted:
        return select
    ctes = ", ".join(f"{v} AS {'MATERIALIZED ' if v in MATERIALIZED else ''}({VIEWS[v]})"
                     for v in VIEWS if v in wanted)
    head = "WITH RECURSIVE " + ctes
    if select.startswith("WITH "):
        return head + ", " + select[5:]
    return f"{head} {select}"


def oracle() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLE.items()}
