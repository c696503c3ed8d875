"""The registered queries of the factor engine and their SQL.

Each query runs over whole tables.  The SQL is an independent statement of the same result, with floats rounded
on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.ordered import average_ranks
from quillon.operators import panel, scoring, seeds, shaping, text
from quillon.operators.intervals import grouped_within
from quillon.operators.profiles import Job, ProfileStore
from quillon.plans.expr import family_hash
from quillon.plans.halo import factors_in_blocks
from quillon.plans.lower import factors
from quillon.sources import bars as B
from quillon.sources import tables as T
from quillon.sources.ledger import Ledger, count_batch, counted
from quillon.sources.scratch import scratch_path

_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows_of(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """The rows of a piece of SQL that both engines understand, over the given tables."""
    named = set(re.findall(r"\bFROM (part|events|conversations|orders)\b", text))
    return spark.sql(re.sub(r"\bFROM (part|events|conversations|orders)\b", r"FROM {\1}", text), **{t: _table(spark, sf, t) for t in named})


def _add(name: str, sql: str | None = None):
    def keep(f):
        _Q[name] = (f, sql)
        return f

    return keep


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    # + 0.0 turns a negative zero into zero, in the SQL too
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- bars

EVENT_MINUTES, WEEK_MINUTES = 240, 10_080


def event_bars(spark: SparkSession, sf: str, minutes: int = EVENT_MINUTES) -> DataFrame:
    return B.resample(B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0)), minutes)


def nation_trades(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "lineitem")
    home = _table(spark, sf, "supplier").join(F.broadcast(_table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = items.join(home, F.col("l_suppkey") == F.col("s_suppkey"))
    return B.trades(rows, "n_name", "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), "l_quantity", *_TIE)


_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def nation_bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.resample(nation_trades(spark, sf), WEEK_MINUTES, tie=_TIE)


def _label_sql(ts: str, minutes: int) -> str:
    step = minutes * 60_000_000
    return f"make_timestamp(((epoch_us({ts}) + {step - 1}) // {step}) * {step})"


def _bars_sql(minutes: int = EVENT_MINUTES) -> str:
    return f"""SELECT event_type AS symbol, {_label_sql("ts", minutes)} AS ts, arg_min(value, events.ts) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, events.ts) AS close, count(value)::DOUBLE AS volume FROM events GROUP BY event_type, {_label_sql("ts", minutes)}"""


_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_NATION_SQL = f"""SELECT symbol, {_label_sql("ts", WEEK_MINUTES)} AS ts, first(p ORDER BY {_ORDER.replace("ts,", "t.ts,", 1)}) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY {_ORDER.replace("ts,", "t.ts,", 1)}) AS close, sum(q) AS volume
    FROM (SELECT n_name AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, l_quantity AS q, * EXCLUDE (n_name, l_shipdate) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) t
    GROUP BY symbol, {_label_sql("t.ts", WEEK_MINUTES)}"""
_OHLCV = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume"

for _n, _m in (("bars_hourly", 60), ("bars_right_closed", EVENT_MINUTES), ("bars_seven_minutes", 7)):
    _add(_n, f"SELECT symbol, ts, {_OHLCV} FROM ({_bars_sql(_m)})")(lambda s, d, m=_m: _round(event_bars(s, d, m), 8))
_add("bars_weekly_nation", f"SELECT symbol, ts, {_OHLCV} FROM ({_NATION_SQL})")(lambda s, d: _round(nation_bars(s, d), 8))


@_add("bars_daily_bypass", "SELECT event_type AS symbol, ts, round(value, 6) AS open, round(value, 6) AS high, round(value, 6) AS low, round(value, 6) AS close, 1.0::DOUBLE AS volume FROM events")
def _bypass(spark, sf):
    return _round(B.bars(B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0)), 1440))


@_add("bars_range_filter", "SELECT event_type AS symbol, ts, round(value, 6) AS close FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-15'")
def _range(spark, sf):
    rows = B.between(_table(spark, sf, "events"), F.col("ts"), "2024-01-05", "2024-01-15")
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.round("value", 6).alias("close"))


@_add("universe", "SELECT DISTINCT n_name AS symbol FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey ORDER BY 1 LIMIT 32")
def _universe(spark, sf):
    return B.universe(nation_trades(spark, sf), 32)


# -- the factor language; in the SQL {w9} is a trailing frame of nine rows

_FRAMED = f"""WITH bars AS ({_bars_sql()}),
 b AS (SELECT *, (close - lag(close) OVER o) / (lag(close) OVER o + 1e-8) AS r, close - lag(close) OVER o AS dc, ln(abs(close) + 1e-8) AS lc FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""


def _over(text: str) -> str:
    for w in range(1, 21):
        text = text.replace(f"{{w{w}}}", f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
    return text


def _dsl(name: str, expr: str, sql: str, extra: str = "", digits: int = 4) -> None:
    source = f", c AS (SELECT *, {_over(extra)} FROM b)" if extra else ", c AS (SELECT * FROM b)"
    _add(name, f"{_FRAMED}{source} SELECT symbol, ts, round(coalesce({_over(sql)}, 0), {digits})::DOUBLE + 0.0::DOUBLE AS factor FROM c")(
        lambda s, d: _round(factors(B.finite_rows(event_bars(s, d)), {"factor": expr}).select("symbol", "ts", "factor"), digits)
    )


_LIST = "list(close) {w9} AS l, avg(close) {w9} AS mu, stddev_pop(close) {w9} AS sd"
_MOMENT = "(list_sum(list_transform(l, lambda x: (x - mu) ** {p})) / len(l))"
for _f in ("open", "high", "low", "close", "volume"):
    _dsl(f"dsl_{_f}", f"ts_mean({_f}(9))", f"avg({_f}) {{w9}}")
for _f, _sql in (("mean", "avg(close) {w9}"), ("std", "stddev_pop(close) {w9} + 1e-8"), ("max", "max(close) {w9}"), ("min", "min(close) {w9}"), ("sum", "sum(close) {w9}")):
    _dsl(f"dsl_ts_{_f}", f"ts_{_f}(close(9))", _sql)
for _f, _x in (("add", "close + open"), ("sub", "close - open"), ("mul", "close * open"), ("div", "close / (abs(open) + 1e-8)")):
    _dsl(f"dsl_{_f}_arr", f"ts_mean({_f}_arr(close(9), open(4)))", f"avg({_x}) {{w4}}", digits=8)
    _dsl(f"dsl_{_f}", f"{_f}(last(close(3)), last(open(3)))", _x)
_dsl("dsl_returns", "ts_mean(returns(9))", "avg(r) {w9}")
_dsl("dsl_vwap", "vwap(9)", "sum(close * volume) {w9} / (sum(volume) {w9} + 1e-8)")
_dsl("dsl_diff", "ts_mean(diff(close(9)))", "avg(dc) {w8}", digits=8)
_dsl("dsl_log_arr", "ts_mean(log_arr(close(9)))", "avg(lc) {w9}")
_dsl("dsl_normalize", "ts_max(normalize(close(9)))", "(max(close) {w9} - avg(close) {w9}) / (stddev_pop(close) {w9} + 1e-8)")
_dsl("dsl_ema_arr", "ema_arr(close(9), 4)", "list_sum(list_transform(l, lambda x, k: x * 0.6 ** (len(l) - k))) / (list_sum(list_transform(l, lambda x, k: 0.6 ** (len(l) - k))) + 1e-8)", _LIST)
_dsl("dsl_slice_arr", "ts_mean(slice_arr(close(9), 3))", "avg(close) {w3}")
_dsl("dsl_ts_skew", "ts_skew(close(9))", f"CASE WHEN len(l) > 1 AND {_MOMENT.format(p=2)} > 0 THEN {_MOMENT.format(p=3)} / ({_MOMENT.format(p=2)} ** 1.5) END", _LIST)
_dsl("dsl_ts_kurt", "ts_kurt(close(9))", f"CASE WHEN len(l) > 1 AND {_MOMENT.format(p=2)} > 0 THEN {_MOMENT.format(p=4)} / ({_MOMENT.format(p=2)} ** 2) - 3 END", _LIST)
_dsl("dsl_last", "last(close(9))", "close")
_dsl("dsl_first", "first(close(9))", "first_value(close) {w9}")
_dsl("dsl_corr", "corr(close(9), volume(9))", "CASE WHEN stddev_pop(close) {w9} > 1e-12 AND stddev_pop(volume) {w9} > 1e-12 THEN covar_pop(close, volume) {w9} / (stddev_pop(close) {w9} * stddev_pop(volume) {w9}) END")
_dsl("dsl_cov", "cov(close(9), open(9))", "covar_samp(close, open) {w9}", digits=8)
_dsl("dsl_zscore", "zscore(last(close(9)), close(9))", "(close - mu) / (sd + 1e-8)", _LIST)
_dsl("dsl_rank", "rank(last(close(9)), close(9))", "len(list_filter(l, lambda x: x <= close)) / (len(l) + 1)", _LIST)
_dsl("dsl_neg", "neg(last(close(3)))", "-close")
_dsl("dsl_abs_s", "abs_s(sub(last(close(3)), last(open(3))))", "abs(close - open)")
_dsl("dsl_log_s", "log_s(last(close(3)))", "ln(abs(close) + 1e-8)")
_dsl("dsl_tanh_s", "tanh_s(div(last(close(3)), 100))", "tanh(close / (100 + 1e-8))")
_dsl("dsl_sign_s", "sign_s(sub(last(close(3)), last(open(3))))", "sign(close - open)")
_dsl("dsl_infix", "(last(close(3)) - last(open(3))) / ts_mean(high(5)) + 2 * vwap(3)", "(close - open) / (abs(avg(high) {w5}) + 1e-8) + 2 * (sum(close * volume) {w3} / (sum(volume) {w3} + 1e-8))")
_dsl("dsl_infix_array", "ts_mean(close(9) - open(9))", "avg(close - open) {w9}")
_dsl("dsl_infix_broadcast", "ts_sum(close(9) - ts_mean(close(4)))", "sum(close) {w9} - count(close) {w9} * avg(close) {w4}")
_dsl("dsl_array_root", "close(9)", "close")
_dsl("dsl_unary_minus", "-ts_mean(close(4))", "-(avg(close) {w4})")
_dsl("dsl_nested_sharpe", "div(ts_mean(diff(close(12))), ts_std(diff(close(12))))", "avg(dc) {w11} / (coalesce(stddev_pop(dc) {w11}, 0) + 1e-8 + 1e-8)")
_dsl("dsl_multi_scale", "sub(ts_mean(close(5)), ts_mean(close(20)))", "avg(close) {w5} - avg(close) {w20}")
_dsl("dsl_price_volume_corr", "corr(log_arr(close(8)), volume(12))", "CASE WHEN stddev_pop(lc) {w8} > 1e-12 AND stddev_pop(volume) {w8} > 1e-12 THEN covar_pop(lc, volume) {w8} / (stddev_pop(lc) {w8} * stddev_pop(volume) {w8}) END")


@_add("dsl_batch", f"{_FRAMED} SELECT symbol, ts, " + _over("round(avg(close) {w5}, 4) AS a, round(stddev_pop(close) {w9} + 1e-8, 4) AS b, round(avg(close) {w5} - (stddev_pop(close) {w9} + 1e-8), 4) AS c") + " FROM b")
def _batch(spark, sf):
    exprs = {"a": "ts_mean(close(5))", "b": "ts_std(close(9))", "c": "sub(ts_mean(close(5)), ts_std(close(9)))"}
    return _round(factors(B.finite_rows(event_bars(spark, sf)), exprs).select("symbol", "ts", *exprs), 4)


# -- labels and rewards on event bars: factor = reversal of the last move

_REVERSAL = "neg(zscore(last(close(8)), close(8)))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = factors(B.finite_rows(event_bars(spark, sf)), {"factor": _REVERSAL}).select("symbol", "ts", "close", "factor")
    return panel.skip_warmup(rows, 8)


_SCORED = f"""WITH bars AS ({_bars_sql()}),
 f0 AS (SELECT symbol, ts, close, coalesce(-((close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8)), 0) AS factor, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n
   FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 f AS (SELECT symbol, ts, close, factor FROM f0 WHERE n >= 8)"""
_SERIES = _SCORED + """, s AS (SELECT *, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM f WHERE close > 0),
 a AS (SELECT * FROM s WHERE fwd IS NOT NULL)"""

for _h in (1, 6):
    _add(f"label_series_h{_h}", _SERIES.format(h=_h) + " SELECT symbol, ts, round(factor, 4) AS factor, round(fwd, 4) AS fwd FROM a")(
        lambda s, d, h=_h: _round(panel.aligned(panel.series_labels(scored(s, d), h)).select("symbol", "ts", "factor", "fwd"), 4)
    )


@_add("label_after_drop", f"WITH bars AS ({_bars_sql()}) SELECT symbol, ts, round(lead(close, 2) OVER (PARTITION BY symbol ORDER BY ts) / close - 1, 6) AS fwd FROM bars WHERE close > 50")
def _after_drop(spark, sf):
    rows = event_bars(spark, sf).withColumn("factor", F.when(F.col("close") > 50, F.col("close")))
    return _round(panel.series_labels(rows, 2).select("symbol", "ts", "fwd"))


_REWARDS_SQL = {
    "direction": """, g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN factor <> 0 THEN (sign(factor) = sign(fwd))::INT END) AS acc, avg((factor <> 0)::INT) AS coverage, sum((factor <> 0)::INT) AS k FROM a GROUP BY symbol)
        SELECT symbol, round(CASE WHEN n < 50 OR k = 0 THEN -100 ELSE (acc - 0.5) * 200 END, 6)::DOUBLE AS value, n >= 50 AND k > 0 AS passed FROM g""",
    "ic": """, g AS (SELECT symbol, count(*) AS n, covar_pop(factor, fwd) / nullif(stddev_pop(factor) * stddev_pop(fwd), 0) AS r FROM a GROUP BY symbol)
        SELECT symbol, round(CASE WHEN n < 50 OR r IS NULL THEN -1 ELSE r END, 6)::DOUBLE AS value, n >= 50 AND r IS NOT NULL AS passed FROM g""",
    "rank_ic": """, k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY factor) + (count(*) OVER (PARTITION BY symbol, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / 2 AS rr FROM a),
        g AS (SELECT symbol, count(*) AS n, covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0) AS r FROM k GROUP BY symbol)
        SELECT symbol, round(CASE WHEN n < 50 OR r IS NULL THEN -1 ELSE r END, 6)::DOUBLE AS value, n >= 50 AND r IS NOT NULL AS passed FROM g""",
    "signal_return": """, g AS (SELECT symbol, count(*) AS n, avg(sign(factor) * fwd) / (stddev_pop(sign(factor) * fwd) + 1e-12) * sqrt(365 * 6) AS v FROM a GROUP BY symbol)
        SELECT symbol, round(CASE WHEN n < 50 THEN -1 ELSE v END, 6)::DOUBLE AS value, n >= 50 AS passed FROM g""",
}


def labelled(spark, sf, h=1):
    return panel.aligned(panel.series_labels(scored(spark, sf), h))


for _n, _f in (("direction", panel.direction_accuracy), ("ic", panel.ic), ("rank_ic", panel.rank_ic), ("signal_return", lambda d, k: panel.signal_return(d, k, periods=365 * 6))):
    _add(f"reward_{_n}", _SERIES.format(h=1) + _REWARDS_SQL[_n])(lambda s, d, f=_f: _round(f(labelled(s, d), ("symbol",)).select("symbol", "value", "passed")))


@_add("reward_composite", _SERIES.format(h=1) + """, g AS (SELECT symbol, count(*) AS n, (avg(CASE WHEN factor <> 0 THEN (sign(factor) = sign(fwd))::INT END) - 0.5) * 200 AS d, covar_pop(factor, fwd) / (stddev_pop(factor) * stddev_pop(fwd)) AS r FROM a GROUP BY symbol)
    SELECT symbol, round(d + 0.5 * r, 6) AS value, true AS passed, '' AS reason FROM g""")
def _composite(spark, sf):
    out = panel.composite(labelled(spark, sf), {"direction_accuracy": 1.0, "ic": 0.5}, ("symbol",))
    return _round(out.select("symbol", "value", "passed", "reason"))


@_add("reward_raw", _SERIES.format(h=1) + """, g AS (SELECT symbol, (avg(CASE WHEN factor <> 0 THEN (sign(factor) = sign(fwd))::INT END) - 0.5) * 200 AS d FROM a GROUP BY symbol)
    SELECT symbol, round(d / 100 + 0.1, 6) AS raw FROM g""")
def _raw(spark, sf):
    out = panel.direction_accuracy(labelled(spark, sf), ("symbol",))
    return _round(out.select("symbol", panel.raw_reward("direction", F.col("value"), F.col("passed")).alias("raw")))


@_add("direction_profile", _SCORED + """, s AS (SELECT symbol, ts, sign(factor)::TINYINT AS pred, sign(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1)::TINYINT AS label FROM f)
    SELECT symbol, ts, pred, label, pred <> 0 AS mask, pred <> 0 AND pred = label AS correct FROM s WHERE label IS NOT NULL""")
def _profile(spark, sf):
    return panel.direction_profile(scored(spark, sf))


# -- panel of supplier nations by week

def panel_rows(spark: SparkSession, sf: str, horizon: int = 1) -> DataFrame:
    return panel.evaluate_panel(nation_bars(spark, sf), _REVERSAL, horizon, 8)


_PANEL = f"""WITH bars AS ({_NATION_SQL}),
 f0 AS (SELECT symbol, ts, close, coalesce(-((close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8)), 0) AS factor, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n,
   lead(close, {{h}}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 f AS (SELECT symbol, ts, factor, fwd, count(*) OVER (PARTITION BY ts) AS n FROM f0 WHERE n >= 8 AND fwd IS NOT NULL),
 k AS (SELECT *, greatest(1, floor(n * 0.2)) AS q, rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / 2 AS rf,
   rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2 AS rr, row_number() OVER (PARTITION BY ts ORDER BY factor, symbol) AS low FROM f WHERE n >= 8),
 x AS (SELECT ts, covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0) AS rank_ic, avg(fwd) FILTER (low > n - q) - avg(fwd) FILTER (low <= q) AS ls_return, max(n) AS n_symbols FROM k GROUP BY ts)"""


@_add("label_panel_h6", _PANEL.format(h=6) + " SELECT symbol, ts, round(factor, 4) AS factor, round(fwd, 4) AS fwd FROM f")
def _panel_labels(spark, sf):
    return _round(panel.aligned(panel_rows(spark, sf, 6)), 4)


@_add("panel_rank_ic_by_time", _PANEL.format(h=1) + " SELECT ts, round(rank_ic, 6) + 0.0::DOUBLE AS rank_ic, n_symbols FROM x")
def _by_time(spark, sf):
    return _round(panel.cross_section(panel_rows(spark, sf)).select("ts", "rank_ic", "n_symbols"))


@_add("panel_long_short", _PANEL.format(h=1) + " SELECT ts, round(ls_return, 6) + 0.0::DOUBLE AS ls_return FROM x")
def _long_short(spark, sf):
    return _round(panel.cross_section(panel_rows(spark, sf)).select("ts", "ls_return"))


@_add("panel_pct_rank", _PANEL.format(h=1) + " SELECT ts, symbol, round(rf / n, 6) AS rank_pct FROM k JOIN x USING (ts) WHERE rank_ic IS NOT NULL")
def _pct(spark, sf):
    return _round(panel.percentile_ranks(panel_rows(spark, sf)))


_SUMMARY = """ SELECT count(rank_ic) AS times, round(avg(rank_ic), 6) AS mean_rank_ic, round(stddev_pop(rank_ic), 6) AS std_rank_ic,
    round(avg(rank_ic) / (stddev_pop(rank_ic) + 1e-8) * sqrt(count(rank_ic)), 6) AS icir, round(avg(ls_return), 6) AS mean_ls,
    round(avg(ls_return) / (stddev_pop(ls_return) + 1e-8) * sqrt(count(ls_return)), 6) AS ls_sharpe, round(avg(n_symbols), 6) AS mean_symbols, round(avg(n_symbols / 25), 6) AS coverage,
    round(100 * avg(rank_ic), 6) AS predictive, round(greatest(-1, least(1, 5 * avg(rank_ic) + 0.02 * tanh(avg(rank_ic) / (stddev_pop(rank_ic) + 1e-8) * sqrt(count(rank_ic))))), 6) AS score FROM x WHERE rank_ic IS NOT NULL"""


@_add("panel_summary", _PANEL.format(h=1) + _SUMMARY)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.summarise(panel.cross_section(panel_rows(spark, sf)), 25))


_HOLES = _PANEL.format(h=1).replace(" k AS (SELECT *,", " e AS (SELECT * REPLACE (CASE WHEN dayofyear(ts) % 5 = 0 THEN 0 WHEN symbol > 'U' THEN NULL ELSE factor END AS factor) FROM f), g AS (SELECT * REPLACE (count(*) OVER (PARTITION BY ts) AS n) FROM e WHERE factor IS NOT NULL),\n k AS (SELECT *,").replace("AS low FROM f WHERE", "AS low FROM g WHERE")


def holed_rows(spark, sf):
    """Panel rows where some timestamps have a constant factor and some symbols none."""
    factor = F.when(F.dayofyear("ts") % 5 == 0, 0.0).when(F.col("symbol") > "U", None).otherwise(F.col("factor"))
    return panel_rows(spark, sf).withColumn("factor", factor)


@_add("panel_summary_constant_times", _HOLES + _SUMMARY)
def _holed_summary(spark, sf):
    return _round(panel.summarise(panel.cross_section(holed_rows(spark, sf)), 25))


@_add("panel_pct_rank_constant_times", _HOLES + " SELECT ts, symbol, round(rf / n, 6) AS rank_pct FROM k JOIN x USING (ts) WHERE rank_ic IS NOT NULL")
def _holed_ranks(spark, sf):
    return _round(panel.percentile_ranks(holed_rows(spark, sf)))


@_add("panel_score_gate", _PANEL.format(h=1) + """, y AS (SELECT round(greatest(-1, least(1, 5 * avg(rank_ic) + 0.02 * tanh(avg(rank_ic) / (stddev_pop(rank_ic) + 1e-8) * sqrt(count(rank_ic))))), 6) AS score, count(rank_ic) AS times FROM x WHERE rank_ic IS NOT NULL),
    z AS (SELECT count(DISTINCT symbol) AS symbols FROM f0 WHERE n >= 8)
    SELECT least_symbols, CASE WHEN times < 20 OR symbols < least_symbols THEN -1 ELSE score END::DOUBLE AS score FROM y, z, (VALUES (8), (99)) AS t(least_symbols)""")
def _score_gate(spark, sf):
    rows = panel_rows(spark, sf)
    cross = panel.cross_section(rows).join(F.broadcast(rows.agg(F.count_distinct("symbol").alias("symbols"))))
    one = lambda n: panel.summarise(cross, F.col("symbols"), (), 20, n).select(F.lit(n).alias("least_symbols"), "score")
    return _round(one(8).union(one(99)))


@_add("reward_composite_horizons", _SCORED + """, s AS (SELECT *, lead(close, 3) OVER o / close - 1 AS r3, lead(close, 6) OVER o / close - 1 AS r6 FROM f WHERE close > 0 WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
    k AS (SELECT *, rank() OVER (PARTITION BY symbol, r6 IS NULL ORDER BY factor) + (count(*) OVER (PARTITION BY symbol, r6 IS NULL, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY symbol, r6 IS NULL ORDER BY r6) + (count(*) OVER (PARTITION BY symbol, r6 IS NULL, r6) - 1) / 2 AS rr FROM s),
    g AS (SELECT symbol, count(r3) AS n, count(r3) FILTER (factor <> 0) AS signals, (avg(CASE WHEN factor <> 0 AND r3 IS NOT NULL THEN (sign(factor) = sign(r3))::INT END) - 0.5) * 200 AS d, count(r6) AS m,
      covar_pop(rf, rr) FILTER (r6 IS NOT NULL) / nullif(stddev_pop(rf) FILTER (r6 IS NOT NULL) * stddev_pop(rr) FILTER (r6 IS NOT NULL), 0) AS r FROM k GROUP BY symbol),
    v AS (SELECT symbol, n, m, CASE WHEN n < 100 THEN -100 ELSE d END AS d, CASE WHEN m < 1000000 THEN -1 ELSE r END AS r, CASE WHEN n < 100 THEN n ELSE signals END AS samples FROM g)
    SELECT symbol, round(d + 2 * r, 6)::DOUBLE AS value, false AS passed, (CASE WHEN n < 100 THEN 'direction_accuracy:too_few_samples;' ELSE '' END) || 'rank_ic:too_few_samples' AS reason,
      round(d, 6)::DOUBLE AS direction, samples::DOUBLE AS samples FROM v""")
def _composite_horizons(spark, sf):
    parts = {"direction_accuracy": {"horizon": 3, "min_samples": 100}, "rank_ic": {"weight": 2.0, "horizon": 6, "min_samples": 1_000_000}}
    out = panel.composite(panel.valid_scores(scored(spark, sf)), parts, ("symbol",))
    m = lambda n: F.element_at("metrics", n)
    return _round(out.select("symbol", "value", "passed", "reason", m("direction_accuracy/value").alias("direction"), m("direction_accuracy/samples").alias("samples")))


# -- seeds and tasks: a candidate for each part, a split for each ten days of events

_SEEDS = """(SELECT p_partkey AS idx, concat('s', p_partkey) AS id,
 CASE p_partkey % 6 WHEN 0 THEN concat('last(close(', p_size, '))', CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE '' END) WHEN 1 THEN concat('neg(last(close(', p_size, ')))') WHEN 2 THEN concat('ts_std(close(', p_size, '))')
   WHEN 3 THEN 'bad(' WHEN 4 THEN concat('vwap(', p_size, ')') ELSE '' END AS expr,
 CASE WHEN p_partkey % 13 = 0 THEN '' ELSE lower(p_type) END AS category, p_partkey % 6 NOT IN (3, 5) AS valid, CAST(p_partkey * 37 % 500 AS DOUBLE) / 100 AS reward, CAST(p_partkey * 7 % 11 AS DOUBLE) / 10 AS coverage,
 CAST(p_partkey * 13 % 20 AS DOUBLE) / 100 AS factor_std, CAST(p_size AS DOUBLE) AS expr_nodes, CASE WHEN p_partkey % 6 IN (3, 5) OR p_partkey % 29 = 0 THEN '' ELSE concat('h', p_partkey % 6, '_', p_partkey % 97) END AS canonical_hash,
 CAST(40 + p_partkey % 20 AS DOUBLE) / 100 AS direction_acc FROM part) AS t"""
_SPLITS = """(SELECT concat('d', CAST(floor((day(ts) - 1) / 10) AS INT)) AS name, CAST(CAST(min(ts) AS DATE) AS STRING) AS start_date, CAST(CAST(max(ts) AS DATE) AS STRING) AS end_date, CAST(count(*) % 3 + 1 AS DOUBLE) AS weight
 FROM events GROUP BY floor((day(ts) - 1) / 10)) AS t"""
_SCORE = """SELECT *, reward + coverage * 0.1 + expr_nodes * -0.05 AS seed_score, list_filter([CASE WHEN coverage < 0.6 THEN 'coverage<0.6' END, CASE WHEN factor_std < 0.01 THEN 'factor_std<0.01' END], lambda x: x IS NOT NULL) AS reasons FROM """


def _seed_rows(spark, sf):
    metrics = [x for m in ("reward", "coverage", "factor_std", "expr_nodes", "direction_acc") for x in (F.lit(m), F.col(m).cast("double"))]
    return seeds.score(_rows_of(spark, sf, f"SELECT * FROM {_SEEDS}").withColumn("metrics", F.create_map(*metrics)))


def _splits(spark, sf):
    return _rows_of(spark, sf, f"SELECT * FROM {_SPLITS}")


_SCORED_SEEDS = f"""WITH s0 AS ({_SCORE}{_SEEDS}), s AS (SELECT * EXCLUDE (valid), valid AND len(reasons) = 0 AS valid, direction_acc < 0.49 AS invert FROM s0),
 d AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN canonical_hash = '' THEN '#' || idx ELSE canonical_hash END ORDER BY seed_score DESC, idx) AS r FROM s WHERE valid)"""


@_add("seed_score", f"{_SCORED_SEEDS} SELECT id, valid, round(seed_score, 6)::DOUBLE AS seed_score, array_to_string(reasons, ';') AS reasons, CASE WHEN NOT valid THEN 'filtered' WHEN seed_score > 0 THEN 'elite_candidate' ELSE 'valid_low_score' END AS status, invert FROM s")
def _seed_score(spark, sf):
    return _round(_seed_rows(spark, sf).select("id", "valid", "seed_score", F.concat_ws(";", "reasons").alias("reasons"), "status", "invert"))


_AFTER = """CASE WHEN dup_status = 'kept' THEN CASE WHEN s.seed_score > 0 THEN 'elite_candidate' ELSE 'valid_low_score' END ELSE coalesce(dup_status, 'filtered') END AS status, coalesce(dup_status = 'kept', false) AS valid,
    array_to_string(list_concat(reasons, CASE dup_status WHEN 'duplicate_ast' THEN ['duplicate_ast'] WHEN 'duplicate_category_quota' THEN ['category_quota'] ELSE [] END), ';') AS reasons"""


def _after_dedup(rows):
    return rows.select("id", "dup_status", "status", "valid", F.concat_ws(";", "reasons").alias("reasons"))


@_add("seed_dedup", f"{_SCORED_SEEDS} SELECT s.id, dup_status, {_AFTER} FROM s LEFT JOIN (SELECT id, CASE WHEN r > 1 THEN 'duplicate_ast' ELSE 'kept' END AS dup_status FROM d) USING (id)")
def _seed_dedup(spark, sf):
    return _after_dedup(seeds.dedup(_seed_rows(spark, sf)))


@_add("seed_quota", f"""{_SCORED_SEEDS.replace("WITH s0", "WITH RECURSIVE s0")}, o AS (SELECT *, row_number() OVER (ORDER BY seed_score DESC, idx) AS n, coalesce(nullif(category, ''), 'general') AS family FROM s WHERE valid),
    walk AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS id, ''::VARCHAR AS dup_status, []::VARCHAR[] AS hashes, MAP {{}}::MAP(VARCHAR, INTEGER) AS families
      UNION ALL SELECT n, id, st, CASE WHEN st = 'kept' AND canonical_hash <> '' THEN list_append(hashes, canonical_hash) ELSE hashes END,
        CASE WHEN st = 'kept' THEN map_concat(families, MAP {{family: coalesce(families[family], 0) + 1}}) ELSE families END
      FROM (SELECT o.n, o.id, o.canonical_hash, o.family, hashes, families, CASE WHEN list_contains(hashes, o.canonical_hash) THEN 'duplicate_ast' WHEN coalesce(families[o.family], 0) >= 40 THEN 'duplicate_category_quota' ELSE 'kept' END AS st FROM walk JOIN o ON o.n = walk.n + 1))
    SELECT s.id, dup_status, {_AFTER} FROM s LEFT JOIN (SELECT id, dup_status FROM walk WHERE n > 0) USING (id)""")
def _seed_quota(spark, sf):
    return _after_dedup(seeds.dedup(_seed_rows(spark, sf), 40))


@_add("seed_library", f"""{_SCORED_SEEDS}, k AS (SELECT id, seed_score, invert, row_number() OVER (ORDER BY seed_score DESC, idx) AS o, row_number() OVER (PARTITION BY invert ORDER BY seed_score DESC, idx) AS c FROM d WHERE r = 1),
    l AS (SELECT s.id, coalesce(o <= 10 AND k.seed_score >= 0, false) AS elite, coalesce(o <= 20, false) AS diverse, coalesce(k.invert AND c <= 10, false) AS contrarian FROM s LEFT JOIN k USING (id))
    SELECT *, NOT (elite OR diverse OR contrarian) AS rejected FROM l""")
def _seed_library(spark, sf):
    return seeds.library(seeds.dedup(_seed_rows(spark, sf))).select("id", "elite", "diverse", "contrarian", "rejected")


@_add("seed_topk", f"{_SCORED_SEEDS} SELECT id, round(seed_score, 6)::DOUBLE AS seed_score FROM s ORDER BY s.seed_score DESC, idx LIMIT 30")
def _seed_topk(spark, sf):
    return _round(_seed_rows(spark, sf).orderBy(F.desc("seed_score"), "idx").limit(30).select("id", "seed_score"))


@_add("task_cross_join", f"""{_SCORED_SEEDS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(canonical_hash, ''), trim(expr)) ORDER BY seed_score DESC, idx) AS z FROM s WHERE valid) WHERE z = 1 ORDER BY seed_score DESC, idx LIMIT 64)
    SELECT u.id || '__' || t.name AS task_id, u.id AS seed_id, t.name AS split, start_date, end_date, t.weight::DOUBLE AS weight FROM u CROSS JOIN {_SPLITS}""")
def _tasks(spark, sf):
    out = seeds.task_bank(_seed_rows(spark, sf), _splits(spark, sf))
    return out.select("task_id", "seed_id", "split", "start_date", "end_date", F.col("weight").cast("double").alias("weight"))


@_add("task_interval_join", f"WITH bars AS ({_bars_sql()}) SELECT name AS split, symbol, count(*) AS n, round(avg(close), 4) AS mean_close FROM bars JOIN {_SPLITS} ON bars.ts BETWEEN start_date::TIMESTAMP AND end_date::TIMESTAMP GROUP BY ALL")
def _interval(spark, sf):
    rows = seeds.in_splits(event_bars(spark, sf), _splits(spark, sf))
    return _round(rows.groupBy("split", "symbol").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")), 4)


_SPELLS = """(SELECT o_orderkey, o_orderpriority AS priority, CAST(1704067200 + o_orderkey * 997 % 43200 * 60 AS BIGINT) AS from_second, CAST(1704067200 + (o_orderkey * 997 % 43200 + o_custkey % 120) * 60 AS BIGINT) AS to_second FROM orders) AS t"""


@_add("interval_join_orders", f"SELECT priority, event_type, count(*) AS n, round(avg(value), 4) AS mean_value, min(o_orderkey) AS first_order FROM events JOIN {_SPELLS} ON epoch_us(ts) BETWEEN from_second * 1000000 AND to_second * 1000000 GROUP BY ALL")
def _spells(spark, sf):
    spells = _rows_of(spark, sf, f"SELECT * FROM {_SPELLS}")
    at, begin, end = F.unix_micros(F.col("ts").cast("timestamp")), F.col("from_second") * 1_000_000, F.col("to_second") * 1_000_000
    # the pairs grow with the product of both tables, what is asked of them does not
    rows = grouped_within(_table(spark, sf, "events"), at, ["event_type"], spells, begin, end, ["priority"], means={"mean_value": "value"}, least={"first_order": "o_orderkey"})
    return _round(rows.select("priority", "event_type", "n", "mean_value", "first_order"), 4)


_add("seed_softmax_sample")(lambda s, d: seeds.softmax_sample(_seed_rows(s, d).where("valid"), 1000))
_add("task_stratified_sample")(lambda s, d: seeds.stratified_sample(seeds.task_bank(_seed_rows(s, d), _splits(s, d)), 5))
_add("prompt_rows")(lambda s, d: seeds.prompt_rows(seeds.task_bank(_seed_rows(s, d), _splits(s, d)), "Improve a factor.", "Start from {expr} on {start_date} to {end_date}."))
for _mode in seeds.MODES:
    _add(f"prompt_{_mode}", f"""{_SCORED_SEEDS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(canonical_hash, ''), trim(expr)) ORDER BY seed_score DESC, idx) AS z FROM s WHERE valid) WHERE z = 1 ORDER BY seed_score DESC, idx LIMIT 64)
    SELECT u.id || '__' || t.name AS task_id, 'factor_tasks/' || category || '/' || t.name AS data_source, 'Design factors.' AS system,
      '{seeds.MODES[_mode][1]}' || chr(10) || CASE WHEN category <> '' THEN 'category: ' || category || chr(10) ELSE '' END || 'split: ' || t.name || chr(10) || 'start_date: ' || start_date || chr(10) || 'end_date: ' || end_date || chr(10) || replace('{seeds.MODES[_mode][2]}', '{{expr}}', expr) AS user_text
    FROM u CROSS JOIN {_SPLITS}""")(lambda s, d, m=_mode: seeds.prompts(seeds.task_bank(_seed_rows(s, d), _splits(s, d)), m, "Design factors.").select(
        "extra_info.task_id", "data_source", F.col("prompt")[0]["content"].alias("system"), F.col("prompt")[1]["content"].alias("user_text")))


@_add("seed_validation", f"""SELECT id, expr NOT IN ('bad(', '') AS valid, CASE WHEN expr IN ('bad(', '') THEN 'invalid_syntax' ELSE 'static_valid' END AS status,
    CASE WHEN expr IN ('bad(', '') THEN 0 ELSE len(expr) - len(replace(expr, '(', '')) + 1 END::BIGINT AS operands, substr(sha1(trim(expr)), 1, 16) AS exact_hash,
    count(*) OVER (PARTITION BY CASE WHEN expr IN ('bad(', '') THEN expr ELSE regexp_replace(expr, '[0-9 ]+', '', 'g') END, CASE WHEN expr IN ('bad(', '') THEN -1 ELSE (sz > 5)::INT + (sz > 20)::INT END) AS family_size
    FROM (SELECT id, expr, expr_nodes AS sz FROM {_SEEDS})""")
def _validation(spark, sf):
    rows = seeds.validate_candidates(_rows_of(spark, sf, f"SELECT id, expr FROM {_SEEDS}"))
    sizes = rows.groupBy("family_hash").agg(F.count("*").alias("family_size"))
    operands = F.when(F.col("valid"), F.char_length("expr") - F.char_length(F.replace("expr", F.lit("("), F.lit(""))) + 1).otherwise(0).cast("long")
    return rows.join(sizes, "family_hash").select("id", "valid", "status", operands.alias("operands"), "exact_hash", "family_size")



# -- archives and shaping; profiles come from the event bars of each type

_ARCHIVE = "(SELECT concat('h', user_id % 300) AS hash, event_id % 17 AS count FROM events) AS a"
_BATCH = """(SELECT conv_id * 1000 + turn AS id, concat('h', (conv_id * 7 + turn) % 400) AS hash, concat('f', conv_id % 40) AS family, CASE WHEN conv_id % 10 = 9 THEN CAST(-1 AS DOUBLE) ELSE CAST((conv_id * 3 + turn) % 40 AS DOUBLE) / 100 END AS raw,
 CAST(conv_id % 30 AS DOUBLE) / 100 AS base FROM conversations) AS c"""
_FAMILIES = "(SELECT concat('f', user_id % 35) AS family, count(*) % 20 AS count FROM events GROUP BY concat('f', user_id % 35)) AS f"


def _counts(spark, sf):
    return shaping.counts(_rows_of(spark, sf, f"SELECT hash, cast(count AS bigint) AS count FROM {_ARCHIVE}"))


def _batch_rows(spark, sf):
    return _rows_of(spark, sf, f"SELECT id, hash, family, cast(raw AS double) AS raw, cast(base AS double) AS base FROM {_BATCH}")


def _families(spark, sf, key="family"):
    return _rows_of(spark, sf, f"SELECT family AS {key}, cast(count AS bigint) AS count FROM {_FAMILIES}")


_add("archive_counts", f"SELECT hash, max(count)::BIGINT AS count FROM {_ARCHIVE} GROUP BY hash")(lambda s, d: _counts(s, d))
_add("archive_record", f"SELECT hash, (coalesce(m, 0) + n)::BIGINT AS count FROM (SELECT hash, count(*) AS n FROM {_BATCH} GROUP BY hash) LEFT JOIN (SELECT hash, max(count) AS m FROM {_ARCHIVE} GROUP BY hash) USING (hash)")(lambda s, d: shaping.record(_batch_rows(s, d), _counts(s, d)))
_add("archive_topk", f"SELECT hash, max(raw)::DOUBLE AS raw_score FROM {_BATCH} GROUP BY hash ORDER BY 2 DESC, 1 LIMIT 128")(lambda s, d: shaping.best(_batch_rows(s, d).selectExpr("hash", "raw as raw_score", "id as seq")).select("hash", "raw_score"))
_add("archive_anti_join", f"SELECT DISTINCT hash FROM {_BATCH} WHERE hash NOT IN (SELECT hash FROM {_ARCHIVE})")(lambda s, d: shaping.fresh(_batch_rows(s, d), _counts(s, d)).select("hash"))
_add("shape_repeat", f"SELECT id, CASE WHEN m > 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS penalty FROM {_BATCH} LEFT JOIN (SELECT hash, max(count) AS m FROM {_ARCHIVE} GROUP BY hash) USING (hash)")(
    lambda s, d: shaping.with_counts(_batch_rows(s, d), _counts(s, d), "seen").select("id", shaping.repeat_penalty(F.col("seen")).cast("double").alias("penalty"))
)
_add("shape_family", f"SELECT id, CASE WHEN coalesce(count, 0) = 0 AND raw >= 0.10 THEN 0.02 WHEN coalesce(count, 0) > 8 AND raw < 0.08 THEN -0.02 ELSE 0.0 END::DOUBLE AS shift FROM {_BATCH} LEFT JOIN {_FAMILIES} USING (family)")(
    lambda s, d: shaping.with_counts(_batch_rows(s, d), _families(s, d), "seen", "family").select("id", shaping.family_shift(F.col("raw"), F.col("seen")).cast("double").alias("shift"))
)
_add("shape_relative", f"SELECT id, round(raw + 0.5 * greatest(raw - base, 0) - 0.1 * greatest(base - raw, 0), 6)::DOUBLE AS shaped FROM {_BATCH}")(
    lambda s, d: _round(_batch_rows(s, d).select("id", shaping.relative(F.col("raw"), F.col("base"), 0.5, 0.1).alias("shaped")))
)
_add("shape_final", f"""SELECT id, CASE WHEN raw > -1 THEN round(greatest(-1, least(1, raw + CASE WHEN coalesce(fc, 0) = 0 AND raw >= 0.10 THEN 0.02 WHEN coalesce(fc, 0) > 8 AND raw < 0.08 THEN -0.02 ELSE 0.0 END - CASE WHEN m > 0 THEN 0.25 ELSE 0.0 END)), 6) ELSE -1 END::DOUBLE AS reward
    FROM {_BATCH} LEFT JOIN (SELECT hash, max(count) AS m FROM {_ARCHIVE} GROUP BY hash) USING (hash) LEFT JOIN (SELECT family, count AS fc FROM {_FAMILIES}) USING (family)""")(
    lambda s, d: _round(shaping.score_batch(_batch_rows(s, d).drop("raw").withColumn("job", F.col("id")), _batch_rows(s, d).select(F.col("id").alias("job"), "raw"), _counts(s, d), _families(s, d, "hash")).select("id", "reward"))
)


def _split_profiles(spark, sf):
    rows = panel.direction_profile(scored(spark, sf)).withColumnRenamed("symbol", "expr_hash")
    return rows.where("expr_hash < 'm'"), rows.where("expr_hash >= 'm'")


_PROFILE = _SCORED + """, s AS (SELECT symbol, ts, sign(factor) AS pred, sign(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1) AS label FROM f),
 p AS (SELECT *, pred <> 0 AS mask, pred <> 0 AND pred = label AS correct FROM s WHERE label IS NOT NULL)"""


@_add("behavior_corr", _PROFILE + """, j AS (SELECT a.symbol, b.symbol AS item, count(*) AS n, abs(covar_pop(a.pred, b.pred) / nullif(stddev_pop(a.pred) * stddev_pop(b.pred), 0)) AS r FROM p a JOIN p b ON a.ts = b.ts AND a.symbol < 'm' AND b.symbol >= 'm' GROUP BY ALL)
    SELECT symbol AS expr_hash, round(coalesce(max(r), 0), 6) AS max_corr FROM j WHERE n >= 20 GROUP BY symbol""")
def _behaviour(spark, sf):
    return _round(shaping.max_behaviour_corr(*_split_profiles(spark, sf)))


@_add("residual_vote", _PROFILE + """, v AS (SELECT ts, sign(sum(pred)) AS vote FROM p WHERE symbol >= 'm' AND mask GROUP BY ts HAVING sum(pred) <> 0)
    SELECT symbol AS expr_hash, count(*) AS samples, round((avg(correct::INT) - 0.5) * 200, 6) AS residual FROM p JOIN v USING (ts) WHERE symbol < 'm' AND mask AND vote <> label GROUP BY symbol""")
def _residual(spark, sf):
    return _round(shaping.residual_score(*_split_profiles(spark, sf)))


def _rank_profiles(spark, sf):
    rows = panel.percentile_ranks(panel_rows(spark, sf))
    other = panel.percentile_ranks(panel.evaluate_panel(nation_bars(spark, sf), "sub(last(open(4)), ts_mean(high(4)))", 1, 8))
    return rows.select(F.lit("a").alias("expr_hash"), "ts", "symbol", "rank_pct"), other.select(F.lit("b").alias("expr_hash"), "ts", "symbol", "rank_pct")


_add("behavior_rank_corr")(lambda s, d: _round(shaping.rank_behaviour_corr(*_rank_profiles(s, d))))


# -- text

#: Every turn of the conversations, some of them with a tag, a fence or a bare expression around or after their text.
_TEXTS = """(SELECT 1000 * (conv_id + 1) + turn AS id, CASE (conv_id + turn) % 7 WHEN 1 THEN concat(text, ' so <expr> last(close(5)) </expr> it is') WHEN 2 THEN concat('see <EXPR>vwap(9)</EXPR>', text) WHEN 3 THEN concat(text, chr(10), 'ts_mean(close(9))')
 WHEN 4 THEN concat('```yaml', chr(10), 'a: ', text, chr(10), '```') WHEN 5 THEN concat(' a   b,c ,, d ', text) ELSE text END AS body FROM conversations) AS t"""


def _with_texts(spark, sf, source):
    return _rows_of(spark, sf, f"SELECT * FROM {source}")


@_add("text_extract_tag", f"""SELECT id, coalesce(trim(nullif(regexp_extract(body, '(?s)<expr>(.*?)</expr>', 1), '')), trim(nullif(regexp_extract(body, '(?is)<expr>(.*?)</expr>', 1), '')),
    nullif(regexp_extract(string_split(body, chr(10))[-1], '^([A-Za-z_][A-Za-z_0-9]*[(].*[)])$', 1), '')) AS expr FROM {_TEXTS}""")
def _tags(spark, sf):
    return _with_texts(spark, sf, _TEXTS).select("id", text.expression(F.col("body")).alias("expr"))


@_add("text_normalise_hash", f"SELECT id, substr(sha1(trim(regexp_replace(body, '[[:space:]]+', ' ', 'g'))), 1, 16) AS hash FROM {_TEXTS}")
def _hashes(spark, sf):
    return _with_texts(spark, sf, _TEXTS).select("id", text.exact_hash(F.col("body")).alias("hash"))


@_add("text_fence", f"SELECT id, coalesce(trim(nullif(regexp_extract(body, '(?is)```(?:yaml|yml|json)?[[:space:]]*(.*?)```', 1), ''), ' ' || chr(10)), trim(body)) AS body FROM {_TEXTS}")
def _fences(spark, sf):
    return _with_texts(spark, sf, _TEXTS).select("id", F.trim(text.fenced(F.col("body")), F.lit(" \n")).alias("body"))


@_add("text_list", f"SELECT id, array_to_string(list_filter(list_transform(string_split(body, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM {_TEXTS}")
def _lists(spark, sf):
    return _with_texts(spark, sf, _TEXTS).select("id", F.concat_ws("|", text.listed(F.col("body"))).alias("items"))


@_add("text_conversations_hash", "SELECT conv_id, turn, substr(sha1(trim(regexp_replace(text, '[[:space:]]+', ' ', 'g'))), 1, 16) AS hash FROM conversations")
def _conversation_hashes(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", text.exact_hash(F.col("text")).alias("hash"))


_MINUTES = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 60 WHEN p_partkey % 3 = 1 THEN p_size * 1440 ELSE p_size * 7 END AS minutes FROM part) AS t"


@_add("text_bar_label", f"SELECT id, CASE WHEN minutes % 1440 = 0 THEN (minutes // 1440) || '-day' WHEN minutes % 60 = 0 THEN (minutes // 60) || '-hour' ELSE minutes || '-minute' END AS label FROM {_MINUTES}")
def _labels(spark, sf):
    return _rows_of(spark, sf, f"SELECT * FROM {_MINUTES}").select("id", text.bar_label(F.col("minutes")).alias("label"))


@_add("text_lookback_hint", f"SELECT id, array_to_string(list_transform([20, 60, 120, 240], lambda w: w || ' bars = ' || CASE WHEN minutes >= 1440 THEN (w * minutes // 1440) || 'd' ELSE (w * minutes // 60) || 'h' END), ', ') AS hint FROM {_MINUTES}")
def _hints(spark, sf):
    return _rows_of(spark, sf, f"SELECT * FROM {_MINUTES}").select("id", text.lookback_hint(F.col("minutes")).alias("hint"))


_CODES = "(SELECT 1000 * (conv_id + 1) + turn AS id, CASE (conv_id + turn) % 4 WHEN 1 THEN concat('as <code>class A: pass', chr(10), '</code> shows ', text) WHEN 2 THEN concat('class B: pass ', text) ELSE text END AS body FROM conversations) AS t"


@_add("text_code", f"SELECT id, CASE WHEN regexp_matches(body, '(?s)<code>.*?</code>') THEN trim(regexp_extract(body, '(?s)<code>(.*?)</code>', 1), ' ' || chr(10)) WHEN contains(body, 'class ') THEN body END AS code FROM {_CODES}")
def _codes(spark, sf):
    return _with_texts(spark, sf, _CODES).select("id", F.trim(text.code(F.col("body")), F.lit(" \n")).alias("code"))


@_add("text_profile_hash", f"SELECT id, substr(sha1(body), 1, 12) AS hash FROM {_TEXTS}")
def _profile_hashes(spark, sf):
    return _with_texts(spark, sf, _TEXTS).select("id", text.profile_hash(F.col("body")).alias("hash"))


_SIZES = "(SELECT p_partkey AS id, CAST(p_partkey % 601 - 300 AS INT) AS x FROM part) AS t"


@_add("text_size_class", f"SELECT id, x, CASE WHEN abs(x) <= 5 THEN 0 WHEN abs(x) <= 20 THEN 1 WHEN abs(x) <= 60 THEN 2 WHEN abs(x) <= 120 THEN 3 WHEN abs(x) <= 240 THEN 4 ELSE 5 END::INT AS bucket FROM {_SIZES}")
def _classes(spark, sf):
    return _rows_of(spark, sf, f"SELECT * FROM {_SIZES}").select("id", "x", text.size_class(F.col("x")).alias("bucket"))


#: An answer with two candidates for each turn, and for some only a name.
_LOOSE = """(SELECT 1000 * (conv_id + 1) + turn AS id, CASE WHEN conv_id % 5 = 4 THEN concat('- name: n', conv_id) ELSE concat('- name: n', conv_id, ': b', chr(10), '  expr: last(close(', turn + 1, '))', chr(10), '  intuition: "so: ', role, '"', chr(10),
 '- expr: vwap(', conv_id % 50 + 1, ')', chr(10), '  category: volume') END AS body FROM conversations) AS t"""
_LOOSE_SQL = """(SELECT 1000 * (conv_id + 1) + turn AS id, i AS idx, CASE i WHEN 0 THEN concat('n', conv_id, ': b') ELSE 'seed_0001' END AS name, CASE i WHEN 0 THEN concat('last(close(', turn + 1, '))') ELSE concat('vwap(', conv_id % 50 + 1, ')') END AS expr,
 CASE i WHEN 0 THEN concat('so: ', role) ELSE '' END AS intuition, CASE i WHEN 0 THEN 'general' ELSE 'volume' END AS category FROM conversations, (SELECT unnest([0, 1]) AS i) WHERE conv_id % 5 <> 4) AS t"""


@_add("text_loose_candidates", f"SELECT id, idx, name, expr, intuition, category, format('seed_{{:04d}}', idx) AS seed_id FROM {_LOOSE_SQL}")
def _loose(spark, sf):
    return text.loose_candidates(_rows_of(spark, sf, f"SELECT * FROM {_LOOSE}"))


@_add("text_iso_date", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts - INTERVAL 12 DAY, '%Y-%m-%d') AS loaded_from FROM events")
def _iso(spark, sf):
    rows = _table(spark, sf, "events")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(B.load_start(F.col("ts"), 10), "yyyy-MM-dd").alias("loaded_from"))


# -- bars with other edges, ranges after windows, callables

_LEFT_SQL = _bars_sql().replace(_label_sql("ts", EVENT_MINUTES), f"make_timestamp((epoch_us(ts) // {EVENT_MINUTES * 60_000_000}) * {EVENT_MINUTES * 60_000_000})")


@_add("bars_left_closed", f"SELECT symbol, ts, {_OHLCV} FROM ({_LEFT_SQL})")
def _left(spark, sf):
    return _round(B.resample(B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0)), EVENT_MINUTES, closed="left"), 8)


_ORIGIN_US = 1_704_067_200_000_000
_ORIGIN_LABEL = f"make_timestamp({_ORIGIN_US} + ((epoch_us(ts) - {_ORIGIN_US} + 7 * 60000000 - 1) // (7 * 60000000)) * 7 * 60000000)"


@_add("bars_anchored", f"SELECT symbol, ts, {_OHLCV} FROM ({_bars_sql(7).replace(_label_sql('ts', 7), _ORIGIN_LABEL)})")
def _anchored(spark, sf):
    return _round(B.resample(B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0)), 7, origin="2024-01-01"), 8)


@_add("bars_finite", f"SELECT symbol, count(*) AS n FROM ({_bars_sql()}) WHERE isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume) GROUP BY symbol")
def _finite(spark, sf):
    return B.finite_rows(event_bars(spark, sf)).groupBy("symbol").agg(F.count("*").alias("n"))


@_add("evaluation_start", _SCORED + " SELECT symbol, ts, round(factor, 4) AS factor FROM f WHERE ts >= TIMESTAMP '2024-01-10'")
def _from_start(spark, sf):
    return _round(panel.after_start(scored(spark, sf), "2024-01-10").select("symbol", "ts", "factor"), 4)


def _body_share(rows):
    return rows.assign(factor=(rows.close - rows.open).rolling(3, min_periods=1).mean())[["symbol", "ts", "factor"]]


@_add("user_factor", f"WITH bars AS ({_bars_sql()}) SELECT symbol, ts, round(avg(close - open) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) + 0.0::DOUBLE AS factor FROM bars")
def _user(spark, sf):
    return _round(panel.user_factor(event_bars(spark, sf), _body_share), 4)


@_add("warmup_ladder", f"""SELECT id, bars, days, CASE WHEN m >= 1440 THEN 1 ELSE days * (1440 // m) END::INT AS skipped FROM (SELECT id, m, bars, CASE WHEN m >= 1440 THEN greatest(180, 2 * bars + 30) ELSE greatest(10, ceil(m * bars / 1440)::INT + 5) END::INT AS days
    FROM (SELECT id, minutes AS m, CASE WHEN minutes >= 1440 OR minutes <= 5 THEN 240 WHEN minutes <= 60 THEN 96 WHEN minutes <= 240 THEN 64 ELSE 32 END::INT AS bars FROM {_MINUTES}))""")
def _ladder(spark, sf):
    rows = _rows_of(spark, sf, f"SELECT id, CAST(minutes AS INT) AS minutes FROM {_MINUTES}").withColumn("bars", panel.warmup_bars(F.col("minutes")))
    rows = rows.withColumn("days", panel.warmup_days(F.col("minutes"), F.col("bars")))
    return rows.select("id", "bars", "days", panel.backtest_warmup(F.col("minutes"), F.col("days")).alias("skipped"))


# -- evaluation of candidates, gates, pools, cycles

_SHORT = "round((avg(CASE WHEN factor <> 0 THEN (sign(factor) = sign(fwd))::INT END) - 0.5) * 200, 6) AS reward, round(avg((factor <> 0)::INT), 6) AS coverage, sum((factor <> 0)::INT)::DOUBLE AS samples"


@_add("seed_evaluate", f"""WITH bars AS ({_bars_sql()}), f AS (SELECT symbol, ts, close, unnest([{{'id': 'trend', 'factor': close - avg(close) OVER w}}, {{'id': 'body', 'factor': close - open}}], recursive := true)
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, lead(close) OVER (PARTITION BY id, symbol ORDER BY ts) / close - 1 AS fwd FROM f WHERE close > 0)
    SELECT id, symbol, true AS valid, 'evaluated' AS status, {_SHORT} FROM s WHERE fwd IS NOT NULL GROUP BY id, symbol HAVING count(*) >= 50
    UNION ALL SELECT id, symbol, false, 'eval_filtered', -100, NULL, count(*)::DOUBLE FROM s WHERE fwd IS NOT NULL GROUP BY id, symbol HAVING count(*) < 50
    UNION ALL SELECT 'broken', NULL, false, 'eval_error', NULL, NULL, NULL""")
def _seed_evaluate(spark, sf):
    out = seeds.evaluate(event_bars(spark, sf), [("trend", "sub(last(close(5)), ts_mean(close(5)))"), ("body", "last(close(2)) - last(open(2))"), ("broken", "bad(")])
    m = lambda n: F.try_element_at("metrics", F.lit(n)).alias(n)
    return _round(out.select("id", "symbol", "valid", "status", m("reward"), m("coverage"), m("samples")))


_FOUND = """(SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'direction' WHEN 1 THEN 'ic' WHEN 2 THEN 'rank_ic' WHEN 3 THEN 'cross_sectional_rankic' ELSE 'signal_return' END AS kind, CAST(p_size AS DOUBLE) / 10 AS predictive,
 CAST(45 + p_partkey % 15 AS DOUBLE) / 100 AS direction_acc, CAST(p_partkey % 11 AS DOUBLE) / 10 AS coverage, CAST(p_partkey % 7 - 3 AS DOUBLE) / 100 AS value, CAST(p_partkey % 4 - 1 AS DOUBLE) / 100 AS mean_rank_ic, CAST(p_size * 2 AS DOUBLE) AS samples FROM part) AS t"""


@_add("quality_gate", f"""SELECT id FROM {_FOUND} WHERE CASE WHEN kind = 'direction' THEN predictive >= 2 AND direction_acc >= 0.51 AND coverage >= 0.6 WHEN kind IN ('ic', 'rank_ic') THEN value >= 0.01 AND samples >= 50
    WHEN kind = 'cross_sectional_rankic' THEN mean_rank_ic >= 0.01 AND coverage >= 0.6 ELSE true END""")
def _gate(spark, sf):
    return panel.quality_gate(_rows_of(spark, sf, f"SELECT * FROM {_FOUND}"), F.col("kind"), F.col).select("id")


@_add("seed_pool", f"{_SCORED_SEEDS} SELECT id FROM s WHERE valid OR invert")
def _pool(spark, sf):
    return seeds.sample_pool(_seed_rows(spark, sf)).select("id")


_BARE = """(SELECT p_partkey AS idx, CASE WHEN p_partkey % 3 = 1 THEN concat('p', p_partkey) END AS id, CASE WHEN p_partkey % 4 = 2 THEN p_name END AS name, concat('close(', p_size, ')') AS expr, CASE WHEN p_size > 25 THEN p_brand END AS intuition,
 CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS category FROM part) AS t"""


@_add("seed_defaults", f"""SELECT idx, coalesce(id, format('seed_{{:04d}}', idx)) AS id, coalesce(name, id, format('seed_{{:04d}}', idx)) AS name, expr, coalesce(intuition, '') AS intuition, coalesce(category, 'general') AS category FROM {_BARE}""")
def _defaults(spark, sf):
    return seeds.with_defaults(_rows_of(spark, sf, f"SELECT * FROM {_BARE}"))


@_add("task_cycle", f"""SELECT 'no_seed__' || s.name || '__' || i.id AS task_id, s.name AS split, start_date, end_date FROM (SELECT unnest(range(500)) AS id) i JOIN (SELECT *, row_number() OVER (ORDER BY name) - 1 AS at FROM {_SPLITS}) s ON s.at = i.id % (SELECT count(*) FROM {_SPLITS})""")
def _cycle(spark, sf):
    return seeds.cycle_tasks(spark, _splits(spark, sf), 500).select("task_id", "split", "start_date", "end_date")


# -- batches against scores and archives

_ANSWERS = """(SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 9 = 8 THEN '' ELSE concat('e', (conv_id + turn) % 31) END AS expr, CASE WHEN turn % 4 = 3 THEN '' ELSE concat('s', conv_id % 8) END AS seed_expr, concat('d', conv_id % 3) AS start_date FROM conversations) AS t"""
_DONE = """(SELECT DISTINCT concat(CASE WHEN event_id % 3 = 0 THEN 's' ELSE 'e' END, user_id % 40) AS expr, concat('d', event_id % 2) AS start_date, CAST(user_id % 40 AS DOUBLE) / 50 AS raw FROM events) AS t"""


def _answers(spark, sf):
    return _rows_of(spark, sf, f"SELECT id, expr, seed_expr, start_date, 'z' AS end_date, 5 AS bar_minutes, 1 AS horizon FROM {_ANSWERS}")


@_add("batch_jobs", f"SELECT DISTINCT expr, start_date FROM (SELECT expr, start_date FROM {_ANSWERS} UNION ALL SELECT seed_expr, start_date FROM {_ANSWERS}) WHERE expr <> ''")
def _jobs(spark, sf):
    return shaping.jobs(_answers(spark, sf), True).select("expr", "start_date")


@_add("batch_baseline", f"""SELECT a.id, coalesce(r.raw, -1)::DOUBLE AS raw, CASE WHEN a.seed_expr = '' THEN coalesce(r.raw, -1) ELSE coalesce(b.raw, 0) END::DOUBLE AS baseline
    FROM {_ANSWERS[:-1]}a LEFT JOIN (SELECT * FROM {_DONE}) r USING (expr, start_date) LEFT JOIN (SELECT expr AS seed_expr, start_date, raw FROM {_DONE}) b ON a.seed_expr = b.seed_expr AND a.start_date = b.start_date""")
def _baseline(spark, sf):
    done = _rows_of(spark, sf, f"SELECT expr, start_date, 'z' AS end_date, 5 AS bar_minutes, 1 AS horizon, cast(raw AS double) AS raw FROM {_DONE}")
    return shaping.with_scores(_answers(spark, sf), done, True).select("id", "raw", "baseline")


_STATS = """(SELECT event_id AS id, CASE WHEN event_id % 19 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(event_id % 101 AS DOUBLE) / 100 END AS raw, CAST(user_id % 40 AS DOUBLE) / 100 AS baseline, user_id % 4 AS exact_seen, event_id % 13 AS family_seen,
 CAST(event_id * 7 % 30 AS DOUBLE) - 6 AS residual, event_id * 11 % 500 AS samples, CAST(event_id * 3 % 100 AS DOUBLE) / 100 AS max_corr, CAST(event_id * 17 % 100 AS DOUBLE) / 100 AS rank_max_corr, event_id * 5 % 400 AS rank_samples FROM events) AS t"""
_RESIDUAL = "CASE WHEN raw >= 0.16 AND samples >= 200 THEN 0.04 * greatest(0, least(1, residual / 10)) ELSE 0 END - CASE WHEN max_corr > 0.92 THEN 0.03 * (max_corr - 0.92) ELSE 0 END"
_RANKS = "CASE WHEN raw < 0.12 THEN 0 WHEN rank_samples >= 200 AND rank_max_corr > 0.85 THEN -0.08 * (rank_max_corr - 0.85) WHEN rank_samples > 0 AND rank_max_corr < 0.5 THEN 0.02 ELSE 0 END"


def _stats_rows(spark, sf):
    return _rows_of(spark, sf, f"SELECT * FROM {_STATS}")


@_add("shape_residual", f"SELECT id, round({_RESIDUAL}, 6)::DOUBLE AS shift FROM {_STATS}")
def _shape_residual(spark, sf):
    return _round(shaping.shape(_stats_rows(spark, sf), residual=True).select("id", F.col("residual_shift").alias("shift")))


@_add("shape_behaviour", f"SELECT id, round({_RANKS}, 6)::DOUBLE AS shift FROM {_STATS}")
def _shape_behaviour(spark, sf):
    return _round(shaping.shape(_stats_rows(spark, sf), behaviour=True).select("id", F.col("behaviour_shift").alias("shift")))


@_add("shape_everything", f"""SELECT id, round(CASE WHEN raw > -1 THEN greatest(-1, least(1, raw + 0.5 * greatest(raw - baseline, 0) - CASE WHEN exact_seen > 0 THEN 0.15 ELSE 0 END
    + CASE WHEN family_seen = 0 AND raw >= 0.1 THEN 0.02 WHEN family_seen > 8 AND raw < 0.08 THEN -0.02 ELSE 0 END + {_RESIDUAL} + {_RANKS})) ELSE -1 END, 6)::DOUBLE AS reward FROM {_STATS}""")
def _shape_everything(spark, sf):
    return _round(shaping.shape(_stats_rows(spark, sf), True, True, True, True, True).select("id", "reward"))


@_add("archive_updates", f"SELECT 'exact' AS archive, count(DISTINCT hash) AS n FROM {_BATCH} UNION ALL SELECT 'family', count(DISTINCT family) FROM {_BATCH} UNION ALL SELECT 'residual', count(*) FROM {_BATCH} WHERE raw >= 0.16 UNION ALL SELECT 'behaviour', count(*) FROM {_BATCH} WHERE raw >= 0.12")
def _updates(spark, sf):
    families = _families(spark, sf, "hash")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("archive"), "n") for name, df in shaping.updates(_batch_rows(spark, sf).withColumn("expr", F.col("hash")), _counts(spark, sf), families).items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# -- a batch from text to shaped reward

_TRIED = ("sub(last(close(5)), ts_mean(close(5)))", "last(close(2)) - last(open(2))", "bad(")
_TAGGED = "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_TRIED)) + " WHEN 3 THEN '' END"
_SEEN = f"(VALUES ('{_TRIED[0]}', 2), ('{_TRIED[2]}', 5)) AS e(expr, count)"


def batch_answers(spark, sf, tagged=_TAGGED):
    rows = _table(spark, sf, "conversations")
    tag = F.expr(tagged)
    body = F.when(tag.isNull(), F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" <expr> "), tag, F.lit("</expr>")))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("text"), F.lit("").alias("seed_expr"), F.lit("2024-01-20").alias("start_date"), F.lit("2024-01-31").alias("end_date"),
        F.when(F.col("conv_id") % 3 == 0, 60).otherwise(EVENT_MINUTES).alias("bar_minutes"), (1 + F.col("conv_id") % 2).cast("int").alias("horizon"),
    )


#: By bar size: the first midnight loaded (the days of the warm-up ladder and two more before the start) and the first bar kept.
_WINDOWS = "(VALUES (60, TIMESTAMP '2024-01-08', 96 - 1 + 10 * 24), (240, TIMESTAMP '2024-01-02', 64 - 1 + 16 * 6)) AS w(m, loaded, first)"


@_add("batch_end_to_end", f"""WITH bars AS (SELECT 60 AS m, * FROM ({_bars_sql(60)}) UNION ALL SELECT {EVENT_MINUTES}, * FROM ({_bars_sql()})),
    f AS (SELECT m, symbol, ts, close, unnest([{{'expr': '{_TRIED[0]}', 'factor': close - avg(close) OVER w}}, {{'expr': '{_TRIED[1]}', 'factor': close - open}}], recursive := true) FROM bars WINDOW w AS (PARTITION BY m, symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    n AS (SELECT f.*, first, row_number() OVER (PARTITION BY m, expr, symbol ORDER BY ts) AS n FROM f JOIN {_WINDOWS} USING (m) WHERE ts >= loaded AND ts <= TIMESTAMP '2024-01-31'),
    s AS (SELECT n.*, h.horizon, CASE WHEN horizon = 1 THEN lead(close) OVER o ELSE lead(close, 2) OVER o END / close - 1 AS fwd FROM n, (VALUES (1), (2)) AS h(horizon) WHERE close > 0 AND n >= first AND ts >= TIMESTAMP '2024-01-20' WINDOW o AS (PARTITION BY m, expr, horizon, symbol ORDER BY ts)),
    r AS (SELECT m AS bar_minutes, expr, horizon, CASE WHEN count(*) >= 50 THEN (avg(CASE WHEN factor <> 0 THEN (sign(factor) = sign(fwd))::INT END) - 0.5) * 2 + 0.1 ELSE -1 END AS raw FROM s WHERE fwd IS NOT NULL GROUP BY ALL),
    a AS (SELECT conv_id * 1000 + turn AS id, 1 + conv_id % 2 AS horizon, CASE WHEN conv_id % 3 = 0 THEN 60 ELSE {EVENT_MINUTES} END AS bar_minutes, coalesce({_TAGGED}, '') AS expr FROM conversations),
    j AS (SELECT a.id, a.expr, bar_minutes, coalesce(raw, -1) AS raw, coalesce(e.count, 0) AS seen FROM a LEFT JOIN r USING (expr, horizon, bar_minutes) LEFT JOIN {_SEEN} ON e.expr = a.expr),
    k AS (SELECT *, CASE WHEN seen > 0 THEN 0.15 ELSE 0 END AS penalty, CASE WHEN expr <> '{_TRIED[1]}' AND raw >= 0.1 THEN 0.02 WHEN expr = '{_TRIED[1]}' AND raw < 0.08 THEN -0.02 ELSE 0 END AS family FROM j)
    SELECT id, expr, bar_minutes, round(raw, 6)::DOUBLE AS raw, round(CASE WHEN raw > -1 THEN greatest(-1, least(1, raw - penalty + family)) ELSE -1 END, 6)::DOUBLE AS reward FROM k""")
def _end_to_end(spark, sf):
    exact = spark.sql(f"SELECT expr, cast(count AS bigint) AS count FROM {_SEEN}").select(text.exact_hash(F.col("expr")).alias("hash"), "count")
    family = spark.createDataFrame([(family_hash(_TRIED[1]), 9)], "hash string, count long")
    trades = B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0))
    out = scoring.score_answers(batch_answers(spark, sf), trades, exact, family)
    return _round(out.rows.select("id", "expr", "bar_minutes", "raw", "reward"))


@_add("single_asset_rows", f"""WITH bars AS (SELECT * FROM ({_bars_sql(60)}) WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-29'),
    f AS (SELECT symbol, ts, close, close - avg(close) OVER w AS factor, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(factor, 4) + 0.0::DOUBLE AS factor, round(close, 4) + 0.0::DOUBLE AS close FROM f WHERE n >= 48 - 1 + 10 * 24 AND ts >= TIMESTAMP '2024-01-15' AND close > 0""")
def _single(spark, sf):
    trades = B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0))
    return _round(scoring.single_asset(trades, _TRIED[0], "2024-01-15", "2024-01-29", 60), 4)


_CROSSED = (_REVERSAL, "sub(last(close(5)), last(open(5)))")
_CROSS_TAGS = f"CASE (conv_id + turn) % 4 WHEN 0 THEN '{_CROSSED[0]}' WHEN 1 THEN '{_CROSSED[1]}' WHEN 2 THEN 'bad(' END"


@_add("batch_cross_section", f"""WITH bars AS ({_NATION_SQL}),
    f0 AS (SELECT symbol, ts, close, unnest([{{'expr': '{_CROSSED[0]}', 'factor': coalesce(-((close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8)), 0)}}, {{'expr': '{_CROSSED[1]}', 'factor': close - open}}], recursive := true) FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    l AS (SELECT *, row_number() OVER (PARTITION BY expr, symbol ORDER BY ts) AS n FROM f0 WHERE ts >= TIMESTAMP '1993-12-20' AND ts <= TIMESTAMP '1998-06-30'),
    h AS (SELECT l.*, horizon, CASE WHEN horizon = 1 THEN lead(close) OVER o ELSE lead(close, 2) OVER o END / close - 1 AS fwd FROM l, (VALUES (1), (2)) AS h(horizon) WINDOW o AS (PARTITION BY expr, horizon, symbol ORDER BY ts)),
    f AS (SELECT expr, horizon, symbol, ts, factor, fwd, count(*) OVER (PARTITION BY expr, horizon, ts) AS n FROM h WHERE n >= 96 AND ts >= TIMESTAMP '1994-01-01' AND fwd IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY expr, horizon, ts ORDER BY factor) + (count(*) OVER (PARTITION BY expr, horizon, ts, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY expr, horizon, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY expr, horizon, ts, fwd) - 1) / 2 AS rr FROM f WHERE n >= 8),
    x AS (SELECT expr, horizon, ts, covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0) AS rank_ic FROM k GROUP BY ALL),
    z AS (SELECT expr, horizon, count(DISTINCT symbol) AS symbols FROM h WHERE n >= 96 AND ts >= TIMESTAMP '1994-01-01' GROUP BY ALL),
    r AS (SELECT expr, horizon, CASE WHEN count(rank_ic) < 20 OR any_value(symbols) < 8 THEN -1 ELSE greatest(-1, least(1, 5 * avg(rank_ic) + 0.02 * tanh(avg(rank_ic) / (stddev_pop(rank_ic) + 1e-8) * sqrt(count(rank_ic))))) END AS raw FROM x JOIN z USING (expr, horizon) WHERE rank_ic IS NOT NULL GROUP BY ALL),
    a AS (SELECT conv_id * 1000 + turn AS id, 1 + conv_id % 2 AS horizon, coalesce({_CROSS_TAGS}, '') AS expr FROM conversations)
    SELECT id, expr, round(coalesce(raw, -1), 6)::DOUBLE AS raw, round(CASE WHEN coalesce(raw, -1) > -1 THEN greatest(-1, least(1, raw + CASE WHEN raw >= 0.1 THEN 0.02 ELSE 0 END)) ELSE -1 END, 6)::DOUBLE AS reward FROM a LEFT JOIN r USING (expr, horizon)""")
def _cross_batch(spark, sf):
    none = spark.createDataFrame([], "hash string, count long")
    answers = batch_answers(spark, sf, _CROSS_TAGS).withColumns({"start_date": F.lit("1994-01-01"), "end_date": F.lit("1998-06-30"), "bar_minutes": F.lit(1440)})
    out = scoring.score_answers(answers, nation_bars(spark, sf), none, none, scoring.CROSS)
    return _round(out.rows.select("id", "expr", "raw", "reward"))


@_add("metrics_densify", "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN value ELSE 0 END::DOUBLE AS click, CASE WHEN event_type = 'error' THEN value ELSE 0 END::DOUBLE AS error FROM events")
def _densify(spark, sf):
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), F.create_map("event_type", "value").alias("metrics"))
    return shaping.densify(rows, ["click", "error"])


@_add("task_attribute", "SELECT event_id AS id, coalesce(event_type, '') AS split, CASE WHEN user_id % 3 = 0 THEN 5 ELSE user_id % 60 END::INT AS bar_minutes FROM events")
def _attribute(spark, sf):
    minutes = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 60).cast("int"))
    rows = _table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("split"), F.struct(minutes.alias("bar_minutes")).alias("extra_info"))
    return rows.select("id", T.attribute(rows, "split", "").alias("split"), T.attribute(rows, "bar_minutes", 5, "int").alias("bar_minutes"))


# -- long histories and whole-table ranks

_BLOCKED = {"a": "ts_mean(close(20))", "b": "ema_arr(close(9), 4)", "c": "corr(returns(9), diff(close(12)))", "d": "ts_max(normalize(close(9)))"}


@_add("factors_in_blocks", _FRAMED.replace(_bars_sql(), _bars_sql(7)) + ", c AS (SELECT *, " + _over("list(close) {w9} AS l, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n") + """ FROM b) SELECT symbol, ts, n, """ + _over("""round(avg(close) {w20}, 4) AS a,
    round(list_sum(list_transform(l, lambda x, k: x * 0.6 ** (len(l) - k))) / (list_sum(list_transform(l, lambda x, k: 0.6 ** (len(l) - k))) + 1e-8), 4) AS b,
    round(coalesce(CASE WHEN stddev_pop(CASE WHEN dc IS NOT NULL THEN r END) {w9} > 1e-12 AND stddev_pop(CASE WHEN r IS NOT NULL THEN dc END) {w9} > 1e-12 THEN covar_pop(r, dc) {w9} / (stddev_pop(CASE WHEN dc IS NOT NULL THEN r END) {w9} * stddev_pop(CASE WHEN r IS NOT NULL THEN dc END) {w9}) END, 0), 6) + 0.0::DOUBLE AS c,
    round((max(close) {w9} - avg(close) {w9}) / (stddev_pop(close) {w9} + 1e-8), 4) AS d""") + " FROM c")
def _blocked(spark, sf):
    rows = factors_in_blocks(B.finite_rows(event_bars(spark, sf, 7)), _BLOCKED, block=500, position="n")
    return _round(rows.select("symbol", "ts", "n", *[F.round(x, 6 if x == "c" else 4).alias(x) for x in _BLOCKED]))


@_add("rank_whole_table", """WITH k AS (SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS price_rank FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice, price_rank::DOUBLE AS price_rank FROM k""")
def _rank_whole(spark, sf):
    return average_ranks(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), {"price_rank": "l_extendedprice"})


@_add("reward_rank_ic_whole", _SERIES.format(h=1) + """, k AS (SELECT rank() OVER (ORDER BY factor) + (count(*) OVER (PARTITION BY factor) - 1) / 2 AS rf, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2 AS rr FROM a),
    g AS (SELECT count(*) AS n, covar_pop(rf, rr) / nullif(stddev_pop(rf) * stddev_pop(rr), 0) AS r FROM k) SELECT round(CASE WHEN n < 50 OR r IS NULL THEN -1 ELSE r END, 6)::DOUBLE AS value, n >= 50 AND r IS NOT NULL AS passed FROM g""")
def _rank_ic_whole(spark, sf):
    return _round(panel.rank_ic(labelled(spark, sf)).select("value", "passed"))


# -- stores that grow

@_add("ledger_counts", f"SELECT hash, count(*) AS count FROM {_BATCH} GROUP BY hash")
def _ledger_counts(spark, sf):
    ledger = Ledger(spark, scratch_path(spark, "ledger"), "hash string, count long")
    rows = _batch_rows(spark, sf)
    for part in range(3):
        count_batch(ledger, rows.where(F.col("id") % 3 == part))
    ledger.compact()
    return counted(ledger)


@_add("ledger_mined", f"SELECT expr, max(score) AS score FROM (SELECT expr, coverage AS score FROM {_SEEDS} WHERE valid AND reward >= 2 AND direction_acc >= 0.51 AND coverage >= 0.6) GROUP BY expr")
def _ledger_mined(spark, sf):
    ledger = T.mined_ledger(spark, scratch_path(spark, "mined"))
    rows = _rows_of(spark, sf, f"SELECT expr, coverage AS score, reward AS predictive, direction_acc, coverage, 0 AS value, 0 AS samples, 0 AS mean_rank_ic FROM {_SEEDS} WHERE valid")
    for _ in range(2):  # the same factors twice, as two writers would
        T.add_mined(ledger, rows, F.lit("direction"), F.col)
    return T.mined(ledger).select("expr", "score")


_PROFILED = (_TRIED[0], _TRIED[1])


@_add("profile_store", f"""WITH bars AS (SELECT 60 AS m, * FROM ({_bars_sql(60)}) UNION ALL SELECT {EVENT_MINUTES}, * FROM ({_bars_sql()})),
    f AS (SELECT m, symbol, ts, close, unnest([{{'expr': '{_TRIED[0]}', 'factor': close - avg(close) OVER w}}, {{'expr': '{_TRIED[1]}', 'factor': close - open}}], recursive := true) FROM bars WINDOW w AS (PARTITION BY m, symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    n AS (SELECT f.*, first, row_number() OVER (PARTITION BY m, expr, symbol ORDER BY ts) AS n FROM f JOIN {_WINDOWS} USING (m) WHERE ts >= loaded AND ts <= TIMESTAMP '2024-01-31'),
    s AS (SELECT n.*, lead(close) OVER (PARTITION BY m, expr, symbol ORDER BY ts) / close - 1 AS fwd FROM n WHERE close > 0 AND n >= first AND ts >= TIMESTAMP '2024-01-20')
    SELECT substr(sha1(expr), 1, 12) AS expr_hash, m AS bar_minutes, symbol, ts, sign(factor)::TINYINT AS pred, sign(fwd)::TINYINT AS label, factor <> 0 AS mask, factor <> 0 AND sign(factor) = sign(fwd) AS correct FROM s WHERE fwd IS NOT NULL""")
def _profile_store(spark, sf):
    trades = B.trades(_table(spark, sf, "events"), "event_type", "ts", "value", F.lit(1.0))
    store = ProfileStore(spark, scratch_path(spark, "profiles"))
    jobs = lambda end: [Job(e, "2024-01-20", end, m) for e in _PROFILED for m in (60, EVENT_MINUTES)]
    store.request(trades, jobs("2024-01-25"))
    out = store.request(trades, jobs("2024-01-31"))
    return out.select("expr_hash", "bar_minutes", "symbol", "ts", "pred", "label", "mask", "correct")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _Q.items() if sql is not None}
