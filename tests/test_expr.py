import pytest
from pyspark.sql import functions as F

from quillon.plans.expr import ExprError, exact_hash, family_hash, form, lookback, parse, validate
from quillon.plans.lower import factors
from quillon.sources.bars import finite_rows, resample, trades


def test_types_and_errors():
    assert parse("close(5)").kind == "ARRAY" and parse("-ts_mean(close(5))").kind == "SCALAR" and parse("close(5) + 1").kind == "ARRAY"
    for bad in ("foo(3)", "close(0)", "close(True)", "close(w=3)", "close(3) ** 2", "ts_mean(3)", "close(", "x.y", "corr(close(3))"):
        with pytest.raises(ExprError):
            parse(bad)
    assert lookback(parse("ts_mean(returns(8))")) == 8


def test_stats_hashes_and_validation():
    assert form("close(60)").size == (5, 4)
    assert exact_hash(" a  b ") == exact_hash("a b")
    assert family_hash("ts_mean(close(6))") == family_hash("ts_mean(close(20))") != family_hash("ts_mean(close(60))")
    assert validate("ts_mean(close(5))").valid and not validate("nope(close(5))").valid and not validate("(").valid


EXPRS = {
    "a": "div(ts_mean(diff(close(8))), ts_std(diff(close(8))))", "b": "corr(close(8),volume(5))", "c": "rank(last(close(9)),close(9))", "d": "ema_arr(diff(close(7)),4)",
    "e": "ts_skew(normalize(close(9)))", "f": "close(5)-open(5)", "g": "ts_kurt(log_arr(close(9)))", "h": "zscore(vwap(4),close(8))", "i": "cov(add_arr(close(9),open(4)),diff(high(5)))",
    "j": "neg(first(slice_arr(close(9),3)))", "k": "ts_sum(close(4)*2+1)", "l": "close(4)+open(6)", "m": "ts_max(diff(close(1)))",
}


def bars(spark):
    rows = [("s", i, float(100 + (i * 37) % 11), float(1 + i % 4)) for i in range(30)] + [("t", i, 5.0, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double, volume double")
    ts = F.timestamp_micros(F.col("i").cast("long") * 60_000_000).cast("timestamp_ntz")
    return df.select("symbol", ts.alias("ts"), (F.col("close") - 1).alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 2).alias("low"), "close", "volume")


def test_both_tiers_agree(spark):
    a = factors(bars(spark), EXPRS).orderBy("symbol", "ts").collect()
    b = factors(bars(spark), EXPRS, force_arrays=True).orderBy("symbol", "ts").collect()
    for x, y in zip(a, b, strict=True):
        for k in EXPRS:
            assert x[k] == pytest.approx(y[k], abs=1e-7), (k, x, y)


def test_infinite_and_missing_rows_go_before_windows(spark):
    df = bars(spark).withColumn("close", F.when(F.col("ts") == F.expr("timestamp_ntz '1970-01-01 00:03:00'"), F.lit(float("inf"))).otherwise(F.col("close")))
    assert finite_rows(df).count() == 40


def test_bar_on_the_boundary_labels_itself(spark):
    df = spark.sql("select 's' s, timestamp_ntz '2024-01-01 00:05:00' t, 1.0d p, 1.0d v union all select 's', timestamp_ntz '2024-01-01 00:05:01', 2.0d, 1.0d")
    got = [(r.ts.minute, r.open) for r in resample(trades(df, "s", "t", "p", "v"), 5).orderBy("ts").collect()]
    assert got == [(5, 1.0), (10, 2.0)]
