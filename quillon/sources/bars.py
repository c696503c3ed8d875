"""OHLCV tables: scan, universe, range and finite filters, resampling.

A bar table is (symbol, ts, open, high, low, close, volume) with ts TIMESTAMP_NTZ and doubles.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.stats import finite, is_finite
from quillon.sources.scratch import stash

FIELDS = ("open", "high", "low", "close", "volume")
DAY_MINUTES = 1440


def symbol_file(symbol: str) -> str:
    """File stem of a symbol."""
    return symbol.translate(str.maketrans("/:", "__"))


def load_start(start: str | Column, warmup_days: int, buffer_days: int = 2) -> Column:
    """The midnight to load from so that windows are full at ``start``."""
    first = F.lit(start) if isinstance(start, str) else start
    return F.date_sub(first.cast("date"), warmup_days + buffer_days).cast("timestamp_ntz")


def between(rows: DataFrame, ts: Column, start: str | Column | None = None, end: str | Column | None = None) -> DataFrame:
    """Rows of a time range, both ends inclusive; a date means its midnight."""
    at = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("timestamp_ntz")
    rows = rows if start is None else rows.where(ts >= at(start))
    return rows if end is None else rows.where(ts <= at(end))


def _symbol_of(name: Column, template: str) -> Column:
    """The symbol of a file name; an empty string if the name is not of the template."""
    before, after = template.split("{symbol}")
    return F.regexp_replace(F.regexp_extract(name, rf"^\Q{before}\E(.*)\Q{after}\E$", 1), "_", "/")


def symbol_files(spark: SparkSession, path: str, template: str = "{symbol}.parquet") -> DataFrame:
    """(symbol, path) of the files of a folder, from a listing alone: no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", template.replace("{symbol}", "*")).load(path).select("path")
    return listed.select(_symbol_of(F.substring_index("path", "/", -1), template).alias("symbol"), "path").where("symbol <> ''")


def scan(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, time_col: str = "ts", symbol_col: str | None = "symbol", template: str = "{symbol}.parquet", warmup_days: int | None = None,
    symbols: list[str] | None = None,
) -> DataFrame:
    """One table from a folder of Parquet files; symbol from a column, else from the file name.

    Both ends of the range are inclusive; an end date means its midnight; with warmup_days the range begins that many
    days and a buffer earlier.  Columns are pruned and the range is pushed into the scan.  symbols: of a folder with a file for
    each symbol, only the files of these are touched; one that has no file is an error.
    """
    if symbols is None:
        raw = spark.read.parquet(path)
    else:
        files = symbol_files(spark, path, template).where(F.col("symbol").isin(symbols)).collect()  # a row for each symbol asked for
        lost = sorted(set(symbols) - {r.symbol for r in files})
        if lost:
            raise ValueError(f"no files of: {lost}")
        raw = spark.read.parquet(*[r.path for r in files])
    missing = [f for f in (*FIELDS, time_col) if f not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if symbol_col in raw.columns:
        symbol = F.col(symbol_col).cast("string")
    else:
        symbol = _symbol_of(F.col("_metadata.file_name"), template)
    ts = F.col(time_col).cast("timestamp_ntz")
    rows = between(raw, ts, load_start(start, warmup_days) if start is not None and warmup_days is not None else start, end)
    return rows.select(symbol.alias("symbol"), ts.alias("ts"), *[F.col(f).cast("double").alias(f) for f in FIELDS])


def universe(bars: DataFrame, limit: int | None = None) -> DataFrame:
    out = bars.select("symbol").distinct().orderBy("symbol")
    return out if limit is None else out.limit(limit)


def finite_rows(bars: DataFrame) -> DataFrame:
    keep = is_finite(FIELDS[0])
    for f in FIELDS[1:]:
        keep = keep & is_finite(f)
    return bars.where(keep)


def label(ts: Column, minutes: int, closed: str = "right", origin: str | None = None) -> Column:
    """The label of the bar that ts falls in: (t - N, t] labelled t, or [t, t + N) labelled t.

    origin: where the grid is anchored; the epoch by default, which is midnight for N that divide a day.
    """
    step = minutes * 60_000_000
    shift = F.unix_micros(F.to_timestamp(F.lit(origin))) if origin else F.lit(0)
    us = F.unix_micros(ts.cast("timestamp")) - shift
    if closed == "right":
        us = us + (step - 1)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)) + shift).cast("timestamp_ntz")


def resample(rows: DataFrame, minutes: int, closed: str = "right", origin: str | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """N-minute bars; first and last skip NULL and NaN, empty bars do not exist.

    One pre-aggregated shuffle.  tie: columns that order rows of equal ts.  Session time zone must be UTC.
    """
    v = {f: F.when(~F.isnan(f), F.col(f)) for f in FIELDS}
    key = F.struct("ts", *tie) if tie else F.col("ts")

    def at(pick, f: str) -> Column:
        return pick(v[f], F.when(v[f].isNotNull(), key))

    out = rows.groupBy("symbol", label(F.col("ts"), minutes, closed, origin).alias("bar")).agg(
        at(F.min_by, "open").alias("open"), F.max(v["high"]).alias("high"), F.min(v["low"]).alias("low"),
        at(F.max_by, "close").alias("close"), F.sum(v["volume"]).alias("volume"),
    )
    return out.select("symbol", F.col("bar").alias("ts"), *FIELDS)


def bars(rows: DataFrame, minutes: int, **options) -> DataFrame:
    """Resampled bars, or the rows themselves if bars are of a day or more."""
    return rows if minutes >= DAY_MINUTES else resample(rows, minutes, **options)


def lattice(rows: DataFrame, minutes: Iterable[int], closed: str = "right", origin: str | None = None, tie: tuple[str, ...] = ()) -> dict[int, DataFrame]:
    """Bars of several sizes from one scan: the finest grid is made and stored, coarser ones are made of its bars.

    The finest grid is the greatest common divisor of the sizes, so every coarser bar is a run of whole finest ones and its
    open and close are those of its first and last bar that have one.  Sizes of a day or more are the rows themselves.
    """
    sizes = sorted(set(minutes))
    out = {m: rows for m in sizes if m >= DAY_MINUTES}
    within = [m for m in sizes if m < DAY_MINUTES]
    if within:
        finest = gcd(*within)
        base = stash(resample(rows, finest, closed, origin, tie), "bars")
        out |= {m: base if m == finest else resample(base, m, closed, origin) for m in within}
    return out


def trades(df: DataFrame, symbol: str | Column, ts: str | Column, price: str | Column, volume: str | Column, *keep: str) -> DataFrame:
    """Any table of events as one-point bars."""
    s, t, p, v = (F.col(x) if isinstance(x, str) else x for x in (symbol, ts, price, volume))
    p = finite(p.cast("double"))
    return df.select(s.cast("string").alias("symbol"), t.cast("timestamp_ntz").alias("ts"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), v.cast("double").alias("volume"), *keep)
