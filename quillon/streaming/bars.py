"""Incremental bars from a stream of trades: append mode, one row per closed bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.bars import FIELDS


def stream_bars(rows: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """(symbol, ts, open .. volume) of a streaming bar table; on complete data equal to right-closed batch resampling.

    Rows are moved by a microsecond so that Spark's left-closed window becomes (t - N, t]; the label is its end.
    """
    moved = rows.withColumn("_t", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 1))
    key = F.col("ts")
    out = moved.withWatermark("_t", delay).groupBy(F.window("_t", f"{minutes} minutes"), "symbol").agg(
        F.min_by("open", key).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", key).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select("symbol", F.col("window.end").cast("timestamp_ntz").alias("ts"), *FIELDS)
