"""Running sums and ranks over a whole table without a task that holds all of it.

A table is dealt out by ranges of its order and stored; each range adds itself up, the sums of the ranges
before it (a row a range) are its offset, and running sums within a range start from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.scratch import stash


def running_sum(df: DataFrame, value: str, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before a row, in an order without ties.

    parts: ranges; a range is one group of a task, so it has to hold about rows / parts rows.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, total = [], None
    for r in dealt.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect():  # a row a range
        starts.append((r["_range"], total))
        total = r.s if total is None else total + (r.s or 0)
    kind = dict(df.select(F.sum(value).alias("s")).dtypes)["s"]
    offsets = spark.createDataFrame(starts, f"_range int, _start {kind}")
    before = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn(name, before).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_start", F.lit(0))).select(*df.columns, name)


def average_ranks(df: DataFrame, columns: dict[str, str], where: Column | None = None) -> DataFrame:
    """df with the average rank of each column (out -> column) among all rows, ties sharing theirs; NULL has none.

    Equal values are counted first, so a value that very many rows share is one row of what is ranked.  where: rows that take
    part; the others have NULL.
    """
    out = df
    for name, col in columns.items():
        v = F.col(col) if where is None else F.when(where, F.col(col))
        counted = df.select(v.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
        ranks = running_sum(counted, "_n", [F.asc("_v")], "_before").select(F.col("_v").alias("_k"), (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
        # NULLs are of no use to the join and would all meet in one task
        held = out.withColumn("_v", v)
        some = held.where("_v is not null").join(ranks, F.col("_v") == F.col("_k")).drop("_v", "_k")
        out = some.unionByName(held.where("_v is null").drop("_v").withColumn(name, F.lit(None).cast("double")))
    return out
