"""Shared Spark helpers: the shared scratch folder, checkpoints and fold hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    local session gets one below /tmp; on a cluster that is an error, since a
    folder of one machine is not shared.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file:///tmp/quillon-shared-{os.getpid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors.

    parts: into that many files at most, for tables whose size is known.
    """
    shared_dir(df.sparkSession)
    return (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int, per_part: int = 50_000) -> int:
    """Partitions for a narrow table of so many rows: small control tables are not spread over many files."""
    return max(1, min(-(-rows // per_part), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a compact cut of the lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of a few numbers a row are broadcast up to so many rows (a few MB), after a count; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a materialised narrow table, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def fold(col: str | Column, buckets: int) -> Column:
    """crc32 of the decimal text of a column, modulo ``buckets``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(buckets))


#: Bytes of an Arrow batch between the JVM and Python; Spark's own default is 64 MB, doubled for every running task.
ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow exchanges of this session, unless it already is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "64m").lower().rstrip("b").replace("k", "000").replace("m", "000000").replace("g", "000000000")) > ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def free_name(name: str, *taken: DataFrame) -> str:
    """name, with underscores added until no column of the tables is called that in any case."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs, with their columns, whose id is not among ids (its only column); rows with a null id stay."""
    name = free_name("gone", docs)
    return docs.join(ids.toDF(name).distinct(), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
