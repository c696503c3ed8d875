"""A table that any number of writers add to: immutable parts and a ledger of commits.

A writer puts its rows into a folder of its own and then renames one small file into the ledger; the rename is
atomic, names never collide, so writers need no lock, lose nothing and never see half of a part.  A compaction
is a commit whose part replaces others.  If two compactions overlap, the one with the earlier name holds and the other's part
is ignored: every reader decides that alike from the ledger alone.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Rows of a schema under a path that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, str(path).rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit(self, part: str, replaces: list[str]) -> None:
        commits = f"{self.path}/commits"
        self._fs.mkdirs(self._path(commits))
        draft = self._path(f"{commits}/.{part}")
        out = self._fs.create(draft)
        out.write(json.dumps({"part": part, "replaces": replaces}).encode())
        out.close()
        if not self._fs.rename(draft, self._path(f"{commits}/{part}.json")):
            raise OSError(f"cannot commit {part} to {commits}")

    def add(self, rows: DataFrame, replaces: list[str] | None = None) -> str:
        """Commits rows as a part and returns its name; names ascend with the writers' clocks."""
        part = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names).write.parquet(f"{self.path}/parts/{part}")
        self._commit(part, replaces or [])
        return part

    def live(self) -> list[str]:
        """Names of the parts that count, in order; a commit a part, so compact now and then."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        found = self.spark.read.schema("part string, replaces array<string>").json(f"{self.path}/commits").orderBy("part").collect()
        live, gone = {r.part for r in found}, set()
        for r in found:
            if r.replaces:
                if gone & set(r.replaces) or not set(r.replaces) <= live:
                    live.discard(r.part)
                else:
                    gone |= set(r.replaces)
        return sorted(live - gone)

    def read(self, part: str | None = None) -> DataFrame:
        """All rows; part: a column for the name of each row's part."""
        parts = self.live()
        empty = self.spark.createDataFrame([], self.schema)
        if not parts:
            return empty if part is None else empty.withColumn(part, F.lit(None).cast("string"))
        rows = self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])
        if part is None:
            return rows
        names = rows.columns
        return rows.withColumn(part, F.regexp_extract("_metadata.file_path", "/parts/([^/]+)/", 1)).select(*names, part)

    def compact(self) -> str | None:
        """One part in place of all that are live; None if there is at most one.  Writers may go on meanwhile."""
        parts = self.live()
        if len(parts) < 2:
            return None
        schema = self.spark.createDataFrame([], self.schema).schema
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}" for p in parts])
        return self.add(rows, parts)

    def sweep(self) -> int:
        """Deletes the parts that no reader can see any more and that were committed; returns their number.  Run it when no reader holds an old list."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return 0
        committed = {r.part for r in self.spark.read.schema("part string").json(f"{self.path}/commits").collect()}
        old = [p for p in sorted(committed - set(self.live())) if self._fs.exists(self._path(f"{self.path}/parts/{p}"))]
        for p in old:
            self._fs.delete(self._path(f"{self.path}/parts/{p}"), True)
        return len(old)


def counted(ledger: Ledger, key: str = "hash") -> DataFrame:
    """(key, count) of a ledger of (key, count) increments: a sum, so that no writer has to know of the others."""
    return ledger.read().where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("count").alias("count"))


def count_batch(ledger: Ledger, batch: DataFrame, key: str = "hash") -> str:
    """Adds one for each occurrence of a non-empty key."""
    return ledger.add(batch.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("count")))


def first_of(ledger: Ledger, key: str) -> DataFrame:
    """One row for each key, of the earliest part that has it: writers may add the same key at once and it still counts once."""
    rows = ledger.read("_part")
    names = [c for c in rows.columns if c != "_part"]
    best = F.min(F.struct("_part", F.struct(*names).alias("row"))).alias("b")
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(best).select("b.row.*")
