"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a log-structured store in the shared folder.  A run is a table
(h1, h2, owner, n_docs) bucketed and sorted by the 128-bit key of a line, a
file a bucket, so that Spark merges runs as they lie: no run is shuffled or
sorted again.  A new batch of documents is aggregated to one row per key, merge
anti-joined with the runs (keys that no run holds get an owner, the largest
document of the batch; the others only add to the count) and written as a run of level 0.
Whenever a level holds ``fanout`` runs they are compacted to one run of
the next level by full outer merge joins.  Since a key's total is the sum and its owner the maximum over
runs, the result does not depend on how the documents were batched.

A key that a third of all documents hold costs one row per task before the
shuffle, and the join that finds its lines is a plain equi-join that the
adaptive skew join can split.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, cut, scratch

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
_NEWLINE = 10


def split_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first line + total); an empty document has one empty line."""
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.concatenate((breaks + 1, offs[:-1]))
    order = np.argsort(starts, kind="stable")
    # a document that starts right after another's final newline has two lines starting there: order by document
    doc = np.concatenate((np.searchsorted(offs, breaks, side="right") - 1, np.arange(len(offs) - 1)))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(offs)))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = offs[1:]
    return starts, ends, first


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(long enough, h1, h2) of each line's key: stripped of ASCII white space, A-Z lower-cased."""
    if len(data) == 0:
        return np.zeros(len(starts), bool), np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    solid = np.flatnonzero(K.SPACE_WORDS[data])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    s, e = starts.copy(), starts.copy()
    s[some], e[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    points = K.code_points(data)
    long_ = points[e] - points[s] >= min_chars
    low = K.LOWER[data]
    h1 = K.span_hash(K.prefix_hash(low), s, e)
    h2 = K.span_hash(K.prefix_hash(low ^ 0xA5), s, e)
    return long_, h1, h2


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h1, h2): the distinct long keys of each row."""

    def run(batch: pa.RecordBatch):
        ids = batch.column(0)
        for lo, hi, data, offs in K.chunks(batch.column(1)):
            starts, ends, first = split_lines(data, offs)
            long_, h1, h2 = line_keys(data, starts, ends, min_chars)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            doc, h1, h2 = doc[long_], h1[long_], h2[long_]
            order = np.lexsort((h2, h1, doc))
            doc, h1, h2 = doc[order], h1[order], h2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + doc[new])), pa.array(K.to_signed(h1[new])), pa.array(K.to_signed(h2[new]))], ["id", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return arrow_map(rows, run, "id long, h1 long, h2 long")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark relies on the order within the single file of a bucket; the session's setting is put back."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The levelled store.  Runs are replaced only after their successor is written."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.made: set[str] = set()

    def _write(self, rows: DataFrame, dealt: bool = False) -> str:
        """rows as a run; dealt: they already come bucket by bucket, from a merge of runs."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.select("h1", "h2", "owner", "n_docs")
        self.made.add(name)
        with _sorted_scans(self.spark):
            (
                (rows if dealt else rows.repartition(self.buckets, "h1", "h2")).write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
                .option("path", f"{self.path}/{name}").saveAsTable(name)
            )
        return name

    def _drop(self, name: str) -> None:
        location = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.spark.sql(f"drop table if exists {name}")
        location.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(location, True)
        self.made.discard(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).hint("merge")

    def merged(self, one: str, two: str) -> DataFrame:
        """Both runs as one, bucket by bucket in the order of their keys."""
        a, b = (self._run(x).select("h1", "h2", F.col("owner").alias(f"o{i}"), F.col("n_docs").alias(f"n{i}")) for i, x in ((1, one), (2, two)))
        n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", F.greatest("o1", "o2").alias("owner"), n.alias("n_docs"))

    def _compact(self, names: list[str]) -> str:
        out = names[0]
        for name in names[1:]:
            new = self._write(self.merged(out, name), dealt=True)
            self._drop(out)
            self._drop(name)
            out = new
        return out

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (a row a key) whose key no run holds."""
        for name in self.runs():
            batch = batch.join(self._run(name).where("owner is not null").select("h1", "h2"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """One batch of (id, h1, h2), a row for each document and key; documents of a batch are in no other."""
        batch = lines.groupBy("h1", "h2").agg(F.max("id").alias("top"), F.count("*").alias("n_docs"))
        owned = batch.withColumn("owner", F.col("top"))
        if self.runs():
            owned = batch.join(self.unseen(batch).select("h1", "h2", F.col("top").alias("owner")).hint("merge"), ["h1", "h2"], "left")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(owned))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        """Drops all runs, also those that a failure left; what was read from them must be materialised before."""
        for name in sorted(self.made):
            self._drop(name)
        self.levels = []

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of keys that at least min_docs documents hold; the runs are compacted to one for it."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        one = self._compact(names)
        self.levels = [[] for _ in self.levels[1:]] + [[one]]
        return self.spark.table(one).where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, keep_text: bool = True, measures: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_sha256")) -> DataFrame:
    """All columns of docs, with n_lines, n_dropped, kept_sha256 and, if keep_text, the shortened text; without it, the id and these.

    measures: other names for the three.  An input column with a name of them, in any case, is left out.

    Documents reach the store in ``batches`` parts, largest ids first.  A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents loses all its lines
    except in the largest id that holds it.

    Defined cases: a null or empty text is one empty line (a null text stays null if nothing is
    dropped); a null id keeps all lines and counts for no key; rows that repeat an id are one document
    and are treated alike; a text of which all lines go becomes empty.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, fanout)
    lines = cut(keyed_lines(docs, id_col, text_col, min_chars).distinct())
    cuts = lines.stat.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(x) for x in cuts or []}), None]
    try:
        for lo, hi in reversed(list(zip(bounds[:-1], bounds[1:], strict=True))):
            part = lines
            part = part.where(F.col("id") > lo) if lo is not None else part
            part = part.where(F.col("id") <= hi) if hi is not None else part
            store.add(part)
        gone = lines.join(store.repeated(min_docs), ["h1", "h2"]).where("id <> owner")
        gone = cut(gone.groupBy("id").agg(F.collect_list("h1").alias("g1"), F.collect_list("h2").alias("g2")))
    finally:
        store.close()
    new = {m.lower() for m in measures}
    own = [c for c in docs.columns if c.lower() != text_col.lower() and c.lower() not in new]
    names = {c: f"_c{i}" for i, c in enumerate(own)}
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    if not keep_text:
        rows = rows.select("_id", "_text")
    joined = rows.join(gone, F.col("_id") == F.col("id"), "left").drop("id")
    extra = [f for f in rows.schema.fields if f.name not in ("_id", "_text")]

    def run(batch: pa.RecordBatch):
        at = {n: i for i, n in enumerate(batch.schema.names)}
        ids, g1, g2 = batch.column(at["_id"]), batch.column(at["g1"]), batch.column(at["g2"])
        has = np.asarray(g1.is_valid())
        f1, f2 = g1.flatten().to_numpy(zero_copy_only=False).view(np.uint64), g2.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.where(has, np.nan_to_num(np.asarray(pa.compute.list_value_length(g1).fill_null(0))), 0).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(size)))
        texts = batch.column(at["_text"])
        for lo, hi, data, offs in K.chunks(texts):
            starts, ends, first = split_lines(data, offs)
            long_, h1, h2 = line_keys(data, starts, ends, min_chars) if has[lo:hi].any() else (None, None, None)
            raw = data.tobytes()
            n_lines, dropped, shas, kept = np.diff(first), np.zeros(hi - lo, np.int64), [], []
            for i in range(hi - lo):
                text = raw[offs[i] : offs[i + 1]]
                if has[lo + i]:
                    bad = set(zip(f1[begin[lo + i] : begin[lo + i + 1]].tolist(), f2[begin[lo + i] : begin[lo + i + 1]].tolist(), strict=True))
                    a, b = first[i], first[i + 1]
                    out = [not (w and (x, y) in bad) for w, x, y in zip(long_[a:b].tolist(), h1[a:b].tolist(), h2[a:b].tolist(), strict=True)]
                    dropped[i] = len(out) - sum(out)
                    text = b"\n".join(raw[s:e] for ok, s, e in zip(out, starts[a:b].tolist(), ends[a:b].tolist(), strict=True) if ok)
                shas.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(None if texts[lo + i].as_py() is None and not dropped[i] else text)
            cols = [ids.slice(lo, hi - lo), pa.array(n_lines, pa.int64()), pa.array(dropped), pa.array(shas, pa.string())]
            cols += [batch.column(at[f.name]).slice(lo, hi - lo) for f in extra]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "n_lines", "n_dropped", "kept_sha256", *[f.name for f in extra], *["_text"] * keep_text])

    schema = "_id long, n_lines long, n_dropped long, kept_sha256 string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra) + ", _text string" * keep_text
    done = arrow_map(joined, run, schema)
    found = [F.col(c).alias(m) for c, m in zip(("n_lines", "n_dropped", "kept_sha256"), measures, strict=True)]
    if not keep_text:
        return done.select(F.col("_id").alias(id_col), *found)
    back = [F.col("_text").alias(c) if c.lower() == text_col.lower() else F.col(names[c]).alias(c) for c in docs.columns if c in names or c.lower() == text_col.lower()]
    return done.select(*back, *found)
