"""Importance resampling towards a target distribution, in whole numbers.

Two bag-of-features models over hashed word runs are counted, one of all raw
documents, one of the target texts.  A bucket's gain is the log ratio of its
probabilities in thousandths, rounded down, kept in one array; a document's
weight is the sum of the gains of its features, and a Gumbel noise that is a
function of its id is added in the same unit.  All scores are thus integers.

The draw needs neither a global sort of the documents nor a gather.  The
eligible documents are counted by score; the histogram is dealt out by ranges of
scores, the sums of the ranges before give every score the exact number of
documents above it (a suffix sum), and scores at which it reaches k are out.
Within each score that is left, row_number by id gives the ranks.  A score that very many documents share
is cut into blocks of ids first, which are ranges of the histogram of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, small_batches, stash

BUCKETS, RUNS, SEED, PERCENT, MIN_WORDS = 10_000, 1, 2024, 10, 20
#: Rows of one score that one task may rank; a score with more is cut into blocks of ids.
PER_BLOCK = 1_000_000
#: Bytes of text whose features are held at a time, and what a cache of buckets may hold: words, and bytes of a word.
_PIECE, _CACHED, _LONGEST = 1 << 20, 200_000, 64

_WORDS = bytes(int(K.LOWER[b]) if K.ALNUM_WORDS[K.LOWER[b]] else 0x20 for b in range(256))


class _Buckets(dict):
    """Feature -> bucket, remembered for short features as long as there is room."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        out = crc32(feature) % self.buckets
        if len(feature) <= _LONGEST and len(self) < _CACHED:
            self[feature] = out
        return out


def _features(raw: bytes, runs: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of a text, about _PIECE bytes of it at a time; runs of words go across pieces."""
    low, at, before = raw.translate(_WORDS), 0, []
    while at < len(low):
        end = low.find(b" ", at + _PIECE)
        end = len(low) if end < 0 else end
        words = low[at:end].split()
        at, out = end, words
        if runs > 1:
            both, out = before + words, list(words)
            for n in range(2, runs + 1):
                some = both[max(0, len(before) - n + 1) :]
                out += [b" ".join(some[i : i + n]) for i in range(len(some) - n + 1)]
            before = both[-(runs - 1) :]
        yield len(words), out


def _hashed(column: pa.Array, runs: int, known: _Buckets) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words, buckets of the features) for every piece of every text."""
    data, offs, _ = K.string_buffers(column)
    raw = data.tobytes()
    for i in range(len(offs) - 1):
        for n, features in _features(raw[offs[i] : offs[i + 1]], runs):
            yield i, n, np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Features by bucket over every text; each task adds its own up, so ``buckets`` rows a task are shuffled."""
    small_batches(texts.sparkSession)

    def run(batches):
        total, known = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for _, _, at in _hashed(batch.column(0), runs, known):
                total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed probabilities) of every bucket."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: gains looked up in their array."""

    def run(batch: pa.RecordBatch):
        out, known = np.zeros((3, batch.num_rows), np.int64), _Buckets(len(gain))
        for i, n, at in _hashed(batch.column(1), runs, known):
            out[:, i] += n, len(at), gain[at].sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return arrow_map(rows, run, "id long, n_words long, n_features long, weight long")


def draw(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, score and others) with ``rank``: 1 to k by descending score, then id; null for all others.  Null scores are not ranked."""
    spark = rows.sparkSession
    pool = rows.where("score is not null")
    most, low, high = pool.groupBy("score").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if k <= 0 or most is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    blocks = -(-most // PER_BLOCK)
    width = (high - low) // blocks + 1
    pool = pool.withColumn("block", F.floor((F.col("id") - low) / F.lit(width)).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.asc("block"))
    counted = pool.groupBy("score", "block").agg(F.count("*").alias("n")).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    counted = stash(counted, "histogram")
    sums, before = [], 0
    for r in counted.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        sums.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame([s for s in sums if s[1] < k], "p int, start long")
    earlier = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    left = counted.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn("above", F.col("start") + F.coalesce(earlier, F.lit(0))).where(F.col("above") < k)
    left = stash(left.select(F.col("score").alias("s"), F.col("block").alias("b"), "above"), "offsets")
    cutoff = left.agg(F.min("s")).first()[0]
    in_score = F.row_number().over(W.partitionBy("score", "block").orderBy("id", *[c for c in rows.columns if c not in ("id", "score")]))
    ranked = pool.where(F.col("score") >= cutoff).join(left, (F.col("score") == F.col("s")) & (F.col("block") == F.col("b")), "left").withColumn("rank", F.col("above") + in_score)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).select(*rows.columns, "rank")
    rest = rows.where(F.col("score").isNull() | (F.col("score") < cutoff)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.union(rest)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """A row for each row of docs: id, n_features, weight, score, rank.

    Features are all runs of 1 to ``runs`` words (digits, letters and non-ASCII, A-Z lower-cased), repeats counted.  Of the N rows
    with at least ``min_words`` words, floor(percent * N / 100) are drawn; they have a rank.

    Defined cases: a null, empty or wordless text has no features and weight 0; a row with a null id counts in the
    model, but has no noise, score or rank and is not one of the N; rows that repeat an id have the same noise and are ranked each, among equals by
    words, features and weight; an empty target, like an empty table, leaves only the smoothing; no rows give no rows.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, runs), bucket_counts(target, "text", buckets, runs))
    rows = weights(docs, gain, id_col, text_col, runs)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = stash(rows.withColumn("score", F.col("weight") + noise), "scored")
    able = (F.col("n_words") >= min_words) & F.col("id").isNotNull()
    k = percent * rows.where(able).count() // 100
    drawn = draw(rows.where(able), k).union(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
