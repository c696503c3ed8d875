"""Quality by importance resampling (Xie et al., 2023).

Two bag-of-n-grams models over hashed words and word pairs are estimated: one
of the target texts (documents labelled as good), one of all raw text.  A
document's weight is the log ratio of its probabilities under them; adding
Gumbel noise and taking the top k samples k documents without replacement in
proportion to their weights.  Noise is a function of id and seed.

The counts cover every target document and every document; each task adds them up in one array of
``BUCKETS`` counters.  Top-k needs neither a sort nor a gather: the k-th key is
found by histograms over ever narrower ranges, with ties broken by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, broadcast_if_small, cut
from quillon.llm.features import ngrams

BUCKET_BITS, SHARE = 14, 0.25
_BINS = 1024


def bucket_counts(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts by bucket of the target documents and of all documents, each of them counted."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    aims = cut(target_ids.select(F.col(id_col).cast("long").alias("t")).where("t is not null").distinct())
    # rows without an id match nothing and stay out of the join, which may be a shuffle
    marked = rows.where("id is not null").join(broadcast_if_small(aims), F.col("id") == F.col("t"), "left").select("text", "t")
    marked = marked.union(rows.where("id is null").select("text", F.lit(None).cast("long").alias("t")))
    n = 1 << BUCKET_BITS

    def run(batches):
        total = np.zeros((2, n), np.int64)
        for batch in batches:
            aim = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in K.chunks(batch.column(0)):
                f, d = ngrams(data, offs, bits=BUCKET_BITS)
                total[1] += np.bincount(f, minlength=n)
                total[0] += np.bincount(f[aim[lo:hi][d]], minlength=n)
        if total[1].any():
            some = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["f", "target", "raw"])

    got = marked.select("text", F.col("t").isNotNull().alias("aim")).mapInArrow(run, "f long, target long, raw long").groupBy("f").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    out = np.zeros((2, n))
    out[0, got["f"]], out[1, got["f"]] = got["target"], got["raw"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    return np.log((target + alpha) / (target.sum() + alpha * len(target))) - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))


def importance(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams, log_weight of every row; a null or wordless text has weight 0."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in K.chunks(batch.column(1)):
            f, d = ngrams(data, offs, bits=BUCKET_BITS)
            n = np.bincount(d, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(np.bincount(d, weights=sent.value[f], minlength=hi - lo))], ["id", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, n_grams long, log_weight double")


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise, a function of id and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k_bound(rows: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value of a column without nulls and NaNs, exactly; None if there are no more than k rows."""
    lo, hi, n = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if n <= k:
        return None
    above = 0
    while lo < hi:
        width = (hi - lo) / _BINS
        if lo + width <= lo or hi - width >= hi:
            break
        inside = rows.where((F.col(col) >= lo) & (F.col(col) <= hi))
        at = F.least(F.floor((F.col(col) - lo) / width), F.lit(_BINS - 1)).cast("int").alias("b")
        bins = {r.b: r for r in inside.groupBy(at).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b].n >= k:
                lo, hi = bins[b].lo, bins[b].hi
                break
            above += bins[b].n
    return hi if lo == hi else rows.where((F.col(col) >= lo) & (F.col(col) <= hi)).orderBy(F.desc(col)).select(col).limit(k - above).agg(F.min(col)).first()[0]


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, share: float = SHARE, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams, log_weight, gumbel_key, selected of every row; k rows (or ``share`` of all) are selected.

    Defined cases: null and wordless texts have weight 0 and are ranked like others; rows with a null id are never
    selected and have no key; among equal keys smaller ids win, and rows that repeat an id share its noise; more
    rows than asked are selected only where id and key are equal.  An empty table gives an empty table.
    """
    ratio = log_ratio(*bucket_counts(docs, target_ids, id_col, text_col))
    rows = importance(docs, ratio, id_col, text_col).withColumn("gumbel_key", F.when(F.col("id").isNotNull(), F.col("log_weight") + gumbel("id", seed)))
    rows = cut(rows)
    keyed = rows.where("gumbel_key is not null")
    k = int(rows.count() * share) if k is None else k
    bound = top_k_bound(keyed, "gumbel_key", k) if k > 0 else float("inf")
    if bound is None:
        chosen = F.col("gumbel_key").isNotNull()
    elif k <= 0:
        chosen = F.lit(False)
    else:
        more = keyed.where(F.col("gumbel_key") > bound).count()
        tied = keyed.where(F.col("gumbel_key") == bound).orderBy("id").limit(k - more).agg(F.max("id")).first()[0]
        chosen = (F.col("gumbel_key") > bound) | ((F.col("gumbel_key") == bound) & (F.col("id") <= tied))
    return rows.withColumn("selected", F.coalesce(chosen, F.lit(False))).withColumnRenamed("id", id_col)
