"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a numpy logistic model on the presence of hashed words and
word pairs.  It learns from confirmed toxic texts and unlabelled texts, with
the non-negative risk of Kiryo et al. (2017):

    R = prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

so unlabelled texts count as negative less the share of positives among them,
and a negative part that falls below zero is pushed back up rather than fitted.

Everything covers all rows: feature counts, and both means of the risk.  The
counts are aggregated on the executors in tables of ``2^BITS`` rows at most, first
of the confirmed texts, then of all texts for the features that can still pass.
Features are those that confirmed texts have more often than all texts, with a
likelihood ratio above what the best of as many useless features would reach.
Every document is then kept as the numbers of its features, in blocks in the
shared folder, and each of the ``STEPS`` gradient steps is one pass over these
blocks that adds up one row a feature.  Scoring is a scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, broadcast_if_small, cut, small_batches, stash
from quillon.llm.features import distinct, ngrams

BITS, STEPS, RATE, L2 = 20, 60, 0.3, 1e-5
#: Bytes of blocks that a task of a gradient step reads, about.
_TASK_BYTES = 32 << 20


@dataclass
class ToxicModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slopes(ends: np.ndarray, cols: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positives, all documents): sums of the sigmoid by feature, of the sigmoid, and of log(1 + e^g), of one block.

    ends: number of entries of cols up to and including each document; weights: of the features and the bias.
    """
    k = len(weights) - 1
    sums = np.concatenate(([0.0], np.cumsum(weights[cols])))
    g = np.diff(sums[np.concatenate(([0], ends))]) + weights[-1]
    s, loss = sigmoid(g), np.logaddexp(0, g)
    n = np.diff(ends, prepend=0)
    out = np.zeros((2, k + 2))
    for i, own in enumerate((s * positive, s)):
        out[i, :k] = np.bincount(cols, np.repeat(own, n), k)
        out[i, k] = own.sum()
    out[0, k + 1], out[1, k + 1] = loss[positive].sum(), loss.sum()
    return out[0], out[1]


def fit_nnpu(risk, present: np.ndarray, n_p: int, n_u: int, prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias.  risk(weights): the sums of ``slopes`` over all documents; present: positives that have each feature."""
    w = np.zeros(len(present) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ones = np.append(present, n_p) / n_p
    for step in range(1, steps + 1):
        p, u = risk(w)
        p, u = p / n_p, u / n_u
        negative = u[-1] - prior * p[-1]
        down = u[:-1] - prior * p[:-1]
        grad = prior * (p[:-1] - ones) + down if negative >= 0 else -down
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _likelihood_ratio(n_p: int, n_u: int) -> Column:
    """2 log likelihood ratio of presence in positives (p of n_p) against unlabelled (u of n_u)."""

    def part(k: Column, n: int, q: Column) -> Column:
        q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), q))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    p, u = F.col("p").cast("double"), F.col("u").cast("double")
    both = (p + u) / (n_p + n_u)
    return 2 * (part(p, n_p, p / n_p) + part(u, n_u, u / n_u) - part(p, n_p, both) - part(u, n_u, both))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, min_ratio: float | None = None, steps: int = STEPS) -> ToxicModel:
    """Learn from rows of labels that are 1 and from all texts of docs.  Null ids, labels and texts teach nothing.

    prior: share of toxic documents; by default that of the given labels, which must then be a fair sample of docs.
    min_ratio: least likelihood ratio of a feature; by default 2 ln(features that positives have); 0 takes all that
    speak for toxicity.  Without a positive row the model gives every text the prior, or 0.01.  Rows that repeat an id
    count each; a document is positive if any of its labels is 1.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    n_pos, n_all = marks.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    prior = min(0.9, max(1e-3, prior if prior is not None else n_pos / n_all if n_all else 0.01))
    nothing = ToxicModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    if not n_pos:
        return nothing
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    toxic = cut(marks.where("y = 1").select("id").distinct().withColumn("y", F.lit(1)))
    marked = rows.join(broadcast_if_small(toxic), "id", "left").select("text", F.col("y").isNotNull().alias("y"))
    confirmed = rows.join(broadcast_if_small(toxic), "id").select("text")
    small_batches(spark)

    def counted(texts: DataFrame, index: np.ndarray | None = None) -> DataFrame:
        """(f, n): texts that have each feature, those of index >= 0 if given; n of f = -1 is all texts."""
        of = None if index is None else spark.sparkContext.broadcast(index)

        def count(batches):
            total, n = np.zeros(1 << BITS, np.int64), 0
            for batch in batches:
                for lo, hi, data, offs in K.chunks(batch.column(0)):
                    f, d = ngrams(data, offs, bits=BITS)
                    if of is not None:
                        some = of.value[f] >= 0
                        f, d = f[some], d[some]
                    np.add.at(total, distinct(f, d, bits=BITS)[0], 1)
                    n += hi - lo
            if n:
                some = np.flatnonzero(total)
                # pieces, as a task may hold every feature
                for at in np.array_split(some, len(some) // 200_000 + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["f", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64())], ["f", "n"])

        return texts.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))

    own = cut(counted(confirmed))
    n_p = own.where("f = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n_p:
        return nothing
    n_u, kinds = rows.count(), own.count() - 1
    least = 2 * float(np.log(max(1, kinds))) if min_ratio is None else min_ratio
    # a feature's ratio is at most what it is if no other text has it; only those that can pass are counted over all texts
    able = own.where("f >= 0").select("f", F.col("n").alias("p"), F.col("n").alias("u"))
    able = able.where(_likelihood_ratio(n_p, n_u) > least).select("f", "p").toPandas()  # 2^BITS rows at most
    index = np.full(1 << BITS, -1, np.int32)
    index[able["f"]] = 1
    got = counted(rows.select("text"), index).where("f >= 0").select("f", F.col("n").alias("u")).join(own.select("f", F.col("n").alias("p")), "f")
    got = got.where(F.col("p") * n_u > F.col("u") * n_p).where(_likelihood_ratio(n_p, n_u) > least).select("f", "p").toPandas().sort_values("f")
    features, present = got["f"].to_numpy(np.int64), got["p"].to_numpy(np.float64)
    where = np.full(1 << BITS, -1, np.int32)
    where[features] = np.arange(len(features))
    sent = spark.sparkContext.broadcast(where)

    def pick(batch: pa.RecordBatch):
        for lo, hi, data, offs in K.chunks(batch.column(0)):
            f, d = ngrams(data, offs, bits=BITS)
            col = sent.value[f].astype(np.int64)
            col, d = distinct(col[col >= 0], d[col >= 0], bits=BITS)
            ends = np.searchsorted(d, np.arange(1, hi - lo + 1)).astype(np.int32)
            yes = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ends, col.astype(np.int32), yes)], ["ends", "cols", "y"])

    blocks = stash(arrow_map(marked, pick, "ends binary, cols binary, y binary"), "toxic-features")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("cols") + F.octet_length("ends")), F.lit(0))).first()[0]
    blocks = blocks.coalesce(max(1, -(-size // _TASK_BYTES)))

    def risk(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros((2, len(weights) + 1))
            for batch in batches:
                for ends, cols, y in zip(*batch.columns, strict=True):
                    raw = [np.frombuffer(x.as_buffer(), t) for x, t in ((ends, np.int32), (cols, np.int32), (y, bool))]
                    total += slopes(*raw, weights)
            at = np.arange(total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0]), pa.array(total[1])], ["i", "p", "u"])

        # a row a feature
        sums = blocks.mapInArrow(run, "i long, p double, u double").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
        out = np.zeros((2, len(weights) + 1))
        out[0, sums["i"]], out[1, sums["i"]] = sums["p"], sums["u"]
        return out[0], out[1]

    weights, bias = fit_nnpu(risk, present, n_p, n_u, prior, steps)
    return ToxicModel(features, weights, bias, prior)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row, from the whole text.

    Defined cases: a null or empty text has no features and gets the score of the bias; repeated rows are each
    answered; null ids are kept; an empty table gives an empty table; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.table(), model.bias))

    def run(batch: pa.RecordBatch):
        table, bias = sent.value
        for lo, hi, data, offs in K.chunks(batch.column(1)):
            f, d = ngrams(data, offs, bits=BITS)
            some = table[f] != 0
            f, d = distinct(f[some], d[some], bits=BITS)
            z = np.bincount(d, weights=table[f], minlength=hi - lo) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sigmoid(z))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, score double").withColumnRenamed("id", id_col)
