"""Document fingerprints from closed syncmers.

A window of ``K_BYTES`` bytes is an anchor if the smallest hash among its inner
substrings of ``S_BYTES`` bytes is that of the first or the last one.  Whether a
window is an anchor depends on its own bytes only, so an edit moves no anchor
outside the windows it touches.  A fingerprint holds all anchors with all their
positions; equal texts have equal fingerprints, and its size is about two bytes
for a byte of text.

Likeness matches anchors by hash *and* position: for the best shift (within a
tolerance) it counts the anchors of each text that have a partner of the same
hash there, of each hash as many as in the text with fewer.  Twice their number
over the anchors of both is the share in common (Dice).  It is exact: hashes
with few repeats are matched pair by pair, others by two correlations.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import small_batches

K_BYTES, S_BYTES, TOLERANCE = 16, 5, 64
#: Bytes of text that a part of the layout holds at most, about; cells that parts are made of.
PART_BYTES, _CELLS = 128 << 20, 4096
#: Pairs of repeated anchors that are matched at a time; bytes of fingerprints in an Arrow batch.
_PAIRS, _OUT_BYTES = 1 << 17, 4 << 20


def anchors(data: np.ndarray, k: int = K_BYTES, s: int = S_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all anchors of a text, by hash, then position; a text without any is one anchor itself."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = K.prefix_hash(data)
    h = at = np.zeros(0, np.int64)
    if n >= k:
        inner = K.span_hash(prefix, np.arange(n - s + 1), np.arange(s, n + 1))
        w = k - s + 1
        low = inner[: n - k + 1].copy()
        for j in range(1, w):
            np.minimum(low, inner[j : j + n - k + 1], out=low)
        at = np.flatnonzero((inner[: n - k + 1] == low) | (inner[w - 1 :] == low))
    if len(at):
        h = K.span_hash(prefix, at, at + k)
    else:
        at = np.zeros(1, np.int64)
        h = K.span_hash(prefix, at, np.array([n]))
    order = np.argsort(h, kind="stable")
    return h[order], at[order]


def encode(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the hashes in the order of the text, then of the gaps between their positions.

    A gap is one byte: of ``K_BYTES - S_BYTES`` windows in a row at least one is an anchor.
    """
    order = np.argsort(print_[1])
    return base64.b64encode(print_[0][order].astype("<u8").tobytes() + np.diff(print_[1][order], prepend=0).astype(np.uint8).tobytes()).decode()


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    n = len(raw) // 9
    h, at = np.frombuffer(raw, "<u8", n).astype(np.uint64), np.cumsum(np.frombuffer(raw, np.uint8, n, 8 * n), dtype=np.int64)
    order = np.argsort(h, kind="stable")
    return h[order], at[order]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, the first place and the number of each."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], first, np.diff(np.append(first, len(h)))


def _steps_by_pairs(p: np.ndarray, q: np.ndarray, sa: np.ndarray, ca: np.ndarray, sb: np.ndarray, cb: np.ndarray, lo: int, size: int, tolerance: int) -> np.ndarray:
    """Changes, by shift, of the matched anchors of hashes that stand at p[sa:sa + ca] and q[sb:sb + cb]."""
    times = ca * cb
    g = np.repeat(np.arange(len(times)), times)
    k = np.arange(len(g)) - np.repeat(np.cumsum(times) - times, times)
    keys = []
    # an anchor has a partner in windows that start in [d - tolerance, d], for any of its shifts d; made disjoint
    i = sa[g] + k // cb[g]
    d = p[i] - q[sb[g] + k % cb[g]]  # falls within an anchor of the first text
    end = d.copy()
    same = i[1:] == i[:-1]
    end[1:][same] = np.minimum(d[1:], d[:-1] - tolerance - 1)[same]
    keys += [d - tolerance, end + 1]
    j = sb[g] + k // ca[g]
    d = p[sa[g] + k % ca[g]] - q[j]  # rises within an anchor of the second text
    start = d - tolerance
    same = j[1:] == j[:-1]
    start[1:][same] = np.maximum(start[1:], d[:-1] + 1)[same]
    keys += [start, d + 1]
    key = np.concatenate([g * (size + 1) + x - lo for x in keys])
    order = np.argsort(key)
    one = np.ones(len(g), np.int64)
    none = np.zeros(2 * len(g), np.int64)
    a, b = np.concatenate([one, -one, none]), np.concatenate([none, one, -one])
    m = np.minimum(np.cumsum(a[order]), np.cumsum(b[order]))
    return np.rint(np.bincount(key[order] % (size + 1), np.diff(m, prepend=0), size + 1)).astype(np.int64)


def _steps_by_correlation(p: np.ndarray, q: np.ndarray, last_p: int, last_q: int, size: int, tolerance: int) -> np.ndarray:
    """The same for one hash at the positions p and q."""
    n = 1 << int(size).bit_length()

    def reach(at: np.ndarray, length: int) -> np.ndarray:
        return (np.cumsum(np.bincount(at, minlength=length + 1) - np.bincount(at + tolerance + 1, minlength=length + 1)[: length + 1])[:length] > 0).astype(float)

    def matched(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.rint(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y[::-1], n), n)[:size]).astype(np.int64)

    of_p = matched(np.bincount(p, minlength=last_p + 1).astype(float), reach(q, last_q + tolerance + 1))
    # reach() of the mirrored positions, mirrored back, marks what lies before an anchor
    before = reach(last_p - p, last_p + tolerance + 1)[::-1]
    of_q = matched(before, np.bincount(q, minlength=last_q + 1).astype(float))
    return np.diff(np.minimum(of_p, of_q), prepend=0, append=0)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tolerance: int = TOLERANCE) -> float:
    """0 (nothing in common) to 1 (equal); two empty fingerprints are alike."""
    (ha, p), (hb, q) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    if np.array_equal(ha, hb) and np.array_equal(p, q):
        return 1.0
    (ua, sa, ca), (ub, sb, cb) = _groups(ha), _groups(hb)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    both = ub[at] == ua
    if not both.any():
        return 0.0
    sa, ca, sb, cb = sa[both], ca[both], sb[at[both]], cb[at[both]]
    last_p, last_q = int(p.max()), int(q.max())
    lo, size = -last_q - tolerance, last_p + last_q + tolerance + 1  # first start of a window, number of starts
    once = (ca == 1) & (cb == 1)
    d = p[sa[once]] - q[sb[once]] - lo
    steps = np.bincount(d - tolerance, minlength=size + 1) - np.bincount(d + 1, minlength=size + 1)
    times = ca * cb
    many = times > size
    for i in np.flatnonzero(many):
        steps += _steps_by_correlation(p[sa[i] : sa[i] + ca[i]], q[sb[i] : sb[i] + cb[i]], last_p, last_q, size, tolerance)
    few = np.flatnonzero(~once & ~many)
    if len(few):
        for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(times[few]) // _PAIRS)) + 1):
            steps += _steps_by_pairs(p, q, sa[some], ca[some], sb[some], cb[some], lo, size, tolerance)
    return 2 * int(np.cumsum(steps).max()) / (len(ha) + len(hb))


def _code_point_ends(raw: bytes) -> np.ndarray:
    """Byte offset of each code point, and the end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def edited(raw: bytes, following: bytes) -> bytes:
    """The last third of the code points replaced by as many first ones of the following text, or all it has."""
    own, other = _code_point_ends(raw), _code_point_ends(following)
    n = len(own) - 1
    third = n // 3
    return raw[: own[n - third]] + following[: other[min(third, len(other) - 1)]]


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents laid out so that each one's successor by descending id follows it in its partition.

    (part, tail, id, packed): a text goes through the shuffle as ``pack`` makes it.  Rows of a part are sorted by descending id and end with a copy, marked ``tail``, of the
    row that follows the part (after the last: the first of all).  Parts are ranges of ids that hold about as many bytes
    of text, found from fine cells between quantiles; rows without an id come last, in ranges of a hash of their text.
    At least ``parts`` parts (the shuffle partitions by default), more if they would hold more than ``part_bytes``.
    """
    spark = docs.sparkSession
    least = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fine = min(_CELLS, 16 * least)
    ids = rows.select("id").where("id is not null")
    cuts = np.array(sorted({int(x) for x in ids.stat.approxQuantile("id", [i / fine for i in range(1, fine)], 0.25 / fine)}), np.int64)
    # ascending order of the last key is descending order of ids; the hash orders rows of one id, and those without one
    cell = _numbered(lambda i: len(cuts) - np.searchsorted(cuts, i, side="left"), "int")
    none = (F.shiftright(F.xxhash64("text"), 58) + 32 + len(cuts) + 1).cast("int")
    celled = rows.withColumn("cell", F.when(F.col("id").isNull(), none).otherwise(cell(F.coalesce("id", F.lit(0).cast("long")))))
    stats = celled.groupBy("cell").agg(F.sum(F.octet_length("text") + 64).alias("size"), F.max("id").alias("id"), F.min(F.xxhash64("text")).alias("h")).toPandas().sort_values("cell")  # a row a cell
    if not len(stats):
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("tail"), "id", F.col("text").cast("binary").alias("packed"))
    ends = np.cumsum(stats["size"].to_numpy())
    n = max(least, int(-(-ends[-1] // part_bytes)))
    _, part = np.unique((ends - stats["size"].to_numpy() // 2) * n // (ends[-1] + 1), return_inverse=True)
    of_cell = np.zeros(len(cuts) + 66, np.int64)
    of_cell[stats["cell"]] = part
    heads = stats.assign(part=part).drop_duplicates("part")
    n = len(heads)
    by_id = np.full(n, np.iinfo(np.int64).min)
    has = heads["id"].notna().to_numpy()
    by_id[has] = heads["id"].to_numpy()[has].astype(np.int64)
    by_hash = heads["h"].to_numpy(np.int64)
    # a part whose first row has an id is told by the id, else by the hash
    dealt = celled.withColumn("part", _numbered(lambda c: of_cell[c], "int")("cell"))
    head = F.when(F.col("id").isNull(), ~F.array(*[F.lit(bool(x)) for x in has])[F.col("part")] & (F.xxhash64("text") == F.array(*[F.lit(int(x)) for x in by_hash])[F.col("part")])).otherwise(
        F.col("id") == F.array(*[F.lit(int(x)) for x in by_id])[F.col("part")])
    place = lambda p, tail: F.struct(p.cast("int").alias("part"), F.lit(tail).alias("tail"))
    here, before = place(F.col("part"), False), place(F.pmod(F.col("part") - 1, F.lit(n)), True)
    laid = dealt.select(F.explode(F.when(head, F.array(here, before)).otherwise(F.array(here))).alias("p"), "id", "text").select("p.part", "p.tail", "id", "text")
    packed = laid.select("part", "tail", "id", F.xxhash64("text").alias("h"), pack()(F.col("text").cast("binary")).alias("packed"))
    sorted_ = packed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "h")
    return sorted_.select("part", "tail", "id", "packed")


def pack():
    """A column function that compresses binary values one by one, by about a third more than a shuffle does: four bytes of length, then zstd."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", compression_level=1)
        return pa.array((len(raw := v.as_buffer()).to_bytes(4, "little") + codec.compress(raw, asbytes=True) for v in x), pa.binary())

    return run


def unpack(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:4], "little")
    return pa.decompress(packed[4:], n, "zstd", asbytes=True) if n else b""


def _numbered(fn, kind: str):
    """A column function of one long column by a function of numpy arrays; only that column goes to Python."""

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(fn(x.to_numpy()))

    return run


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Defined cases: a null text counts as empty; the next of the last document is the first, so a single document
    follows itself; rows that repeat an id follow each other in the order of a hash of their texts, and share a part; rows with a
    null id come last, in that order; an empty table gives an empty table.
    """

    def run(batches):
        held = None  # the row that waits for its successor
        size = 0
        out: list[list] = [[] for _ in range(7)]

        def flush():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            for c in out:
                c.clear()
            return done

        for batch in batches:
            part, tail, ids, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                raw = unpack(texts[i].as_py())
                own = anchors(np.frombuffer(raw, np.uint8))
                p = part[i].as_py()
                if held is not None and held[0] == p:
                    _, one, before, print_ = held
                    text = edited(before, raw)
                    other = anchors(np.frombuffer(text, np.uint8))
                    row = (one, len(_code_point_ends(before)) - 1, hashlib.sha256(text).hexdigest(), encode(print_), encode(other), likeness(print_, other), likeness(print_, own))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    size += len(row[3]) + len(row[4])
                    if size > _OUT_BYTES or len(out[0]) >= 1000:
                        yield flush()
                        size = 0
                held = None if tail[i].as_py() else (p, ids[i].as_py(), raw, own)
        if out[0]:
            yield flush()

    small_batches(docs.sparkSession)
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, parts).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; a scan without a shuffle.  A null text counts as empty."""

    def run(batches):
        for batch in batches:
            first, prints, size = 0, [], 0
            for i, t in enumerate(batch.column(1), 1):
                prints.append(encode(anchors(np.frombuffer((t.as_py() or "").encode(), np.uint8))))
                size += len(prints[-1])
                if size > _OUT_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), pa.array(prints, pa.string())], ["id", "fingerprint"])
                    first, prints, size = i, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)
