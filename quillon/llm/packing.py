"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's tokens (plus an end token) become pieces: what fits a sequence is
one piece; longer documents are cut into full sequences, a shorter piece
first.  Full pieces fill a sequence of their own.  Every other piece goes, the
largest first, where the sum over gaps of (open bins with that gap)^2 becomes
smallest (Csirik et al., 2006): into an open bin of some gap, ties to the
tightest, or into a new bin if that gives a smaller sum.

The rule opens bins that later pieces would fill; at the end of a finite list
some never do.  Pieces of bins that are not full are therefore packed again:
with those of other groups first, and in the last round by the same rule but
with a new bin only if no open one fits.

Pieces are dealt by a hash to groups of about ``GROUP`` rows, each packed on
its own with one counter per gap.  Bins that a group fills exactly are done;
the pieces of the others (about a twelfth) are dealt to new groups, until one
group is left or a round no longer fills bins, where about one sequence a group is lost.  No task sees more than about
GROUP rows, so neither a hot length nor the corpus size matters; ``group=None``
packs everything as one group.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import arrow_map, cut, free_name
from quillon.llm.tokens import load

CAPACITY, END_ID, GROUP = 1024, 2, 20_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row; a null text counts as empty: the end token alone."""

    def run(batch: pa.RecordBatch):
        engine = load(path)
        which, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = np.append(engine.ids(text.as_py() or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
            head = len(ids) % capacity
            cuts = ([0] if head else []) + list(range(head, len(ids), capacity))
            for k, s in enumerate(cuts):
                e = cuts[k + 1] if k + 1 < len(cuts) else len(ids)
                which.append(i)
                piece.append(k)
                start.append(s)
                length.append(e - s)
                crc.append(zlib.crc32(ids[s:e].tobytes()))
        cols = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int, early: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size in the order given, and the fill of each bin.

    early: a new bin may be opened while an open one fits, if the sum of squares becomes smaller.
    """
    open_by_gap: dict[int, list[int]] = defaultdict(list)
    count = np.zeros(capacity + 1, np.int64)  # of open bins by gap; count[0] stays 0: full bins are not open
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 * (count[g - s] - count[g]) + 2, to gap 0 by 1 - 2 * count[g]
        gaps = s + np.flatnonzero(count[s:capacity])
        cost = 2 * (count[gaps - s] - count[gaps]) + 2
        cost[gaps == s] -= 1
        best = int(cost.argmin()) if len(gaps) else -1
        # a new bin of gap capacity - s changes it by 2 * count[capacity - s] + 1
        if best < 0 or early and 2 * count[capacity - s] + 1 < cost[best]:
            b, g = len(fill), capacity
            fill.append(0)
        else:
            g = int(gaps[best])
            b = open_by_gap[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if g > s:
            open_by_gap[g - s].append(b)
            count[g - s] += 1
    return bins, offsets, np.array(fill, np.int64)


def pack_sizes(sizes: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, done) of sizes in descending order; done: its bin is full, or this round is the last."""
    bins, offsets, fill = sum_of_squares(sizes, capacity)
    done = fill[bins] == capacity if len(sizes) else np.zeros(0, bool)
    if last and not done.all():
        again, at, _ = sum_of_squares(sizes[~done], capacity, early=False)
        bins[~done], offsets[~done], done = len(fill) + again, at, np.ones(len(sizes), bool)
    return bins, offsets, done


def _pack_level(items: DataFrame, groups: int, level: int, capacity: int, last: bool) -> DataFrame:
    """(item, size) -> (item, size, bin, shift, done): where each item goes in its group's bins."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        bins, offsets, done = pack_sizes(pdf["size"].to_numpy(), capacity, last)
        base = (np.int64(level) << 56) + (np.int64(key[0]) << 24)
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "bin": base + bins, "shift": offsets, "done": done})

    dealt = items.withColumn("g", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, "item long, size long, bin long, shift long, done boolean")


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int | None = GROUP) -> DataFrame:
    """Rows with a ``length`` of 1 to capacity -> the same rows with sequence_id and offset.

    Offsets are gapless from 0 within a sequence.  Deterministic up to the order of rows that are equal in every column.
    group: pieces of a task, about; None packs all of them in one.  Input columns called sequence_id or offset are left out.
    """
    kept = [c for c in parts.columns if c.lower() not in ("sequence_id", "offset")]
    own = [free_name(c, parts) for c in ("item_", "bin_", "shift_")]
    numbered = cut(parts.withColumn(own[0], F.monotonically_increasing_id()))
    items = numbered.where(F.col("length") < capacity).select(F.col(own[0]).alias("item"), F.col("length").alias("size"))
    n, level, placed = items.count(), 1, []
    while n:
        groups = 1 if group is None else -(-n // group)
        packed = cut(_pack_level(items, groups, level, capacity, groups == 1))
        left = packed.where("not done").count()
        # sizes that fill no bins are not dealt again and again
        if left > 0.5 * n:
            packed, left = cut(_pack_level(items, groups, level, capacity, True)), 0
        placed.append(packed.where("done").select("item", "bin", "shift"))
        items, n, level = packed.where("not done").select("item", "size"), left, level + 1
    place = reduce(DataFrame.union, placed) if placed else None
    if place is None:
        rows = numbered.withColumns({own[1]: F.lit(None).cast("long"), own[2]: F.lit(None).cast("long")})
    else:
        rows = numbered.join(place.toDF(*own), own[0], "left")
    return rows.select(*[f"`{c}`" for c in kept], F.coalesce(own[1], own[0]).alias("sequence_id"), F.coalesce(own[2], F.lit(0).cast("long")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int | None = GROUP) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Defined cases: null and empty texts are one piece, the end token; rows that repeat are packed each;
    a null id is kept; an empty table gives an empty table; other columns are not read.
    """
    out = pack(pieces(docs, path, capacity, end_id, id_col, text_col), capacity, group)
    return out.withColumnRenamed("id", id_col)
