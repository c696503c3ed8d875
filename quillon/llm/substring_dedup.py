"""Removal of repeated byte strings by prefix-free parsing.

Every ``length``-byte string of a text that also starts earlier in the corpus is
removed.  Sorting all suffixes of the corpus would take a row a byte, so the
texts are parsed first: a rolling hash over 8 bytes triggers a phrase end, and
a phrase is the stretch of starts up to its trigger together with the ``length - 1`` bytes that follow.
A start's trigger is the least hash among the next ``length / 2`` starts, leftmost
first, so that every string of the length has one (a hash that is 0 modulo p would not
promise that) and equal strings have theirs at the same offset.

- The *parse* is the table of phrase occurrences (key, digest, id, place), the key
  being a hash of the ``length / 2`` bytes from the trigger, which all strings of the phrase hold.
  Keys that occur once, most of them, are dropped before anything else is shuffled.
- The *dictionary* has a row a distinct phrase: its first place and how often it
  occurs.  All strings of a later occurrence also start earlier, so copies, however many,
  cost no more than their row of the parse.
- Where phrases that differ share a key, the suffixes of the dictionary are sorted in shards
  of whole keys, to the depth of ``length`` bytes, compared byte by byte.  Neighbours that agree
  are one string; since a phrase carries its look-ahead, this is their order in the corpus,
  and the first places of the dictionary say which of them starts first.
- A key with more than ``PER_KEY`` phrases does not go to one task: its phrases are cut into
  phrases of one string, which are again added up as a dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, scratch, small_batches, stash

LENGTH = 100
#: Phrases of one key that one task sorts.
PER_KEY = 20_000
#: Starts that are parsed at a time, and bytes of the rolling hash.
_PIECE, _WIDTH = 1 << 18, 8
#: A place is a long: start << 33 | strings of the phrase << 27 | 27 bits of a hash of the text.
_START, _MANY = 33, 27
_LAST = (1 << 63) - 1


def _least(h: np.ndarray, m: int) -> np.ndarray:
    """Index of the least of h[i : i + m], leftmost first, for each i with m values."""
    value, at, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < m:
        step = min(have, m - have)
        right = value[step:] < value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def phrases(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, strings, key, digest) of all phrases of the documents of a buffer, a piece of it at a time."""
    gap = min(length // 2, 62)
    for p in range(0, len(data), _PIECE):
        piece = data[p : p + _PIECE + length - 1]
        if len(piece) < length:
            break
        sums, down = K.prefix_hash(piece), K._power("down", len(piece) + 1)
        grams = K.mix((sums[_WIDTH:] - sums[:-_WIDTH]) * down[: len(sums) - _WIDTH])
        x = np.arange(len(piece) - length + 1)
        doc = np.searchsorted(offs, x + p, side="right") - 1
        x = x[x + p + length <= offs[doc + 1]]
        if not len(x):
            continue
        trigger = _least(grams, gap + 1)[x].astype(np.int64)
        new = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (x[1:] != x[:-1] + 1)))
        first, last, t = x[new], x[np.append(new[1:], len(x)) - 1], trigger[new]
        doc = np.searchsorted(offs, first + p, side="right") - 1
        yield doc, first + p - offs[doc], last - first + 1, K.span_hash(sums, t, t + length - gap), K.span_hash(sums, first, last + length)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("given"), text.alias("text"))
    return out.select("given", F.coalesce("given", F.lit(_LAST)).alias("id"), F.pmod(F.xxhash64("text"), F.lit(1 << _MANY)).alias("kind"), "text")


def repeated_keys(rows: DataFrame, length: int) -> DataFrame:
    """Keys that occur more than once in the parse; each task adds its own up."""
    small_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            data, offs, _ = K.string_buffers(batch.column(0))
            for _, _, _, key, _ in phrases(data, offs, length):
                some, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def parse(rows: DataFrame, length: int) -> DataFrame:
    """(key, digest, id, place) of every phrase occurrence."""

    def run(batch: pa.RecordBatch):
        ids, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, offs, _ = K.string_buffers(batch.column(2))
        for doc, start, n, key, digest in phrases(data, offs, length):
            place = start << _START | n << _MANY | kind[doc]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), digest.view(np.int64), ids[doc], place)], ["key", "digest", "id", "place"])

    return arrow_map(rows.select("id", "kind", "text"), run, "key long, digest long, id long, place long")


def _dictionary(parsed: DataFrame) -> DataFrame:
    """(key, digest, id, place, n): distinct phrases, with the first place and how often they occur."""
    out = parsed.groupBy("key", "digest").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    return out.select("key", "digest", "first.id", "first.place", "n")


def _begin(place: Column) -> Column:
    return F.shiftright(place, _START)


def _span(length: int) -> list[Column]:
    """(id, kind, begin, end): the bytes of all strings of a phrase at its place."""
    place = F.col("place")
    n = F.shiftright(place, _MANY).bitwiseAND(63)
    return [F.col("id"), place.bitwiseAND((1 << _MANY) - 1).alias("kind"), _begin(place).alias("begin"), (_begin(place) + n + (length - 1)).alias("end")]


def _later(parsed: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """Spans of all occurrences of a phrase but those at its first place."""
    first = dictionary.where("n > 1").select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("id").alias("i"), F.col("place").alias("p"))
    out = parsed.join(first, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")))
    return out.where((F.col("id") != F.col("i")) | (F.col("place") != F.col("p"))).select(*_span(length))


def _fetched(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, id, place, hot, text): phrases of the dictionary with their bytes, cut from the documents at their first places."""
    kind = F.col("place").bitwiseAND((1 << _MANY) - 1)
    lists = wanted.groupBy(F.col("id").alias("i"), kind.alias("k")).agg(F.collect_list(F.struct("key", "place", "hot")).alias("at"))
    # equal rows are cut twice: the second time adds nothing
    joined = rows.join(lists, (F.col("id") == F.col("i")) & (F.col("kind") == F.col("k"))).select("id", "text", "at")

    def run(batch: pa.RecordBatch):
        data, offs, _ = K.string_buffers(batch.column(1))
        lists = batch.column(2)
        at, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), ends)
        place = at.field(1).to_numpy()
        lo = offs[doc] + (place >> _START)
        hi = lo + (place >> _MANY & 63) + (length - 1)
        raw = data.tobytes()
        text = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([at.field(0), batch.column(0).take(pa.array(doc)), at.field(1), at.field(2), text], ["key", "id", "place", "hot", "text"])

    return arrow_map(joined, run, "key long, id long, place long, hot boolean, text binary")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at starts sorted by their first ``length`` bytes; those that agree in all of them have one group number."""
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[starts].view(f"S{length}").ravel()
    order = np.argsort(strings, kind="stable")
    strings = strings[order]
    return order, np.cumsum(np.append(False, strings[1:] != strings[:-1])) if len(order) else order


def _sorted_shard(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the strings of the shard's phrases that are not at the first place of their string."""
    ids, place = (table.column(c).to_numpy() for c in ("id", "place"))
    data, offs, _ = K.string_buffers(table.column("text"))
    n = place >> _MANY & 63
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order, group = suffix_order(data, offs[row] + inner, length)
    r = row[order]
    at, kind = (place[r] >> _START) + inner[order], place[r] & ((1 << _MANY) - 1)
    again = np.lexsort((kind, at, ids[r], group))
    order, group, spot = order[again], group[again], np.stack([ids[r], at, kind])[:, again]
    head = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(group)), 0))
    gone = np.zeros(len(row) + 2, bool)
    gone[order + 1] = (spot != spot[:, head]).any(axis=0)
    edge = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(gone[1:-1] & (~gone[:-2] | edge))
    end = np.flatnonzero(gone[1:-1] & (~gone[2:] | np.append(edge[1:], True)))
    k = row[begin]
    lo = (place[k] >> _START) + inner[begin]
    cols = [ids[k], place[k] & ((1 << _MANY) - 1), lo, lo + (end - begin) + length]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "kind", "begin", "end"])


def _sorted_keys(fetched: DataFrame, length: int) -> DataFrame:
    """Suffix arrays of the dictionary by shards of whole keys."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            edge = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            if edge or (held and len(keys) and held[-1].column(0)[-1].as_py() != keys[0]):
                yield _sorted_shard(pa.Table.from_batches([*held, batch.slice(0, edge)]), length)
                held = []
            held.append(batch.slice(edge))
        if sum(b.num_rows for b in held):
            yield _sorted_shard(pa.Table.from_batches(held), length)

    dealt = fetched.where("not hot").select("key", "id", "place", "text").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id long, kind long, begin long, end long")


def _single(fetched: DataFrame, length: int) -> DataFrame:
    """The parse of hot keys with phrases of one string each."""

    def run(batch: pa.RecordBatch):
        ids, place = (batch.column(i).to_numpy() for i in (0, 1))
        data, offs, _ = K.string_buffers(batch.column(2))
        n = place >> _MANY & 63
        row = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        sums, x = K.prefix_hash(data), offs[row] + inner
        key, digest = K.span_hash(sums, x, x + length // 2), K.span_hash(sums, x, x + length)
        spot = ((place[row] >> _START) + inner) << _START | 1 << _MANY | place[row] & ((1 << _MANY) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[row]), pa.array(spot)], ["key", "digest", "id", "place"])

    return arrow_map(fetched.where("hot").select("id", "place", "text"), run, "key long, digest long, id long, place long")


class _Tables:
    """Tables of one run in the shared folder, dropped together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch(spark, "repeats")

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, kind, spans): the bytes to remove of each document that loses some, of ids and kinds as ``_rows`` gives them; spans may overlap."""
    stashed = _Tables(rows.sparkSession)
    try:
        every = _spans(rows, length, stashed).groupBy("id", "kind").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
        return stash(every, "spans")
    finally:
        stashed.drop()


def _spans(rows: DataFrame, length: int, stash: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    keys = stash(repeated_keys(rows, length), "keys")
    parsed = stash(parse(rows, length).join(keys.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi"), "parse")
    dictionary = stash(_dictionary(parsed), "dictionary")
    shared = dictionary.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")).where("m > 1")
    several = dictionary.join(shared, F.col("key") == F.col("k")).select("key", "id", "place", (F.col("m") > PER_KEY).alias("hot"))
    fetched = stash(_fetched(rows, stash(several, "several"), length), "phrases")
    out = _later(parsed, dictionary, length).union(_sorted_keys(fetched, length))
    if fetched.where("hot").limit(1).count():
        single = stash(_single(fetched, length), "single")
        out = out.union(_later(single, _dictionary(single), length))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` the spans and the bytes kept.

    A byte is removed if a string of ``length`` bytes of its text covers it that also starts earlier: in a row of a smaller id, or
    in the same text before it.  Strings may overlap and are judged on the texts as given; spans are maximal.  The bytes kept may be cut
    inside a character, so they are binary.

    Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; a null id comes after all others; rows that repeat an id with
    the same text are one document and lose the same bytes; with other texts they are ordered by start, then by a hash of the text;
    an empty table gives an empty table; very long texts are parsed piece by piece.  Phrases are equal if two 64-bit hashes are.
    """
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, length).select(F.col("id").alias("i"), F.col("kind").alias("k"), "spans")
    joined = rows.join(spans, (F.col("id") == F.col("i")) & (F.col("kind") == F.col("k")), "left").select("given", "text", "spans")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * keep
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<begin:long,end:long>>, kept binary" * keep

    def run(batch: pa.RecordBatch):
        data, offs, _ = K.string_buffers(batch.column(1))
        lists = batch.column(2)
        out: list[list] = [[] for _ in names[1:]]
        for i in range(batch.num_rows):
            text, merged = data[offs[i] : offs[i + 1]].tobytes(), []
            if lists[i].is_valid:
                at = lists[i].values
                lo, hi = at.field(0).to_numpy(), np.maximum.accumulate(at.field(1).to_numpy())
                new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                merged = list(zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))
            ends = [0, *[b for _, b in merged]]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in merged], len(text)], strict=True))
            values = [len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in merged], kept]
            for column, v in zip(out, values, strict=False):
                column.append(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=False)]], names)

    return arrow_map(joined, run, schema).withColumnRenamed("id", id_col)
