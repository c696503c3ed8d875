"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task splits its documents into shards of whole documents and builds, per
shard, a word-level suffix array.  Each distinct suffix of the benchmark that
has at least a window (the other suffixes cannot hold one) is binary-searched
in it, which gives its range of verbatim occurrences; from these follow the
words hit, the longest match and its places.  The array is *sparse*: it holds only
positions whose word (for items of one word) or word pair occurs in the
benchmark, looked up in a bit table; a false positive costs one entry, nothing
is missed.  Suffixes end with their document.  Comparisons are on 64-bit word hashes.

The benchmark reaches the tasks by broadcast in blocks of at most
``block_bytes`` of text.  Longer items are cut into overlapping pieces, so the
bound holds for every block.  A larger benchmark makes more blocks, and every
shard is searched for all of them in the same scan of the documents; a task
holds ``_HELD`` blocks at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, cut, small_batches, without

#: A block of 8 MB has about 1.5 million suffixes: some 50 MB in a broadcast.
WINDOW, BLOCK_BYTES, SHARD_BYTES = 10, 8 << 20, 4 << 20
_BITS, _HELD = 22, 4
#: Matches that are extended at a time.
_PAIRS = 1 << 18


@dataclass
class Queries:
    """The suffixes of a block of the benchmark; equal ones are one query."""

    words: np.ndarray  # hashes of all words, item after item
    stop: np.ndarray  # end of the item that each word belongs to
    start: np.ndarray  # its begin
    item: np.ndarray  # its index in ids
    at: np.ndarray  # a place of each query
    length: np.ndarray  # words that must match: the window, or a whole short item
    first: np.ndarray  # of each query in places, + total
    places: np.ndarray  # all places of each query
    ids: np.ndarray
    skip: np.ndarray  # words of an item before the piece that ids stands for
    pairs: np.ndarray  # bit table of first word pairs
    singles: np.ndarray  # bit table of the words of one-word items
    depth: int
    order: np.ndarray  # places of whole windows, sorted by the suffix that starts there
    low: np.ndarray  # of each query in order: its places stand together there
    key: np.ndarray  # of each of order: its rank by item id and place in the item
    sums: np.ndarray  # prefix sums of the words' polynomial hash
    item_first: np.ndarray  # of each query in item_of, + total
    item_of: np.ndarray  # the ids of the items that have each query, each once

    def word(self, query: np.ndarray, j: int) -> np.ndarray:
        return self.words[np.minimum(self.at[query] + j, len(self.words) - 1)]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * K._SEQ[0] + b) * K._SEQ[1]


def prepare(ids: list[int], texts: list[str | None], window: int = WINDOW, skip: list[int] | None = None) -> Queries:
    data = [(t or "").encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    h, _, _, first = K.words(np.frombuffer(b"".join(data), np.uint8), offs, K.ALNUM_WORDS)
    n = np.diff(first)
    need = np.minimum(window, n)
    count = np.where(n > 0, n - need + 1, 0)
    item = np.repeat(np.arange(len(ids)), count)
    at, length = first[item] + _expand(np.zeros(len(ids), np.int64), count), need[item]
    key = np.zeros(len(at), np.uint64)
    for j in range(window):
        ok = j < length
        key[ok] += h[at[ok] + j] * K._SEQ[j]
    key = K.mix(key + length.astype(np.uint64) * K._SEQ[61])
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else np.zeros(0, np.int64)
    places = at[order]
    one, size = places[new], length[order][new]
    pairs, singles = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
    many = size > 1
    if many.any():
        pairs[_slot(_pair(h[one[many]], h[one[many] + 1]))] = True
    if (~many).any():
        singles[_slot(h[one[~many]] * K._SEQ[2])] = True
    stop, begin, owner = np.repeat(first[1:], n), np.repeat(first[:-1], n), np.repeat(np.arange(len(ids)), n)
    names, skipped = np.array(ids, np.int64), np.array(skip or [0] * len(ids), np.int64)
    rank = _suffix_ranks(h, stop, int(n.max()) if len(n) else 0)
    query = np.repeat(np.arange(len(one)), np.diff(np.append(new, len(places))))
    whole = size[query] == window
    sorted_ = np.lexsort((places[whole], rank[places[whole]]))
    order, of = places[whole][sorted_], query[whole][sorted_]
    low = np.zeros(len(one) + 1, np.int64)
    some = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    low[of[some]] = some
    key = np.empty(len(order), np.int64)
    key[np.lexsort((order - begin[order] + skipped[owner[order]], names[owner[order]]))] = np.arange(len(order))
    pair = np.unique(np.stack([query, names[owner[places]]]), axis=1) if len(places) else np.zeros((2, 0), np.int64)
    return Queries(
        h, stop, begin, owner, one, size, np.append(new, len(places)), places, names, skipped, pairs, singles, window,
        order, low, key, _sums(h), np.searchsorted(pair[0], np.arange(len(one) + 1)), pair[1],
    )


def _suffix_ranks(words: np.ndarray, stop: np.ndarray, longest: int) -> np.ndarray:
    """Rank of each word's suffix, which ends with its item, by doubling the depth compared."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    at, k = np.arange(len(words)), 1
    while k < longest and (not len(rank) or rank.max() < len(rank)):
        after = np.where(at + k < stop, rank[np.minimum(at + k, len(rank) - 1)], 0)
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return rank


def _sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * K._power("up", len(words)), out=out[1:])
    return out


class SuffixArray:
    """Word suffixes of one shard in lexicographic order of their first ``depth`` hashes."""

    def __init__(self, words: np.ndarray, first: np.ndarray, queries: Queries):
        self.words, self.q = words, queries
        n = len(words)
        self.start, self.stop = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        at = np.arange(n)
        take = np.zeros(n, bool)
        if n > 1:
            take[:-1] = queries.pairs[_slot(_pair(words[:-1], words[1:]))] & (at[:-1] + 1 < self.stop[:-1])
        if queries.singles.any():
            take |= queries.singles[_slot(words * K._SEQ[2])]
        at = np.flatnonzero(take)
        keys = np.zeros((queries.depth, len(at)), np.uint64)
        for j in range(queries.depth):
            ok = at + j < self.stop[at]
            keys[j, ok] = words[at[ok] + j]
        order = np.lexsort(keys[::-1])
        self.at, self.keys = at[order], keys[:, order]

    def _bound(self, upper: bool) -> np.ndarray:
        q = self.q
        lo, hi = np.zeros(len(q.at), np.int64), np.full(len(q.at), len(self.at), np.int64)
        live = np.arange(len(q.at))
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less, same = np.zeros(len(live), bool), np.ones(len(live), bool)
            for j in range(q.depth):
                seen = same & (j < q.length[live])
                if not seen.any():
                    break
                key, want = self.keys[j, mid], q.word(live, j)
                less |= seen & (key < want)
                same &= ~seen | (key == want)
            right = less | (same if upper else False)
            lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]
            live = live[lo[live] < hi[live]]
        return lo

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, query) of every occurrence of every query."""
        if not len(self.at) or not len(self.q.at):
            none = np.zeros(0, np.int64)
            return none, none
        lo, hi = self._bound(False), self._bound(True)
        return self.at[_expand(lo, hi - lo)], np.repeat(np.arange(len(lo)), hi - lo)

    def _equal(self, p: np.ndarray, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from p in the shard are those from f in the benchmark, both within their texts."""
        q = self.q
        ok = (p + n <= self.stop[p]) & (f + n <= q.stop[f])
        e, g = np.where(ok, p + n, p), np.where(ok, f + n, f)
        return ok & ((self.sums[e] - self.sums[p]) * self.down[p] == (q.sums[g] - q.sums[f]) * self.down[f])

    def _common(self, p: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Words that the texts have in common from p and f on: at least a window."""
        lo = np.full(len(p), self.q.depth, np.int64)
        hi = np.minimum(self.stop[p] - p, self.q.stop[f] - f)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self._equal(p, f, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def longest(self, at: np.ndarray, query: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(document, -words, item id, place in the document, place in the item) of each document's longest match, in columns.

        Every matched place is searched in the benchmark's suffixes, among those that begin with its window; its longest match is one of its
        two neighbours there, and all that match as long stand around them.  No pairs of places are listed.
        """
        q = self.q
        doc = np.searchsorted(first, at, side="right") - 1
        short = q.length[query] < q.depth
        p, k = at[short], query[short]
        # a short item matches as a whole or not at all; its first name is the least
        out = [np.stack([doc[short], -q.length[k], q.item_of[q.item_first[k]], p - first[doc[short]], np.zeros(len(p), np.int64)])]
        p, k, doc = at[~short], query[~short], doc[~short]
        if len(p):
            self.sums, self.down = _sums(self.words), K._power("down", max(len(self.words), len(q.words)) + 1)
            begin, end = q.low[k], q.low[k] + q.first[k + 1] - q.first[k]
            lo, hi = begin.copy(), end.copy()
            live = np.arange(len(p))
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                x, f = p[live], q.order[mid]
                n = self._common(x, f)
                e, g = x + n, f + n
                over = e < self.stop[x]  # more words follow in the document
                right = over & (g >= q.stop[f])
                both = over & (g < q.stop[f])
                right[both] = self.words[e[both]] > q.words[g[both]]
                lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]
                live = live[lo[live] < hi[live]]
            best = np.zeros(len(p), np.int64)
            for side, there in ((lo - 1, lo > begin), (lo, lo < end)):
                best[there] = np.maximum(best[there], self._common(p[there], q.order[side[there]]))
            most = np.zeros(len(first) - 1, np.int64)
            np.maximum.at(most, doc, best)
            top = best == most[doc]
            p, doc, best, begin, end, at = p[top], doc[top], best[top], begin[top], end[top], lo[top]
            # the neighbours that match as long: from the first that does to the last
            near = np.where((at > begin) & self._equal(p, q.order[np.maximum(at - 1, 0)], best), at - 1, at)
            ends = []
            for far, step in ((begin, -1), (end - 1, 1)):
                a, b = near.copy(), far.copy()
                while (a != b).any():
                    mid = (a + b + (step > 0)) >> 1
                    same = self._equal(p, q.order[mid], best)
                    a, b = np.where(same, mid, a), np.where(same, b, mid - step)
                ends.append(a)
            # places with the same neighbours have the same items: the first of them holds
            kind = np.stack([doc, ends[0], ends[1], p])
            kind = kind[:, np.lexsort(kind[::-1])]
            kind = kind[:, np.append(True, (kind[:3, 1:] != kind[:3, :-1]).any(axis=0))]
            spans, back = np.unique(kind[1:3], axis=1, return_inverse=True)
            least = np.array([q.key[a : b + 1].argmin() + a for a, b in spans.T], np.int64)[back.ravel()]
            f = q.order[least]
            out.append(np.stack([kind[0], -most[kind[0]], q.ids[q.item[f]], kind[3] - first[kind[0]], f - q.start[f] + q.skip[q.item[f]]]))
        return np.concatenate(out, axis=1)

    def extended(self, at: np.ndarray, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the shard, place in the benchmark, words) of the longest match from each pair of equal places."""
        q = self.q
        times = q.first[query + 1] - q.first[query]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(times) // _PAIRS)) + 1):
            p = np.repeat(at[some], times[some])
            f = q.places[_expand(q.first[query[some]], times[some])]
            n = np.repeat(q.length[query[some]], times[some])
            live = np.arange(len(p))
            while len(live):
                live = live[(p[live] + n[live] < self.stop[p[live]]) & (f[live] + n[live] < q.stop[f[live]])]
                live = live[self.words[p[live] + n[live]] == q.words[f[live] + n[live]]]
                n[live] += 1
            yield p, f, n


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... n[i] values each."""
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(begin - lo, n)


def _shards(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, words before each document)"""
    for a, b, data, offs in K.chunks(column, SHARD_BYTES):
        words, _, _, first = K.words(data, offs, K.ALNUM_WORDS)
        yield a, b, words, first


def _pieces(rows: DataFrame, most: int, window: int) -> DataFrame:
    """(id, text, skip): texts of more than ``most`` bytes as pieces of that many, each but the first from ``window - 1`` words before the last one's end."""

    def run(batch: pa.RecordBatch):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py().encode()
            _, starts, ends, _ = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.ALNUM_WORDS)
            out, k = [], 0
            while True:
                # at least a window of words, whatever their size
                end = len(raw) if not len(starts) or len(raw) - starts[k] <= most else int(ends[min(len(ends) - 1, max(k + window - 1, int(np.searchsorted(ends, starts[k] + most, side="right")) - 1))])
                out.append((raw[starts[k] if k else 0 : end].decode(), k))
                done = int(np.searchsorted(ends, end, side="right"))
                if done >= len(starts):
                    break
                k = max(k + 1, done - window + 1)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(out), pa.int64()), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], ["id", "text", "skip"])

    small = rows.where(F.octet_length("text") <= most).withColumn("skip", F.lit(0).cast("long"))
    return small.union(arrow_map(rows.where(F.octet_length("text") > most), run, "id long, text string, skip long"))


def _blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int) -> list:
    """Broadcasts of the benchmark's blocks, each of at most block_bytes of text."""
    spark = bench.sparkSession
    rows = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    weight = F.octet_length("text") + 64
    size = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    n = 1
    if size > block_bytes:
        # equal rows add nothing
        rows, n = cut(_pieces(rows.distinct(), max(1, block_bytes // 16), window)), -(-size * 2 // block_bytes)
        block = lambda n: F.pmod(F.xxhash64("id", "skip", "text"), F.lit(n))
        while n < 64 * size and rows.groupBy(block(n)).agg(F.sum(weight).alias("w")).agg(F.max("w")).first()[0] > block_bytes:
            n *= 2
    out = []
    for i in range(n):
        got = (rows.where(block(n) == i) if n > 1 else rows).collect()  # at most block_bytes of text
        if got or n == 1:
            out.append(spark.sparkContext.broadcast(prepare([r.id for r in got], [r.text for r in got], window, [r["skip"] for r in got] if n > 1 else None)))
    return out


def _searched(blocks: list, words: np.ndarray, first: np.ndarray) -> Iterator[SuffixArray]:
    for sent in blocks:
        yield SuffixArray(words, first, sent.value)
        if len(blocks) > _HELD:
            vars(sent).pop("_value", None)  # read again from the worker's disk


_COLUMNS = "id long, n_words long, n_hit long, items array<long>, spans array<struct<begin:long,end:long>>, longest_words long, longest_item long, longest_item_word long, longest_doc_word long"


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match and spans.

    Words are runs of digits, letters and non-ASCII, A-Z lower-cased.  A window is ``window``
    consecutive words of an item; an item of fewer words, but some, is one window.  A word is hit if
    it lies inside an occurrence of a window.  The longest match is the longest run of words that a document shares with an
    item, of at least a window: longest_words (else 0), and where it stands (else null): longest_item, longest_item_word,
    longest_doc_word.  Ties go to the smallest item, then place in the document, then in the item.  Spans are (begin, end) of hit words.

    Defined cases: a null, empty or wordless text has no words and no hits; null item ids or texts and
    wordless items have no windows; rows that repeat an item id are one item with the windows of all;
    rows that repeat a document are each answered; a null id is kept; empty tables give no hits or no rows; very long
    texts are searched whole; very long items in pieces, and a match that runs over a piece's end is reported up to it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(bench, item_col, "text", block_bytes, window)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch):
        for a, b, words, first in _shards(batch.column(1)):
            delta = np.zeros(len(words) + 1, np.int64)
            found, best = [np.zeros((2, 0), np.int64)], [np.zeros((5, 0), np.int64)]
            for array in _searched(blocks, words, first):
                at, query = array.matches()
                if not len(at):
                    continue
                q = array.q
                np.add.at(delta, at, 1)
                np.add.at(delta, at + q.length[query], -1)
                doc = np.searchsorted(first, at, side="right") - 1
                once = np.unique(np.stack([doc, query]), axis=1)
                times = q.item_first[once[1] + 1] - q.item_first[once[1]]
                items = q.item_of[_expand(q.item_first[once[1]], times)]
                found.append(np.unique(np.stack([np.repeat(once[0], times), items]), axis=1))
                best.append(array.longest(at, query, first))
            hit = np.cumsum(delta)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[first[1:]] - sums[first[:-1]]
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            edges = np.searchsorted(pairs[0], np.arange(b - a + 1))
            best = np.concatenate(best, axis=1)
            best = best[:, np.lexsort(best[::-1])]
            best = best[:, np.append(True, best[0][1:] != best[0][:-1])] if best.shape[1] else best
            some = np.zeros(b - a, bool)
            some[best[0]] = True
            top = np.zeros((4, b - a), np.int64)
            top[:, best[0]] = [-best[1], best[2], best[4], best[3]]
            spans = []
            for i in range(b - a):
                h = np.diff(hit[first[i] : first[i + 1]].astype(np.int8), prepend=0, append=0) if n_hit[i] else np.zeros(0)
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(h == 1), np.flatnonzero(h == -1), strict=True)])
            cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs[1])), pa.array(spans, span), pa.array(top[0])]
            cols += [pa.array(x, mask=~some) for x in top[1:]]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _COLUMNS.split(", ")])

    out = arrow_map(rows, run, _COLUMNS)
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256)
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest_words", "longest_item", "longest_item_word", "longest_doc_word", "spans",
    )


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every benchmark suffix that occurs: (item, item_word, n_words, id, doc_word).

    One row for each suffix over all shards; ties go to the smallest document, then place.  Suffixes that match
    fewer than ``window`` words (or less than the whole of a shorter item) have no row; null ids take no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(bench, item_col, "text", block_bytes, window)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, words, first in _shards(batch.column(1)):
                for array in _searched(blocks, words, first):
                    q = array.q
                    for p, f, n in array.extended(*array.matches()):
                        doc = np.searchsorted(first, p, side="right") - 1
                        # of a place in the benchmark, the best of these
                        best = np.lexsort((p - first[doc], ids[a + doc], -n, f))
                        best = best[np.append(True, f[best][1:] != f[best][:-1])] if len(best) else best
                        p, f, n, doc = p[best], f[best], n[best], doc[best]
                        cols = [q.ids[q.item[f]], f - q.start[f] + q.skip[q.item[f]], n, ids[a + doc], p - first[doc]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "item_word", "n_words", "id", "doc_word"])

    out = rows.where("id is not null").mapInArrow(run, "item long, item_word long, n_words long, id long, doc_word long")
    best = F.max(F.struct("n_words", (-F.col("id")).alias("i"), (-F.col("doc_word")).alias("w"))).alias("b")
    return out.groupBy("item", "item_word").agg(best).select("item", "item_word", F.col("b.n_words"), (-F.col("b.i")).alias("id"), (-F.col("b.w")).alias("doc_word"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, with their columns, that no benchmark window occurs in.  Rows with a null id stay; rows that repeat an id go together."""
    return without(docs, contamination(docs, bench, id_col, text_col, **options).where("contaminated").select(id_col).where(F.col(id_col).isNotNull()), id_col)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
