"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A small collection of ``m`` sub-keys is computed per document, each made of
``k`` minhashes.  The tables of the LSH index are keyed by *pairs* of sub-keys,
so m*k minhashes serve m*(m-1)/2 tables of 2k minhashes each: about the square
root of what independent tables would need.  Two texts are candidates if they
share at least two sub-keys.  At the threshold itself (similarity 0.75, m=24,
k=3) a pair is missed with probability 4e-5; at 0.8 with 2e-6.

Scale and skew
* Equal shingle sets are one class from the start, so groups of copies cost one
  row each from there on.
* A sub-key held by one class only cannot take part in any table; such keys are
  dropped before pairs are formed, so only texts with look-alikes are expanded.
* Members of a table are compared with pivots, never listed in pairs.  First every
  pair-keyed table's members with the one that shares most sub-keys.  Where a
  group of look-alikes then still spans several components, its members meet again, in
  one table of the group or, in large groups, in the tables of the single sub-keys
  (24 rows a text), with the first 256, 4096, ... pivots, those with the fewest
  shingles of their own first; either holds all pairs that share two sub-keys.  A table whose members are all connected is done.  No table,
  partner list or candidate list is capped.
* A member is dropped from a table if it cannot be linked there: shingles that no
  other look-alike has bound its similarity to a text of at least the
  smallest size.  Nothing that could be linked is lost.
* Pivots are compared in blocks: a task holds the shingles of up to 256 pivots and
  streams texts past them, one row for each text and block.  A block with many texts is
  replicated to several salts.  A task reports a forest of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import _kernels as K
from quillon.llm._spark import arrow_map, broadcast_if_small, cut, parts_for, small_batches, stash
from quillon.llm.graph import connected_components

WIDTH, SUBKEYS, PER_KEY = 5, 24, 3
#: Pivots whose shingles a task holds at a time, and texts that it compares with a block of them.
PER_BLOCK, PER_SALT = 256, 1024
#: Parts that a bucket is ranked in.
SALTS = 64


def document_shingles(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = K.words(data, offs, K.SPACE_WORDS)
    return K.shingles(hashes, first, width)


def distinct_sets(sh: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, back to back, and their boundaries."""
    parts = [np.unique(sh[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return (np.concatenate(parts) if parts else sh), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _signer(subkeys: int, per_key: int, seed: int):
    rng = np.random.Generator(np.random.PCG64(seed))
    mult = rng.integers(1, 1 << 63, subkeys * per_key, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(documents, subkeys) of 64-bit sub-keys; documents must have shingles."""
        out = np.zeros((len(begin) - 1, subkeys), dtype=np.uint64)
        buffer = np.empty_like(sets)
        for i, a in enumerate(mult):
            np.multiply(sets, a, out=buffer)
            buffer ^= buffer >> np.uint64(32)
            buffer *= np.uint64(0xD6E8FEB86659FD93)
            low = np.minimum.reduceat(buffer, begin[:-1])
            out[:, i // per_key] += K.mix(low + K._SEQ[i % per_key])
        return K.mix(out)

    return sign


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, subkeys: int = SUBKEYS, per_key: int = PER_KEY, seed: int = 11) -> DataFrame:
    """id, n_shingles, (s1, s2): a 128-bit hash of the set, sig: the sub-keys (empty without shingles)."""

    def run(batch: pa.RecordBatch):
        sign = _signer(subkeys, per_key, seed)
        for lo, hi, data, offs in K.chunks(batch.column(1)):
            sets, begin = distinct_sets(*document_shingles(data, offs, width))
            n = np.diff(begin)
            some = n > 0
            packed = np.concatenate(([0], np.cumsum(n[some])))
            sig = sign(sets, packed) if some.any() else np.zeros((0, subkeys), np.uint64)
            sums = np.zeros((2, len(n)), np.uint64)
            if some.any():
                for j in (0, 1):
                    sums[j, some] = np.add.reduceat(K.mix(sets * K._SEQ[40 + j]), packed[:-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * subkeys))), pa.int32()), pa.array(K.to_signed(sig.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(K.to_signed(sums[0])), pa.array(K.to_signed(sums[1])), lists], ["id", "n_shingles", "s1", "s2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, n_shingles long, s1 long, s2 long, sig array<long>")


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(rep, own): the sub-keys (t, key) of each class that at least one other has too, if there are any."""
    keys = classes.select("rep", F.posexplode("sig").alias("t", "key"))
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(shared, ["t", "key"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("t", "key"))).alias("own"))


def _pair_tables(own: DataFrame) -> DataFrame:
    """(bucket, rep, n_own): members of every table keyed by a pair of shared sub-keys."""
    left = own.where(F.size("own") > 1).select("rep", "own", F.posexplode("own").alias("p", "x"))
    pairs = left.select("rep", F.size("own").alias("n_own"), "x", F.explode(F.expr("slice(own, p + 2, size(own))")).alias("y"))
    return pairs.select(F.xxhash64("x.t", "y.t", "x.key", "y.key").alias("bucket"), "rep", "n_own")


class _Block:
    """Pivots of a block, found by shingle, and the forest of links seen so far."""

    def __init__(self):
        self.ids, self.sets, self.parent, self.index = [], [], {}, None

    def add(self, one: int, own: np.ndarray) -> None:
        self.ids.append(one)
        self.sets.append(own)
        self.index = None

    def root(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = x = p[p[x]]
        return x

    def links(self, one: int, own: np.ndarray, percent: int) -> list[int]:
        """Pivots that a text is linked with and was not yet connected with."""
        if self.index is None:
            flat, of = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], of[order], np.array([len(s) for s in self.sets])
        flat, of, sizes = self.index
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = hi - lo
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
        both = np.bincount(of[at], minlength=len(sizes))
        out = []
        for k in np.flatnonzero((both > 0) & (100 * both >= percent * (len(own) + sizes - both))):
            b = self.ids[k]
            if b != one and self.root(one) != self.root(b):
                self.parent[self.root(one)] = self.root(b)
                out.append(b)
        return out


def compare(spark: SparkSession, blocks: DataFrame, asks: DataFrame, texts: DataFrame, percent: int, width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Links (a, b) with 100*|A and B| >= percent*|A or B| between texts (id, text) and the pivots of the blocks that they ask for.

    blocks: (block, id) of pivots, asks: (block, id) of texts.
    """
    small_batches(spark)
    load = asks.groupBy("block").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    ask = asks.join(load, "block").select("block", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "id")
    give = blocks.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "id")
    wanted = cut(ask.union(give))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.join(broadcast_if_small(wanted), "id").select("block", "salt", "kind", "id", "text")
    rows = rows.repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "kind", "id")

    def run(batches):
        held, of = _Block(), None
        for batch in batches:
            who = [batch.column(i).to_numpy() for i in range(4)]
            a, b = [], []
            for lo, _, data, offs in K.chunks(batch.column(4)):
                sets, begin = distinct_sets(*document_shingles(data, offs, width))
                for i in range(len(begin) - 1):
                    block, salt, kind, one = (x[lo + i] for x in who)
                    own = sets[begin[i] : begin[i + 1]]
                    if of != (block, salt):
                        held, of = _Block(), (block, salt)
                    if kind == 0:
                        held.add(one, own.copy())
                    elif held.ids:
                        for other in held.links(one, own, percent):
                            a.append(one)
                            b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _own_shingles(texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(id, n, u) of the texts of reps: shingles, and those that no other of them has."""

    def run(batch: pa.RecordBatch):
        ids = batch.column(0)
        for _, _, data, offs in K.chunks(batch.column(1)):
            sets, begin = distinct_sets(*document_shingles(data, offs, width))
            doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(K.to_signed(sets))], ["id", "x"])
            ids = ids.slice(len(begin) - 1)

    held = arrow_map(texts.join(broadcast_if_small(reps), "id").select("id", "text"), run, "id long, x long")
    each = held.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("df"))
    # a shingle counts for the smallest id that has it; one without any of its own still gets a row through df > 1
    u = each.groupBy("id").agg(F.sum((F.col("df") == 1).cast("long")).alias("u"))
    return reps.join(u, "id", "left").select("id", F.coalesce("u", F.lit(0)).alias("u"))


def _unresolved(members: DataFrame) -> DataFrame:
    """Members (bucket, rep, c) of the tables that span several components c."""
    open_ = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return members.join(broadcast_if_small(cut(open_)), "bucket")


def _first_rows(members: DataFrame, n: int) -> DataFrame:
    """The n first members of each bucket by (u, rep), with their rank r from 1.

    Ranked within salts first, so no task sorts a whole bucket.
    """
    salted = Window.partitionBy("bucket", "salt").orderBy("u", "rep")
    some = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= n).drop("salt", "r")
    return some.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("u", "rep"))).where(F.col("r") <= n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = WIDTH, subkeys: int = SUBKEYS, per_key: int = PER_KEY) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of docs.

    Words are runs of non-white-space after lower-casing A-Z; the set of a
    document holds its distinct runs of ``width`` words, or its whole sequence
    if shorter.  Documents are linked if 100*|A and B| >= percent*|A or B|;
    component_id is the smallest id reachable over links.

    Defined cases: a null or blank text has no shingles, no links and its own
    component.  Rows that repeat an id are compared as texts of their own and each
    gets its text's result; different texts whose smallest id is the same count as
    linked.  A null id takes part in no link; its component_id is null and it is
    kept.  Very long texts are compared whole.  Other columns are not read, so
    clashing names do no harm.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    sig = cut(signatures(docs, id_col, text_col, width, subkeys, per_key))
    sets = sig.where("n_shingles > 0 and id is not null")
    classes = sets.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"))
    # an id that repeats can stand for several classes; they are compared as separate texts
    classes = cut(classes)
    own = cut(_shared_keys(classes.select("rep", "sig")))
    tables = _pair_tables(own)
    head = tables.groupBy("bucket").agg(F.max(F.struct("n_own", (-F.col("rep")).alias("p"))).alias("h"), F.count("*").alias("n")).where("n > 1")
    first_asks = cut(tables.join(head.select("bucket", (-F.col("h.p")).alias("block")), "bucket").where("rep <> block").select("block", F.col("rep").alias("id")).distinct())
    parts = parts_for(spark, first_asks.count())
    first_asks = first_asks.coalesce(parts)
    blocks = first_asks.select("block", F.col("block").alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the texts with look-alikes; only these are read again
    involved = cut(first_asks.select("id").union(blocks.select("id")).distinct(), parts)
    texts = stash(texts.join(broadcast_if_small(involved), "id"), "look-alikes")
    links = cut(compare(spark, blocks, first_asks, texts, percent, width, parts)).coalesce(parts)
    comp = cut(connected_components(links, parts=parts), parts)

    # look-alikes that hang together over candidates but not yet over links
    group = connected_components(first_asks.select(F.col("block").alias("a"), F.col("id").alias("b")), parts=parts)
    group = group.join(comp.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", group["component"].alias("g"), F.coalesce(comp["component"], F.col("node")).alias("c"))
    group = cut(group, parts)
    torn = cut(group.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("g", "size"), 1)
    # one row a group, so a group that holds most texts is not dealt by its number
    reps = cut(group.join(broadcast_if_small(torn), "g").select(F.col("node").alias("id"), "g", "size"), parts)
    if not reps.isEmpty():
        sizes = sig.select("id", "n_shingles").groupBy("id").agg(F.max("n_shingles").alias("n"))
        stats = cut(_own_shingles(texts, reps.select("id"), width).join(sizes, "id").join(reps, "id")).coalesce(parts)
        # a group is one table while that takes fewer rows than its sub-key tables: size / (2 * PER_BLOCK) < subkeys
        whole = F.col("size") <= 2 * PER_BLOCK * subkeys
        open_ = stats.where(whole).select(F.xxhash64("g").alias("bucket"), F.col("id").alias("rep"), "n", "u")
        large = stats.where(~whole)
        wide = parts_for(spark, stats.count() + large.count() * subkeys)
        keyed = own.join(large, F.col("rep") == F.col("id")).select("rep", "n", "u", F.explode("own").alias("k")).select(F.xxhash64("k.t", "k.key").alias("bucket"), "rep", "n", "u")
        open_ = open_.union(keyed)
        open_ = cut(open_, wide)
        least = broadcast_if_small(cut(open_.groupBy("bucket").agg(F.min("n").alias("least"))))
        open_ = open_.join(least, "bucket").where(100 * (F.col("n") - F.col("u")) >= percent * (F.col("least") + F.col("u"))).select("bucket", "rep", "u")
        first = PER_BLOCK
        while True:
            here = cut(open_.join(comp, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "u", F.coalesce("component", "rep").alias("c")), wide)
            members = cut(_unresolved(here), wide)
            if members.isEmpty():
                break
            heads = cut(_first_rows(members, first), wide)
            # a pivot belongs to one block, that of its first table, so tables that share pivots share blocks
            home = heads.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("bucket", "r")).alias("h"))
            blocks = cut(home.select(F.xxhash64("h.bucket", F.floor((F.col("h.r") - 1) / PER_BLOCK)).alias("block"), "id"), parts)
            of_bucket = heads.join(blocks, F.col("rep") == F.col("id")).groupBy("bucket", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("id").alias("last"), F.min("id").alias("one"))
            asks = members.join(broadcast_if_small(cut(of_bucket)), "bucket").where("not (lo = c and hi = c) and not (last = rep and one = rep)").select("block", F.col("rep").alias("id")).distinct()
            links = links.union(cut(compare(spark, blocks, cut(asks, wide), texts, percent, width, wide)).coalesce(wide))
            comp = cut(connected_components(links, parts=wide), parts)
            bound = broadcast_if_small(cut(heads.groupBy("bucket").agg(F.max(F.struct("u", "rep")).alias("bound"))))
            open_ = members.join(bound, "bucket").where(F.struct("u", "rep") > F.col("bound")).select("bucket", "rep", "u")
            first *= 16

    of_set = classes.select("s1", "s2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(of_set, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
