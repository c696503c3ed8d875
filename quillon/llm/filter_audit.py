"""How filters interact: every order of them at once, by a lattice of subsets.

Of k filters there are k! orders, but a step of an order depends only on the
*set* of filters applied before it.  The states of all orders are thus the
subsets of the filters, and a step is an edge (already applied subset, next
filter): k * 2^(k-1) edges, 80 for five filters.  A document's failures are a
bit mask, so rows are first added up by part and mask (at most 2^k rows a
part, added up before the shuffle), each of these contributes to all edges, and the
edges of a part are joined with the k * k! steps of all orders, which are
paths through the lattice.  Only DataFrame functions are used.

A filter is a boolean column that is true where a document fails.  The one
for repeated texts compares a 128-bit digest: a group of equal texts is added up by
task before it is shuffled, so its size does not matter.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm._spark import stash

WORD = r"([^\x20\x09-\x0D]+)"
#: Null ids match no label; they are spread over so many values of a second join key.
_SALTS = 4096
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failures that a text alone decides: short, repetitive, shouting, symbols."""
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(flags: list[Column]) -> Column:
    out = F.lit(0)
    for i, flag in enumerate(flags):
        out = out + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail, and how many of them are labelled."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    rows = rows.select("id", "part", _bits(list(text_filters(F.col("text"), F.col("words")).values())).alias("mask"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.lit(0).alias("label_salt"), "quality", "toxic").where("label_id is not null")
    known = known.groupBy("label_id", "label_salt").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, (F.col("id") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.select("id", "salt", "digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = stash(rows.groupBy("id", "salt", *kind).agg(F.count("*").alias("n")), "audit")

    # the smallest id of each text that occurs more than once; rows with it, or with no id, do not fail
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("copies")).where("copies > 1").select(F.col("digest").alias("d"), "first")
    no_id, least = F.col("id").isNull(), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(no_id, F.col("n"))), F.lit(0)).alias("no_id"), least.alias("least"))
    groups = groups.join(first, F.col("digest") == F.col("d"), "left")
    at_first = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    good_rows = F.when(F.col("d").isNull(), F.col("n")).otherwise(F.col("no_id") + at_first)
    both = F.array(F.struct(F.col("mask").alias("mask"), good_rows.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - good_rows).alias("n")))
    out = groups.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    return out.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def edges(counts: DataFrame, k: int) -> DataFrame:
    """(part, applied, filter, the six counts, shapley): all edges of the lattice of each part."""
    lattice = [(s, f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    bit, weight = F.col("bit"), F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), F.bit_count("applied") + 1)
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s, f in lattice])).alias("e")
    rows = counts.select("part", "mask", "n", "good", "toxic", at).select("part", "mask", "n", "good", "toxic", "e.*")
    mask = F.col("mask")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("applied")) != 0
    total = lambda test, of="n": F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0))
    sums = [total(~fails & ~gone), total(fails & ~gone), total(fails & gone), total(mask == bit), total(fails & ~gone, "good"), total(fails & ~gone, "toxic")]
    out = rows.groupBy("part", "applied", "filter").agg(*[s.alias(c) for s, c in zip(sums, _COUNTS, strict=True)])
    # 2^(k-1) rows a window; a subset of size i comes before a filter in i! (k-1-i)! orders
    return out.withColumn("shapley", F.sum(F.col("removed") * weight).over(W.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step, with what the step keeps and removes.

    Filters (a document fails): A under 200 words, B fewer than half of the words distinct, C over 2 % capitals A-Z, D holds one of
    ``#$%&*|``, E the text of a smaller id anywhere in the table.  Words are runs without ASCII white space.

    Defined cases: a null text is empty, a null part is the empty string; an empty text has no words, fails A and, as a copy, E;
    rows that repeat an id are each counted, and none of those with a text's smallest id fails E; a row with a null id
    never fails E, makes no other row fail and has no label; a document with several labels is good or toxic if one says so;
    other columns of docs are not read; without rows there is no part and no row.
    """
    names = "ABCDE"
    steps = [("".join(p), i + 1, sum(1 << names.index(x) for x in p[:i]), names.index(p[i])) for p in itertools.permutations(names) for i in range(len(names))]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, on int, next int")  # k * k! rows: 600
    out = edges(masks(docs, labels, id_col, text_col, part_col), len(names))
    out = out.join(F.broadcast(paths), (F.col("applied") == F.col("on")) & (F.col("filter") == F.col("next")))
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*_COUNTS, "shapley")])
