"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, in the order and with
the column names of its input whatever other columns that has; between stages
the rows are written as Parquet and read again, so a stage that is lost is
run again from its input alone.  Stages 1 to 4 return the columns of documents.

1. toxicity: documents scored as toxic go.
2. line_dedup: lines repeated across documents go, except in the largest id.
3. near_dedup: of each group of near-duplicates the smallest id stays.
4. decontamination: documents that hold a benchmark passage go.
5. packing: what remains is packed into sequences of 1,024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, near_dedup, packing
from quillon.llm import toxicity as tox
from quillon.llm._spark import fold, free_name, load, scratch, without
from quillon.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.5.

    Null and empty texts have no evidence against them and stay; so do rows with a null id, which no decision names; rows
    that repeat an id go together.  Without documents or labels nothing goes.
    """
    seen = fold("doc_id", 5) != 0
    model = tox.train(docs.where(seen), load(spark, sf_dir, "labels").where(seen))
    bad = tox.score(docs, model).where("score >= 0.5 and doc_id is not null")
    return without(docs, bad.select("doc_id"), "doc_id")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; n_chars follows a text that lost some.

    A null text stays null, a text that loses all lines becomes empty, a null id loses none.  An empty table stays empty.
    """
    names = tuple(free_name(n, docs) for n in ("n_lines", "n_dropped", "kept_sha256"))
    out = line_dedup.drop_repeated_lines(docs, measures=names)
    n_chars = F.when(F.col(names[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*[f"`{c}`" for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id.

    Texts without words are in no group and stay, as do rows with a null id; rows that repeat an id stay or go together.
    """
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("not kept")
    return without(docs, gone.select("doc_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no passage of the benchmark occurs in; null texts and rows with a null id stay."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their sequences; a null text is the end token alone, a null id is kept."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A learned stage and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
