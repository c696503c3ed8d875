"""Candidates, evaluations, task banks, prompt rows, archives and mined factors as tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import panel, seeds, shaping, text
from quillon.sources.config import parse, read_config, unfenced, write_config
from quillon.sources.ledger import Ledger, first_of

CANDIDATES = "idx long, id string, name string, expr string, intuition string, category string, metadata map<string,string>"
EVALUATIONS = CANDIDATES + ", valid boolean, status string, seed_score double, metrics map<string,double>, reasons array<string>, canonical_hash string, invert boolean"
MINED = "expr_hash string, expr string, score double"


def read_if_there(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at path, or an empty one if nothing is there yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def candidate_rows(items: list[dict[str, Any]], skip: bool = False) -> list[tuple]:
    """Rows of CANDIDATES with defaults: id numbered by place, name from id, category general.

    An item without an expr is an error, or left out (but numbered) if skip is set.
    """
    out = []
    for i, x in enumerate(items):
        if not isinstance(x, dict) or "expr" not in x:
            if skip:
                continue
            raise ValueError(f"candidate {i} has no expr")
        key = str(x.get("id", f"seed_{i:04d}"))
        out.append((i, key, str(x.get("name", key)), str(x["expr"]), str(x.get("intuition", "")), str(x.get("category", "general")), {k: str(v) for k, v in (x.get("metadata") or {}).items()}))
    return out


def _items(data: Any) -> list[dict[str, Any]]:
    return (data.get("seeds") or []) if isinstance(data, dict) else list(data)


def candidates(spark: SparkSession, path: str | Path) -> DataFrame:
    """Candidates of a YAML or JSON file: a list, or one under ``seeds``; some hundreds of rows."""
    return spark.createDataFrame(candidate_rows(_items(read_config(path))), CANDIDATES)


def answered_candidates(spark: SparkSession, answer: str) -> DataFrame:
    """Candidates of one answer, fenced or not: as YAML or JSON, else by its loose lines; none at all is an error."""
    body = unfenced(answer)
    try:
        data = parse(body)
    except ValueError:
        data = None
    except Exception as e:  # the YAML library's errors have no common built-in base
        if type(e).__module__.partition(".")[0] != "yaml":
            raise
        data = None
    if data is None:
        loose = text.loose_candidates(spark.createDataFrame([(0, body)], "key int, body string"), "key", "body")
        rows = [tuple(r) for r in loose.select("idx", "seed_id", "name", "expr", "intuition", "category", F.create_map().cast("map<string,string>")).collect()]  # of one answer
    elif isinstance(data, dict | list):
        rows = candidate_rows(_items(data), skip=True)
    else:
        raise ValueError("the answer is neither a list nor a mapping")
    if not rows:
        raise ValueError("no candidate with an expr")
    return spark.createDataFrame(rows, CANDIDATES)


def save_evaluations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Saved evaluations; what is missing is valid, ``loaded``, with score 0."""
    # rows without a number keep the order of the file; the counter has a column of its own, since it must run on every row
    df = spark.read.schema(EVALUATIONS).json(path).withColumn("_row", F.monotonically_increasing_id())
    idx = F.coalesce("idx", "_row")
    key = F.coalesce("id", F.format_string("seed_%04d", idx))
    defaults = {"idx": idx, "id": key, "name": F.coalesce("name", key), "intuition": F.coalesce("intuition", F.lit("")), "category": F.coalesce("category", F.lit("general")),
                "valid": F.coalesce("valid", F.lit(True)), "status": F.coalesce("status", F.lit("loaded")), "seed_score": F.coalesce("seed_score", F.lit(0.0)),
                "metrics": F.coalesce("metrics", F.create_map().cast("map<string,double>")), "reasons": F.coalesce("reasons", F.array().cast("array<string>")),
                "canonical_hash": F.coalesce("canonical_hash", F.lit("")), "invert": F.coalesce("invert", F.lit(False))}
    return df.withColumns(defaults).drop("_row")


def write_prompts(tasks: DataFrame, path: str, system: str, template: str, n: int = 0, split: str = "train", seed: int = 0) -> None:
    """Prompt rows of all tasks, or of n drawn evenly over families; other splits than train draw with another seed."""
    rows = tasks if n <= 0 else seeds.stratified_sample(tasks, n, seed=seed + (0 if split == "train" else 100_000))
    seeds.prompt_rows(rows, system, template).write.mode("overwrite").parquet(path)


def append_counts(batch: DataFrame, path: str, key: str = "hash") -> None:
    """Adds a batch to a JSON archive of counts; one writer at a time."""
    spark = batch.sparkSession
    shaping.record(batch, shaping.counts(read_if_there(spark, path, f"{key} string, count long", "json"), key), key).write.mode("append").json(path)


PROFILE_KEYS = ("expr_hash", "expr", "raw_score", "task_id", "start_date", "end_date")
DIRECTION = "ts timestamp_ntz, pred tinyint, label tinyint, mask boolean, correct boolean"
RANKS = "ts timestamp_ntz, symbol string, rank_pct double"


def _profile_schema(cells: str) -> str:
    return f"expr_hash string, expr string, raw_score double, task_id string, start_date string, end_date string, seq long, profile array<struct<{cells.replace(' ', ': ').replace(',:', ',')}>>"


def load_items(spark: SparkSession, path: str, cells: str, k: int = 128) -> DataFrame:
    """The archived items of a folder of JSON lines: the best of each expression, the k best; malformed lines are skipped."""
    rows = read_if_there(spark, path, _profile_schema(cells), "json").where("coalesce(expr_hash, '') <> ''")
    return shaping.best(rows.withColumn("raw_score", F.coalesce("raw_score", F.lit(-9.0))), k, "expr_hash")


def load_profiles(spark: SparkSession, path: str, cells: str, k: int = 128) -> DataFrame:
    """A row for each cell of the archived items' profiles: DIRECTION for residual archives, RANKS for behaviour archives."""
    return load_items(spark, path, cells, k).select("expr_hash", "raw_score", F.inline("profile"))


def append_profiles(items: DataFrame, cells_of: DataFrame, path: str, cells: str) -> None:
    """Adds items (PROFILE_KEYS) with their profiles, rows of (expr_hash, cells).

    Items without a profile, or worse than what the archive holds of their expression, are left out; one writer at a time.
    """
    spark = items.sparkSession
    names = [c.split()[0] for c in cells.split(", ")]
    # a profile is as long as the bars of its interval
    profile = cells_of.groupBy("expr_hash").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("profile"))
    old = read_if_there(spark, path, _profile_schema(cells), "json").groupBy("expr_hash").agg(F.max("raw_score").alias("_old"), F.max("seq").alias("_seq"))
    rows = items.select(*PROFILE_KEYS).join(profile, "expr_hash").join(old, "expr_hash", "left").where("_old is null or raw_score >= _old")
    rows.withColumn("seq", F.coalesce("_seq", F.lit(0)) + 1).drop("_old", "_seq").write.mode("append").json(path)


def save_tasks(tasks: DataFrame, path: str | Path) -> None:
    """A task bank as YAML or JSON, by suffix; some thousands of rows."""
    rows = [{k: v for k, v in r.asDict(True).items() if v is not None} for r in tasks.collect()]
    write_config({"metadata": {"num_tasks": len(rows)}, "tasks": rows}, path)


TASKS = "task_id string, seed_id string, split string, expr string, category string, start_date string, end_date string, seed_score double, weight double"


def load_tasks(spark: SparkSession, path: str | Path) -> DataFrame:
    """A saved task bank; a missing category is general, a missing split full."""
    defaults = {"category": "general", "split": "full", "weight": 1.0}
    kinds = dict(c.split() for c in TASKS.split(", "))
    read = lambda t, c: None if (v := t.get(c, defaults.get(c))) is None else float(v) if kinds[c] == "double" else str(v)
    return spark.createDataFrame([tuple(read(t, c) for c in kinds) for t in (read_config(path) or {}).get("tasks", [])], TASKS)


def append_mined(df: DataFrame, path: str, kind: Column, metric: Callable[[str], Column]) -> None:
    """Factors (expr, score, ...) that pass the quality gate, once for each expression; one writer at a time."""
    good = panel.quality_gate(df, kind, metric).withColumn("expr_hash", text.profile_hash(F.col("expr"))).select("expr_hash", "expr", F.col("score").cast("double").alias("score"))
    shaping.fresh(good, read_if_there(df.sparkSession, path, MINED), "expr_hash").write.mode("append").parquet(path)


# -- the same archives as ledgers, for any number of writers


def mined_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, MINED)


def add_mined(ledger: Ledger, df: DataFrame, kind: Column, metric: Callable[[str], Column]) -> str:
    """Factors that pass the quality gate; ``mined`` has each expression once, whoever else adds it."""
    good = panel.quality_gate(df, kind, metric).withColumn("expr_hash", text.profile_hash(F.col("expr"))).select("expr_hash", "expr", F.col("score").cast("double").alias("score"))
    return ledger.add(good.groupBy("expr_hash").agg(F.max(F.struct("score", "expr")).alias("b")).select("expr_hash", "b.expr", "b.score"))


def mined(ledger: Ledger) -> DataFrame:
    return first_of(ledger, "expr_hash")


def profile_ledger(spark: SparkSession, path: str, cells: str) -> Ledger:
    """A ledger of items with profiles: DIRECTION for residual archives, RANKS for behaviour archives."""
    return Ledger(spark, path, _profile_schema(cells))


def add_profiles(ledger: Ledger, items: DataFrame, cells_of: DataFrame, cells: str) -> str:
    """Adds items (PROFILE_KEYS) with their profiles; items without one are left out."""
    names = [c.split()[0] for c in cells.split(", ")]
    profile = cells_of.groupBy("expr_hash").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("profile"))
    return ledger.add(items.select(*PROFILE_KEYS).join(profile, "expr_hash").withColumn("seq", F.lit(0).cast("long")))


def best_profiles(ledger: Ledger, k: int = 128) -> DataFrame:
    """A row for each cell of the k best items; of an expression its best counts, of equal ones the latest."""
    rows = ledger.read("_part").where("coalesce(expr_hash, '') <> ''").withColumn("raw_score", F.coalesce("raw_score", F.lit(-9.0)))
    return shaping.best(rows, k, "expr_hash", seq="_part").select("expr_hash", "raw_score", F.inline("profile"))


def attribute(df: DataFrame, name: str, default: Any, kind: str = "string", extra: str = "extra_info") -> Column:
    """A row's own column, else the field of its extra_info struct, else the default."""
    if name in df.columns:
        return F.col(name).cast(kind)
    nested = name in df.select(f"{extra}.*").columns if extra in df.columns else False
    return F.coalesce(F.col(extra)[name].cast(kind), F.lit(default).cast(kind)) if nested else F.lit(default).cast(kind)
