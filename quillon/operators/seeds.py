"""Candidate expressions: scoring, filters, dedup, quotas, libraries, sampling, and tasks over time splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.ordered import running_sum
from quillon.functions.stats import normal_text
from quillon.operators import panel
from quillon.operators.intervals import within
from quillon.plans.expr import exact_hash, family_hash, validate
from quillon.plans.lower import factors
from quillon.sources.bars import finite_rows
from quillon.sources.scratch import stash

#: Default weights, filters and library sizes.
WEIGHTS = {"reward": 1.0, "robustness": 0.2, "novelty": 0.2, "coverage": 0.1, "complexity": -0.05}
FILTERS = {"min_coverage": 0.6, "min_factor_std": 0.01}
CONTRARIAN = ("direction_acc", 0.49)
ELITE, DIVERSE, CONTRARIANS = 10, 20, 10
#: The time splits used where none are given.
SPLITS = [("q1", "2026-02-23", "2026-03-03", 1.0), ("q2", "2026-03-03", "2026-03-10", 1.0), ("q3", "2026-03-10", "2026-03-18", 1.0), ("q4", "2026-03-18", "2026-03-25", 1.0)]


def with_defaults(df: DataFrame) -> DataFrame:
    """Candidates (idx, id, name, expr, intuition, category) with defaults for what is missing."""
    name = F.coalesce("id", F.format_string("seed_%04d", F.col("idx")))
    return df.select("idx", name.alias("id"), F.coalesce("name", name).alias("name"), "expr", F.coalesce("intuition", F.lit("")).alias("intuition"), F.coalesce("category", F.lit("general")).alias("category"))


_VERDICT = "expr string, valid boolean, status string, reasons array<string>, metrics map<string,double>, canonical_hash string, exact_hash string, family_hash string"


def validate_candidates(rows: DataFrame, **limits) -> DataFrame:
    """rows (id, expr and others) with valid, status, reasons, metrics and the three hashes of their expressions.

    status is static_valid, static_invalid or invalid_syntax, which has no metrics and no canonical hash.  Each distinct text
    is parsed once, in the tasks; no expression passes through the driver.  A null expression is an empty one.
    """
    kinds = {"valid": pa.bool_(), "status": pa.string(), "reasons": pa.list_(pa.string()), "metrics": pa.map_(pa.string(), pa.float64()), "canonical_hash": pa.string(), "exact_hash": pa.string(), "family_hash": pa.string()}

    def judge(text: str) -> tuple:
        v = validate(text, **limits)
        status = "static_valid" if v.valid else "static_invalid" if v.form else "invalid_syntax"
        metrics = list(zip(("expr_nodes", "expr_depth"), map(float, v.form.size), strict=True)) if v.form else []
        return v.valid, status, v.reasons, metrics, v.form.digest if v.form else "", exact_hash(text), family_hash(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[judge(x) for x in batch.column(0).to_pylist()], strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(found, kinds.values(), strict=True)]], ["expr", *kinds])

    text = F.coalesce("expr", F.lit(""))
    verdicts = rows.select(text.alias("expr")).distinct().mapInArrow(run, _VERDICT).withColumnRenamed("expr", "_text")
    return rows.drop(*kinds).join(verdicts, text == F.col("_text")).drop("_text")


def smoke_warmup(minutes: int) -> int:
    """Bars of a symbol before the first that counts, where an expression is tried out."""
    return panel.PANEL_BARS.get(minutes, panel.PANEL_OTHER)


def smoke(bars: DataFrame, expr: str, minutes: int = 5, min_samples: int = 50) -> DataFrame:
    """One expression over all its symbols: (valid, score, direction_acc, coverage, error), with the usual warm-up rows."""
    got = evaluate(bars, [("given", expr)], 1, smoke_warmup(minutes), min_samples, ("id",))
    of = lambda n: F.coalesce(_metric(n), F.lit(0.0)).alias(n)
    error = F.nullif(F.concat_ws(";", "reasons"), F.lit(""))
    return got.select("valid", F.coalesce(_metric("reward"), F.lit(0.0)).alias("score"), of("direction_acc"), of("coverage"), error.alias("error"))


def evaluate(bars: DataFrame, candidates: list[tuple[str, str]], horizon: int = 1, warmup: int = 1, min_samples: int = 50, keys: tuple[str, ...] = ("id", "symbol")) -> DataFrame:
    """(id, symbol, valid, status, reasons, metrics) of each candidate (id, expr) over bars, by direction accuracy.

    All expressions share one shuffle and sort; each has labels of its own, over the rows where it is valid.
    Candidates that do not validate are eval_error in one row without a symbol.
    """
    verdicts = [(key, expr, validate(expr)) for key, expr in candidates]
    good = [(key, expr) for key, expr, v in verdicts if v.valid]
    spark = bars.sparkSession
    bad = spark.createDataFrame([(key, None, False, "eval_error", v.reasons, {}) for key, _, v in verdicts if not v.valid], "id string, symbol string, valid boolean, status string, reasons array<string>, metrics map<string,double>")
    if not good:
        return bad
    wide = panel.skip_warmup(factors(finite_rows(bars), {f"f{i}": expr for i, (_, expr) in enumerate(good)}), warmup)
    ids = F.array(*[F.lit(key) for key, _ in good])
    rows = wide.select("symbol", "ts", "close", F.posexplode(F.array(*[f"f{i}" for i in range(len(good))])).alias("at", "factor"))
    rows = rows.select(F.element_at(ids, F.col("at") + 1).alias("id"), "symbol", "ts", "close", "factor")
    labelled = panel.aligned(panel.series_labels(rows, horizon, keys=("id", "symbol")))
    got = panel.direction_accuracy(labelled, keys, min_samples=min_samples)
    metrics = F.map_concat("metrics", F.create_map(F.lit("reward"), F.col("value")))
    symbol = F.col("symbol") if "symbol" in keys else F.lit(None).cast("string")
    out = got.select("id", symbol.alias("symbol"), "passed", "reason", metrics.alias("metrics"))
    return out.select(
        "id", "symbol", F.col("passed").alias("valid"), F.when(F.col("passed"), "evaluated").otherwise("eval_filtered").alias("status"),
        F.filter(F.array("reason"), lambda x: x != "").alias("reasons"), "metrics",
    ).unionByName(bad)


def sample_pool(df: DataFrame, contrarian: bool = True) -> DataFrame:
    """Rows to sample from: valid ones and, if asked, those that work inverted."""
    return df.where(F.col("valid") | F.col("invert")) if contrarian else df.where("valid")


def _metric(name: str) -> Column:
    return F.try_element_at("metrics", F.lit(name))


def score(df: DataFrame, weights: dict[str, float] = WEIGHTS, filters: dict[str, float] = FILTERS, contrarian: tuple[str, float] = CONTRARIAN) -> DataFrame:
    """Adds seed_score, reasons, valid, status and invert to rows with (valid, metrics map).

    Reasons and inversions found before stay, and a row with any reason is not valid.  A metric that a row lacks counts
    as 0 in the score and passes the filters; complexity is the node count.
    """
    total = F.lit(0.0)
    for m, w in weights.items():
        own = _metric("expr_nodes") if m == "complexity" else F.coalesce(_metric(m), _metric(f"composite/{m}"))
        total = total + F.coalesce(own, F.lit(0.0)) * w
    failed = []
    for f, limit in filters.items():
        side, m = f.split("_", 1)
        bad = _metric(m) < limit if side == "min" else _metric(m) > limit
        failed.append(F.when(bad, F.lit(f"{m}{'<' if side == 'min' else '>'}{limit:g}")))
    before = F.coalesce("reasons", F.array().cast("array<string>")) if "reasons" in df.columns else F.array().cast("array<string>")
    found = F.concat(before, F.array_compact(F.array(*failed))) if failed else before
    out = df.withColumns({"seed_score": total, "reasons": found}).withColumn("valid", F.col("valid") & (F.size("reasons") == 0))
    status = F.when(~F.col("valid"), "filtered").when(F.col("seed_score") > 0, "elite_candidate").otherwise("valid_low_score")
    invert = F.coalesce(_metric(contrarian[0]) < contrarian[1], F.lit(False))
    return out.withColumns({"status": status, "invert": invert | F.coalesce("invert", F.lit(False)) if "invert" in df.columns else invert})


KEPT, COPY, QUOTA = "kept", "duplicate_ast", "duplicate_category_quota"
#: The reason that a status leaves on a row.
_WHY = {COPY: "duplicate_ast", QUOTA: "category_quota"}


def dedup(df: DataFrame, quota: int | None = None, sort_by: str = "seed_score", by_hash: bool = True) -> DataFrame:
    """Adds dup_status to rows with idx (unique): kept, duplicate_ast or duplicate_category_quota; NULL for rows that were not valid.

    Valid rows are taken in the order of ``sort_by`` (a column, else a metric where a row has it, else the score), then idx.  One
    whose hash a kept row has is a copy (an empty hash never repeats; none does without by_hash), else one whose category
    already has ``quota`` kept rows is beyond it; it does not stand in the way of later copies.  Copies and rows beyond the quota
    are no longer valid: status and reasons say why, where df has these columns.
    """
    first = F.col(sort_by) if sort_by in df.columns else F.coalesce(_metric(sort_by), F.col("seed_score"))
    has = (F.coalesce(F.col("canonical_hash"), F.lit("")) != "") & F.lit(by_hash)
    part = F.coalesce("valid", F.lit(False))
    # rows without a hash are dealt out by idx, so they make no hot group; the least place comes first
    place = F.struct(F.coalesce(-first, F.lit(float("inf"))).alias("score"), F.col("idx").alias("idx"))
    rows = df.withColumns({
        "_hash": F.when(has, F.col("canonical_hash")).otherwise(F.concat(F.lit("#"), F.col("idx"))), "_family": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")), "_place": place,
    })
    narrow = rows.where(part).select("_hash", "_family", "_place")
    kept = narrow.groupBy("_hash").agg(F.min("_place").alias("_kept")) if quota is None else _quota(narrow, quota)
    rows = rows.join(kept, "_hash", "left")
    status = F.when(F.col("_kept") == F.col("_place"), KEPT).when(F.col("_kept") < F.col("_place"), COPY).otherwise(QUOTA)
    rows = rows.withColumn("dup_status", F.when(part, status))
    gone = F.coalesce(F.col("dup_status") != KEPT, F.lit(False))
    changed = {"valid": part & ~gone}
    if "status" in df.columns:
        changed["status"] = F.when(gone, F.col("dup_status")).otherwise(F.col("status"))
    if "reasons" in df.columns:
        why = F.create_map(*[F.lit(x) for pair in _WHY.items() for x in pair])
        changed["reasons"] = F.when(gone, F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(why[F.col("dup_status")]))).otherwise(F.col("reasons"))
    return rows.withColumns(changed).select(*df.columns, "dup_status")


def _quota(rows: DataFrame, quota: int) -> DataFrame:
    """(_hash, _kept): the place of the row that is kept of each hash, of rows (_hash, _family, _place).

    Of a hash and family only the first row can be kept, so the others go at once.  Then in rounds: an open row is kept if it is the
    first of its hash and, of its family, among as many as there is room for; rows of its hash and of full families are
    settled with it.  The first open row of all always is kept, and in general a share of the rest, so rounds are few; each reads
    and writes only what is still open.  A family is cut to the quota before it is shuffled, so a large one is no large group.
    """
    open_ = stash(rows.groupBy("_hash", "_family").agg(F.min("_place").alias("_place")), "open")
    done: list[DataFrame] = []
    number = F.row_number().over(Window.partitionBy("_family").orderBy("_place"))
    while quota > 0 and not open_.isEmpty():
        first = open_.groupBy("_hash").agg(F.min("_place").alias("_first"))
        room = F.lit(quota)
        near = open_.withColumn("_n", number).where(F.col("_n") <= quota)
        if done:
            full = _every(done).groupBy("_family").agg(F.count("*").alias("_full"))
            near = near.join(full, "_family", "left")
            room = quota - F.coalesce("_full", F.lit(0))
        new = stash(near.where(F.col("_n") <= room).join(first, "_hash").where("_first = _place").select("_hash", "_family", F.col("_place").alias("_kept")), "kept")
        done.append(new)
        full = _every(done).groupBy("_family").agg(F.count("*").alias("_full")).where(F.col("_full") >= quota).select("_family")
        open_ = stash(open_.join(new.select("_hash"), "_hash", "left_anti").join(full, "_family", "left_anti"), "open")
    return _every(done).select("_hash", "_kept") if done else rows.limit(0).select("_hash", F.col("_place").alias("_kept"))


def _every(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def library(df: DataFrame, elite: int = ELITE, diverse: int = DIVERSE, contrarians: int = CONTRARIANS, least: float = 0.0) -> DataFrame:
    """Adds the flags elite, diverse, contrarian and rejected to deduplicated rows; flags may overlap.

    Only rows that are valid and kept are taken, the best first: elite of those with a score of at least ``least``,
    diverse of all, contrarian of those that work inverted.  All others are rejected.
    """
    kept = df.where(F.col("valid") & (F.col("dup_status") == KEPT))
    out = df
    for name, rows, n in (("elite", kept.where(F.col("seed_score") >= least), elite), ("diverse", kept, diverse), ("contrarian", kept.where("invert"), contrarians)):
        best = rows.orderBy(F.desc("seed_score"), F.asc("idx")).limit(n).select("idx", F.lit(True).alias(name))
        out = out.join(F.broadcast(best), "idx", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("rejected", ~(F.col("elite") | F.col("diverse") | F.col("contrarian"))).select(*df.columns, "elite", "diverse", "contrarian", "rejected")


def softmax_sample(pool: DataFrame, k: int, temperature: float = 1.0, explore: float = 0.2, seed: int = 0) -> DataFrame:
    """k draws with replacement, in proportion to exp(score / temperature): (draw, id).  Each is from the explorers (not elite
    candidates) with probability ``explore``, else from the elite candidates; an empty part falls back to the whole pool.

    Every row of the pool is an interval as long as its weight, by running sums; a draw is a point, joined with
    the interval that holds it.  The work is that of k + pool rows.  A row without a score is never drawn.
    """
    spark, t = pool.sparkSession, max(temperature, 1e-6)
    elite = F.coalesce(F.col("status") == "elite_candidate", F.lit(False))
    rows = stash(pool.select("id", F.col("seed_score").alias("s"), elite.alias("elite")).where("s is not null and not isnan(s)"), "pool")
    found = {r.elite: (r.n, r.top) for r in rows.groupBy("elite").agg(F.count("*").alias("n"), F.max("s").alias("top")).collect()}
    if not found or k <= 0:
        return pool.select(F.lit(0).cast("int").alias("draw"), "id").limit(0)
    uniform = lambda *cols: (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)
    draws = spark.range(k).select(F.col("id").cast("int").alias("draw"), (uniform(F.col("id"), F.lit(seed)) >= explore).alias("wants"), uniform(F.col("id"), F.lit(seed), F.lit("place")).alias("u"))
    out = []
    for wants in (False, True):
        part, own = (rows.where(F.col("elite") == wants), [found[wants]]) if wants in found else (rows, list(found.values()))
        n, top = sum(m for m, _ in own), max(v for _, v in own)
        # weights as whole numbers, so that the intervals meet exactly: the best row has 2^62 / n, all together fit a long
        weight = F.floor(F.exp((F.col("s") - F.lit(float(top))) / t) * float((1 << 62) // n) + 0.5).cast("long")
        ends = stash(running_sum(part.select("id", weight.alias("w")).where("w > 0"), "w", [F.asc("id"), F.asc("w")], "begin"), "ends")
        total = ends.agg(F.max(F.col("begin") + F.col("w"))).first()[0]
        point = F.least(F.floor(F.col("u") * float(total)).cast("long"), F.lit(total - 1))
        # a bin for each row on average: an interval touches about two
        out.append(within(draws.where(F.col("wants") == wants), point, ends, F.col("begin"), F.col("begin") + F.col("w"), total / n, closed=False).select("draw", "id"))
    return out[0].union(out[1])


def stratified_sample(tasks: DataFrame, n: int, family: str = "category", seed: int = 0) -> DataFrame:
    """n draws with replacement: rounds over the families, shuffled anew in each, with one task of the family each.

    No rows for an empty table.  A missing family is ``general``.
    """
    rows = tasks.withColumn("_family", F.coalesce(F.nullif(F.col(family), F.lit("")), F.lit("general")))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_family").orderBy("task_id")) - 1)
    sizes = rows.groupBy("_family").agg(F.count("*").alias("_size"))
    families = sizes.count()
    if not families or n <= 0:
        return tasks.limit(0)
    # one row for each family and round: n rows, and the rest of the last round
    rounds = tasks.sparkSession.range(-(-n // families)).withColumnRenamed("id", "_round")
    turn = Window.partitionBy("_round").orderBy(F.xxhash64("_family", "_round", F.lit(seed)))
    draws = rounds.join(F.broadcast(sizes)).withColumn("draw", F.col("_round") * families + F.row_number().over(turn) - 1).where(F.col("draw") < n)
    draws = draws.select("_family", "draw", F.pmod(F.xxhash64("draw", F.lit(seed + 1)), "_size").alias("_place"))
    return rows.join(draws, ["_family", "_place"]).orderBy(F.xxhash64("draw", F.lit(seed + 2))).select(*tasks.columns)


def cycle_tasks(spark: SparkSession, splits: DataFrame, n: int, family: str = "no_seed") -> DataFrame:
    """n tasks without a candidate, one split after another in the order of their names."""
    s = splits.select(F.col("name").alias("split"), "start_date", "end_date", (F.row_number().over(Window.orderBy("name")) - 1).alias("_at"))
    k = splits.count()
    rows = spark.range(n).withColumn("_at", F.pmod("id", F.lit(max(1, k))))
    return rows.join(F.broadcast(s), "_at").select(F.concat_ws("__", F.lit(family), "split", "id").alias("task_id"), F.lit("").alias("seed_id"), "split", F.lit("").alias("expr"), F.lit(family).alias("category"), "start_date", "end_date")


def task_bank(seeds: DataFrame, splits: DataFrame, max_seeds: int = 64, valid_only: bool = True, sort_by: str = "seed_score") -> DataFrame:
    """Seeds times splits, after dedup by hash (else by text) and a cut to the best; splits are a handful of rows."""
    rows = seeds.where("valid") if valid_only else seeds
    key = F.coalesce(F.nullif(F.col("canonical_hash"), F.lit("")), normal_text("expr"))
    # another metric than the score orders by it where a row has it
    first = F.col("seed_score") if sort_by == "seed_score" else F.coalesce(_metric(sort_by), F.col("seed_score"))
    order = [F.desc(first), F.asc("idx")]
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").orderBy(*order).limit(max_seeds)
    joined = best.join(F.broadcast(splits.withColumnRenamed("name", "split")))
    return joined.select(F.concat_ws("__", "id", "split").alias("task_id"), F.col("id").alias("seed_id"), "split", "expr", "category", "start_date", "end_date", "seed_score", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def in_splits(df: DataFrame, splits: DataFrame, order: str = "ts") -> DataFrame:
    """Rows with each split whose inclusive range holds them; a shared boundary belongs to both.  Any number of splits, long or short."""
    s = splits.select(F.col("name").alias("split"), *[F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")).alias(n) for c, n in (("start_date", "_from"), ("end_date", "_to"))])
    return within(df, F.unix_micros(F.col(order).cast("timestamp")), s, F.col("_from"), F.col("_to")).drop("_from", "_to")


#: The modes of a prompt: whether a seed is needed, and what the user's message holds before and after the task's context.
MODES: dict[str, tuple[bool, str, str]] = {
    "seeded_ocd": (True, "Improve the seed expression below; change its structure, windows, normalisation or direction.", "Seed expression:\n<expr>{expr}</expr>\nAnswer with one <expr>...</expr> only."),
    "ocd": (False, "Design a new expression from the operators.", "Answer with one <expr>...</expr> only."),
    "seed_only": (True, "Repeat this expression.", "<expr>{expr}</expr>"),
    "free_code": (False, "Write a factor as code.", "Answer with one <code>...</code> only."),
}
CONTEXT = ("category", "split", "start_date", "end_date", "scenario", "hint")


def prompts(tasks: DataFrame, mode: str, system: str, source: str = "factor_tasks", modes: dict[str, tuple[bool, str, str]] = MODES) -> DataFrame:
    """Prompt rows of a mode; the user's message names what a task says of itself.

    Modes that need a seed leave out tasks without an expression.
    """
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(modes)}")
    seeded, before, after = modes[mode]
    rows = tasks.where("coalesce(expr, '') <> ''") if seeded else tasks
    said = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in CONTEXT if c in tasks.columns]
    known = F.concat_ws("\n", *said) if said else F.lit("")
    user = F.concat_ws("\n", F.lit(before), F.nullif(known, F.lit("")), F.replace(F.lit(after), F.lit("{expr}"), F.coalesce("expr", F.lit(""))))
    return _rows(rows, F.lit(system), user, source)


def _rows(tasks: DataFrame, system: Column, user: Column, source: str) -> DataFrame:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return tasks.select(
        F.concat_ws("/", F.lit(source), "category", "split").alias("data_source"), F.array(message("system", system), message("user", user)).alias("prompt"),
        F.struct(F.array().cast("array<string>").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct("task_id", "seed_id", F.col("expr").alias("seed_expr"), "split", "start_date", "end_date", "category").alias("extra_info"),
    )


def prompt_rows(tasks: DataFrame, system: str, template: str, source: str = "factor_tasks") -> DataFrame:
    """Nested training rows; template has {expr}, {split}, {start_date} and {end_date}."""
    user = F.lit(template)
    for f in ("expr", "split", "start_date", "end_date"):
        user = F.replace(user, F.lit("{" + f + "}"), F.col(f).cast("string"))
    return _rows(tasks, F.lit(system), user, source)
