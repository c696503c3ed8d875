"""A batch of answers from text to shaped reward: expressions, jobs, evaluation, archives, shaping.

Expressions are parsed, checked and hashed in tasks.  Jobs pass through the driver a shard of ``SHARD`` expressions at a time, since expressions
are lowered there; a shard's results are stored before the next, so neither the plan nor the driver grows with the
batch.  Bars and profiles never pass through it.  All bar sizes come from one scan (``bars.lattice``), each job is
scored on its own, and the expressions of a shard share one shuffle and sort of the bars of a size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import panel, seeds, shaping, text
from quillon.plans.expr import validate
from quillon.plans.lower import factors
from quillon.sources.bars import between, finite_rows, lattice, load_start
from quillon.sources.scratch import scratch_path, stash

JOBS = "job long, expr string, start_date string, end_date string, bar_minutes int, horizon int"
#: Expressions that are lowered into one plan.
SHARD = 100
#: The kind of reward that compares symbols at a time; all others are rewards of ``panel`` for single assets.
CROSS = "cross_sectional_rankic"
_SIGNS = "expr_hash string, symbol string, ts timestamp_ntz, pred tinyint, label tinyint, mask boolean, correct boolean"
_RANKS = "expr_hash string, ts timestamp_ntz, symbol string, rank_pct double"


@dataclass
class Batch:
    """rows: answers with expr, raw, every shift and reward; scored: jobs with raw; profiles: (expr_hash = job, symbol, ts, ...)."""

    rows: DataFrame
    scored: DataFrame
    profiles: DataFrame

    def good_profiles(self, least: float) -> tuple[DataFrame, DataFrame]:
        """(items, cells) for an archive: the expressions of jobs with at least that score, under their hash, the best job of each."""
        best = self.scored.where(F.col("raw") >= least).groupBy("expr").agg(F.max_by(F.struct("job", "start_date", "end_date", "raw"), F.struct("raw", -F.col("job"))).alias("b"))
        items = best.select(text.profile_hash(F.col("expr")).alias("expr_hash"), "expr", F.col("b.raw").alias("raw_score"), F.lit("").alias("task_id"), "b.start_date", "b.end_date", F.col("b.job").cast("string").alias("job"))
        cells = self.profiles.withColumnRenamed("expr_hash", "job").join(items.select("job", "expr_hash"), "job").drop("job")
        return items, cells


def job_window(kind: str, minutes: Column, start: Column, warmup: int | None = None) -> tuple[Column, Column]:
    """(time to load from, number of the first bar kept among those loaded) of a job.

    Single assets: a factor counts from the end of its warm-up on, and the day ladder counts from there.  Panels have a fixed
    number of days and the warm-up of the series evaluator.  warmup: that many bars of the whole history instead.
    """
    if warmup is not None:
        return F.lit("0001-01-01").cast("timestamp_ntz"), F.lit(warmup)
    if kind == CROSS:
        bars, days = F.lit(panel.PANEL_OTHER), F.lit(panel.PANEL_DAYS)
        for size, n in panel.PANEL_BARS.items():
            bars = F.when(minutes == size, n).otherwise(bars)
        first = bars
    else:
        bars = panel.warmup_bars(minutes)
        days = panel.warmup_days(minutes, bars)
        first = bars - 1 + panel.backtest_warmup(minutes, days)
    return F.date_sub(start.cast("date"), days + panel.BUFFER_DAYS).cast("timestamp_ntz"), first


def job_rows(grids: dict[int, DataFrame], jobs: list, kind: str, warmup: int | None) -> DataFrame:
    """(job, symbol, ts, start, close, factor, n, first, horizon) of every job: the bars it loads, numbered within a symbol."""
    parts = []
    for minutes, bars in grids.items():
        own = [r for r in jobs if r.bar_minutes == minutes]
        if not own:
            continue
        names = {e: f"f{i}" for i, e in enumerate(sorted({r.expr for r in own}))}
        at = {e: i for i, e in enumerate(names)}
        wide = factors(finite_rows(bars), {n: e for e, n in names.items()})
        known = bars.sparkSession.createDataFrame([(r.job, at[r.expr], r.start_date, r.end_date, r.bar_minutes, max(1, r.horizon)) for r in own], "job long, at int, start_date string, end_date string, bar_minutes int, horizon int")
        load, first = job_window(kind, F.col("bar_minutes"), F.col("start_date"), warmup)
        known = known.select("job", "at", "horizon", F.col("start_date").cast("timestamp_ntz").alias("start"), F.col("end_date").cast("timestamp_ntz").alias("end"), load.alias("load"), first.cast("int").alias("first"))
        long = wide.select("symbol", "ts", "close", F.posexplode(F.array(*names.values())).alias("at", "factor"))
        parts.append(long.join(F.broadcast(known), "at").where((F.col("ts") >= F.col("load")) & (F.col("ts") <= F.col("end"))))  # a row a job
    every = reduce(DataFrame.unionByName, parts)
    number = F.row_number().over(Window.partitionBy("job", "symbol").orderBy("ts"))
    return every.withColumn("n", number).select("job", "symbol", "ts", "start", "close", "factor", "n", "first", "horizon")


def single_asset(rows: DataFrame, expr: str, start: str, end: str, minutes: int, min_period: int = 48, warmup_days: int = 10, **grid) -> DataFrame:
    """(symbol, ts, factor, close) of one expression over a range: what a bar-by-bar backtest of each symbol would record.

    It loads warmup_days and the buffer before the start, begins when min_period bars are there, passes over as many bars as
    the warm-up has (``panel.backtest_warmup``), and keeps rows with a finite factor and a positive close from the start on.
    """
    bars = lattice(rows, [minutes], **grid)[minutes]
    bars = between(finite_rows(bars), F.col("ts"), load_start(start, warmup_days, panel.BUFFER_DAYS), end)
    first = min_period - 1 + panel.backtest_warmup(minutes, warmup_days)
    kept = panel.skip_warmup(factors(bars, {"factor": expr}), first)
    return panel.valid_scores(panel.after_start(kept, start)).select("symbol", "ts", "factor", "close")


def try_out(rows: DataFrame, expr: str, start: str, end: str, minutes: int = 5, kind: str = "direction", horizon: int | None = None, **options) -> DataFrame:
    """One expression over a range, in one row: (valid, score, direction_acc, coverage, error).

    direction: what a backtest of each symbol records, with its warm-up, by the direction of the next bar.  CROSS: the score of the
    panel, horizon 6 unless given.  An expression that does not validate has its first reason as the error.
    """
    spark, none = rows.sparkSession, "valid boolean, score double, direction_acc double, coverage double, error string"
    reasons = validate(expr).reasons
    if reasons:
        return spark.createDataFrame([(False, 0.0, 0.0, 0.0, reasons[0])], none)
    if kind == CROSS:
        job = spark.createDataFrame([(0, expr, start, end, minutes, horizon or 6)], JOBS)
        raw = F.col("raw")
        return score_jobs(rows, job, CROSS, **options)[0].select((raw > panel.FAIL).alias("valid"), raw.alias("score"), F.lit(0.0).alias("direction_acc"), F.lit(0.0).alias("coverage"), F.when(raw <= panel.FAIL, "no score").alias("error"))
    kept = single_asset(rows, expr, start, end, minutes, seeds.smoke_warmup(minutes), **options)
    got = panel.direction_accuracy(panel.aligned(panel.series_labels(kept, horizon or 1)))
    of = lambda name: F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0)).alias(name)
    return got.select(F.col("passed").alias("valid"), F.col("value").alias("score"), of("direction_acc"), of("coverage"), F.nullif("reason", F.lit("")).alias("error"))


def _with_returns(rows: DataFrame, jobs: list) -> DataFrame:
    fwd = F.lit(None).cast("double")
    for h in sorted({max(1, r.horizon) for r in jobs}):
        fwd = F.when(F.col("horizon") == h, panel.forward_return(h, keys=("job", "symbol"))).otherwise(fwd)
    return rows.withColumn("fwd", fwd)


def score_jobs(rows: DataFrame, jobs: DataFrame, kind: str = "direction", warmup: int | None = None, min_symbols: int = 8, min_times: int = 20, **grid) -> tuple[DataFrame, DataFrame]:
    """(jobs with raw, profiles) of jobs (JOBS) over rows, by a kind of reward: direction, a reward of ``panel`` or CROSS.

    rows are bars or trades of any grain up to the finest bar; every job is scored on bars of its own size (grid: ``closed``,
    ``origin``, ``tie`` of ``bars.lattice``).  A job loads its warm-up before its start (``job_window``); windows may begin before
    that, labels do not reach beyond its end.  An expression that does not validate, like a job without rows, has raw -1; an
    unknown kind is an error.  Profiles are signs, for CROSS percentile ranks.
    """
    if kind != CROSS and {"direction": "direction_accuracy"}.get(kind, kind) not in panel.REWARDS:
        raise ValueError(f"unknown reward kind {kind!r}; known: {sorted(['direction', CROSS, *panel.REWARDS])}")
    spark = rows.sparkSession
    jobs = stash(jobs, "jobs")
    valid = seeds.validate_candidates(jobs.select("expr").distinct()).where("valid").select("expr")
    able = stash(jobs.join(valid, "expr").select(*[c.split()[0] for c in JOBS.split(", ")]), "able")
    grids = lattice(rows, [r.bar_minutes for r in able.select("bar_minutes").distinct().collect()], **grid)
    places = [scratch_path(spark, x) for x in ("scores", "profiles")]
    kinds = ("job long, raw double", _RANKS if kind == CROSS else _SIGNS)
    for path, schema in zip(places, kinds, strict=True):
        spark.createDataFrame([], schema).write.parquet(path)
    for shard in _shards(able):
        for df, path in zip(_score_shard(grids, shard, kind, warmup, min_symbols, min_times), places, strict=True):
            df.write.mode("append").parquet(path)
    raw, profiles = (spark.read.schema(schema).parquet(path) for path, schema in zip(places, kinds, strict=True))
    return jobs.join(raw, "job", "left").withColumn("raw", F.coalesce("raw", F.lit(-1.0))), profiles


def _shards(jobs: DataFrame) -> Iterator[list]:
    """Jobs of at most SHARD expressions at a time, as they come from the executors partition by partition."""
    held, names = [], set()
    for r in jobs.orderBy("expr", "job").toLocalIterator():
        if r.expr not in names and len(names) == SHARD:
            yield held
            held, names = [], set()
        held.append(r)
        names.add(r.expr)
    if held:
        yield held


def _score_shard(grids: dict[int, DataFrame], found: list, kind: str, warmup: int | None, min_symbols: int, min_times: int) -> tuple[DataFrame, DataFrame]:
    every = job_rows(grids, found, kind, warmup)
    kept = (F.col("n") >= F.col("first")) & (F.col("ts") >= F.col("start"))
    if kind == CROSS:
        # returns over all bars, then the rows from the warm-up and the start on
        own = _with_returns(every, found).where(kept)
        symbols = own.groupBy("job").agg(F.count_distinct("symbol").alias("symbols"))
        cross = panel.cross_section(own, ("job", "ts"), min_symbols).join(F.broadcast(symbols), "job")  # a row a job of the shard
        raw = panel.summarise(cross, F.col("symbols"), ("job",), min_times, min_symbols).select("job", F.col("score").alias("raw"))
        return raw, panel.percentile_ranks(own, ("job", "ts"), min_symbols).select(F.col("job").cast("string").alias("expr_hash"), "ts", "symbol", "rank_pct")
    name, least, _ = panel.single_asset_reward(kind)
    own = _with_returns(panel.valid_scores(every.where(kept)), found)
    got = panel.reward(name)(own, ("job",), min_samples=least)
    raw = got.select("job", panel.raw_reward(kind, F.col("value"), F.col("passed")).alias("raw"))
    return raw, panel.direction_signs(panel.aligned(own).withColumn("expr_hash", F.col("job").cast("string")), "expr_hash")


def score_answers(
    answers: DataFrame, rows: DataFrame, exact: DataFrame, family: DataFrame, kind: str = "direction", relative: bool = False, diversity: bool = True, residual: DataFrame | None = None,
    behaviour: DataFrame | None = None, **options,
) -> Batch:
    """Shaped rewards of answers (id, text, seed_expr, start_date, end_date, bar_minutes, horizon).

    exact, family: counts (hash, count) before the batch; residual: cells of archived direction profiles; behaviour: cells of archived
    rank profiles, for CROSS.  Options are those of ``score_jobs``.  An answer without an expression, or with one that
    cannot be evaluated, has -1.
    """
    if (residual is not None and kind == CROSS) or (behaviour is not None and kind != CROSS):
        raise ValueError("archived profiles must be of the kind of the reward")
    out = answers.withColumn("expr", F.coalesce(text.expression(F.col("text")), F.lit("")))
    given = shaping.jobs(out, relative).select("expr", F.col("start_date").cast("string"), F.col("end_date").cast("string"), F.col("bar_minutes").cast("int"), F.col("horizon").cast("int"))
    jobs = stash(given.select(F.xxhash64(*shaping.JOB).alias("job"), *shaping.JOB), "jobs")
    scored, profiles = score_jobs(rows, jobs, kind, **options)
    families = seeds.validate_candidates(jobs.select("expr").distinct()).select("expr", F.col("family_hash").alias("family"))
    out = shaping.with_scores(out, scored, relative).join(families, "expr", "left").withColumn("hash", text.exact_hash(F.col("expr")))
    out = shaping.with_counts(out, exact, "exact_seen")
    out = shaping.with_counts(out, family.withColumnRenamed("hash", "family"), "family_seen", "family")
    stats = None
    if residual is not None:
        stats = shaping.residual_score(profiles, residual).join(shaping.max_behaviour_corr(profiles, residual), "expr_hash", "full")
    if behaviour is not None:
        stats = shaping.rank_behaviour_corr(profiles, behaviour).select("expr_hash", F.col("max_corr").alias("rank_max_corr"), F.col("samples").alias("rank_samples"))
    if stats is not None:
        of_job = scored.select(*shaping.JOB, F.col("job").cast("string").alias("expr_hash")).join(stats, "expr_hash").drop("expr_hash")
        out = out.join(of_job, list(shaping.JOB), "left")
    return Batch(shaping.shape(out, relative, diversity=diversity, residual=residual is not None, behaviour=behaviour is not None), scored, profiles)
