"""Archives of what was seen, and rewards shaped by novelty, family, residual skill and behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stats import clip
from quillon.operators import gram


def read_counts(spark: SparkSession, path: str, key: str = "hash") -> DataFrame:
    """(key, count) of an append-only JSON archive; malformed lines are skipped, the highest count of a key holds."""
    rows = spark.read.schema(f"{key} string, count long").option("mode", "DROPMALFORMED").json(path)
    return counts(rows, key)


def counts(rows: DataFrame, key: str = "hash") -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("count").isNotNull()).groupBy(key).agg(F.max("count").alias("count"))


def record(batch: DataFrame, archive: DataFrame, key: str = "hash") -> DataFrame:
    """New archive rows after a batch: one more for each occurrence of a non-empty key."""
    seen = batch.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))
    return seen.join(archive, key, "left").select(key, (F.coalesce("count", F.lit(0)) + F.col("n")).alias("count"))


def best(rows: DataFrame, k: int = 128, key: str = "hash", score: str = "raw_score", seq: str = "seq") -> DataFrame:
    """The best row of each key, then the k best: archives with a fixed size."""
    own = Window.partitionBy(key).orderBy(F.desc(score), F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r").orderBy(F.desc(score), key).limit(k)


def fresh(rows: DataFrame, existing: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose key is new, one each: an exactly-once sink's input."""
    return rows.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def with_counts(df: DataFrame, archive: DataFrame, name: str, key: str = "hash") -> DataFrame:
    """Adds the count before this batch, 0 if unseen."""
    return df.join(archive.select(key, F.col("count").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


#: The defaults of the bonuses, penalties and thresholds of the functions below.


def relative(raw: Column, base: Column, bonus: float = 0.5, under: float = 0.0) -> Column:
    delta = raw - base
    return raw + bonus * F.greatest(delta, F.lit(0.0)) - under * F.greatest(-delta, F.lit(0.0))


def repeat_penalty(seen: Column, diversity: bool = False, novelty: float = 0.25, exact: float = 0.15) -> Column:
    return F.when(seen > 0, F.lit(exact if diversity else novelty)).otherwise(0.0)


def family_shift(raw: Column, seen: Column, quota: int = 8, low: float = 0.08, penalty: float = 0.02, good: float = 0.10, bonus: float = 0.02) -> Column:
    return F.when((seen == 0) & (raw >= good), bonus).when((seen > quota) & (raw < low), -penalty).otherwise(0.0)


def max_behaviour_corr(profile: DataFrame, archive: DataFrame, least: int = 20) -> DataFrame:
    """(expr_hash, max_corr): largest absolute correlation of predictions with an archived item over shared times."""
    side = lambda df: df.where("ts is not null").select(F.col("expr_hash").alias("item"), "ts", F.col("pred").cast("double").alias("v")).where("item is not null and v is not null")
    n, sx, sy, sxx, syy, sxy = (F.col(x) for x in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    sums = gram.product_sums(side(profile), side(archive))
    dev = lambda q, s: F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))
    a, b = dev(sxx, sx), dev(syy, sy)
    r = F.when((a > 1e-8) & (b > 1e-8), F.abs((sxy / n - (sx / n) * (sy / n)) / (a * b)))
    return sums.where(n >= least).groupBy("expr_hash").agg(F.coalesce(F.max(r), F.lit(0.0)).alias("max_corr"))


def residual_score(profile: DataFrame, archive: DataFrame) -> DataFrame:
    """(expr_hash, samples, residual): accuracy where the archive's majority vote is wrong."""
    vote = archive.where("mask").groupBy("ts").agg(F.signum(F.sum(F.col("pred").cast("long")).cast("double")).alias("vote")).where("vote <> 0")
    rows = profile.where("mask").join(vote, "ts").where("vote <> cast(label as double)")
    return rows.groupBy("expr_hash").agg(F.count("*").alias("samples"), ((F.avg(F.col("correct").cast("double")) - 0.5) * 200).alias("residual"))


def residual_shift(raw: Column, residual: Column, samples: Column, max_corr: Column, good: float = 0.16, bonus: float = 0.04, penalty: float = 0.03, above: float = 0.92, least: int = 200) -> Column:
    up = F.when((raw >= good) & (samples >= least), bonus * F.least(F.lit(1.0), F.greatest(F.lit(0.0), residual / 10))).otherwise(0.0)
    return up - F.when(max_corr > above, penalty * (max_corr - above)).otherwise(0.0)


def rank_behaviour_corr(profile: DataFrame, archive: DataFrame, least_times: int = 200, least_symbols: int = 4) -> DataFrame:
    """(expr_hash, max_corr, mean_corr, samples) of percentile-rank rows (expr_hash, ts, symbol, rank_pct).

    Both sides are cut to the symbols that they share, centred and scaled per time on their own finite cells, then
    multiplied cell by cell; an item counts if enough times are shared.  The names of each item's symbols pass through the driver.
    """
    side = lambda df: df.select(F.col("expr_hash").alias("item"), "ts", "symbol", F.col("rank_pct").alias("v")).where("item is not null and ts is not null and symbol is not null and v is not null")
    a, b = side(profile), side(archive)
    # items times symbols: the names that an item has at all
    names = a.select(F.lit(0).alias("s"), "item", "symbol").union(b.select(F.lit(1), "item", "symbol")).groupBy("s", "item").agg(F.collect_set("symbol").alias("symbols"))
    symbols = {f"{r.s}{r['item']}": set(r.symbols) for r in names.collect()}
    items = gram.unit_products(a, b, symbols, least_symbols).where(F.col("n") >= least_times).withColumn("c", F.col("c") / F.col("n"))
    return items.groupBy("expr_hash").agg(F.max("c").alias("max_corr"), F.avg("c").alias("mean_corr"), F.max("n").cast("long").alias("samples"))


def behaviour_shift(raw: Column, max_corr: Column, samples: Column, good: float = 0.12, penalty: float = 0.08, above: float = 0.85, bonus: float = 0.02, below: float = 0.5, least: int = 200) -> Column:
    down = F.when((samples >= least) & (max_corr > above), -penalty * (max_corr - above))
    return F.when(raw >= good, down.when((samples > 0) & (max_corr < below), bonus).otherwise(0.0)).otherwise(0.0)


def final(raw: Column, shift: Column) -> Column:
    """The shaped reward in [-1, 1]; failures stay -1."""
    return F.when(raw > -1, F.coalesce(clip(raw + shift, -1, 1), F.lit(-1.0))).otherwise(-1.0)


def score_batch(candidates: DataFrame, jobs: DataFrame, exact: DataFrame, family: DataFrame, **options) -> DataFrame:
    """Rewards of a batch: (id, hash, family, job) with job scores (job, raw), against the archives before the batch.

    Candidates without a job score fail with -1.  Repeats within the batch do not count against each other.
    """
    rows = candidates.join(jobs.select("job", "raw"), "job", "left").withColumn("raw", F.coalesce("raw", F.lit(-1.0)))
    rows = with_counts(rows, exact, "exact_seen")
    rows = with_counts(rows, family.withColumnRenamed("hash", "family"), "family_seen", "family")
    shift = family_shift(F.col("raw"), F.col("family_seen")) - repeat_penalty(F.col("exact_seen"), **options)
    return rows.withColumns({"shift": shift, "reward": final(F.col("raw"), shift)})


JOB = ("expr", "start_date", "end_date", "bar_minutes", "horizon")


def jobs(batch: DataFrame, relative_reward: bool = False) -> DataFrame:
    """Each evaluation that a batch needs, once: of its expressions and, for relative rewards, of their seeds."""
    own = batch.select(*JOB)
    if relative_reward:
        own = own.union(batch.select(F.col("seed_expr").alias("expr"), *JOB[1:]))
    return own.where("coalesce(expr, '') <> ''").distinct()


def with_scores(batch: DataFrame, scored: DataFrame, relative_reward: bool = False) -> DataFrame:
    """Adds raw (-1 if the expression was not scored) and baseline (the seed's score on the same window, else 0)."""
    out = batch.join(scored.select(*JOB, "raw"), list(JOB), "left").withColumn("raw", F.coalesce("raw", F.lit(-1.0)))
    if not relative_reward:
        return out.withColumn("baseline", F.lit(0.0))
    seed = scored.select(F.col("expr").alias("seed_expr"), *JOB[1:], F.col("raw").alias("baseline"))
    # a row without a seed has no baseline, so it is left as it is
    return out.join(seed, ["seed_expr", *JOB[1:]], "left").withColumn("baseline", F.when(F.coalesce("seed_expr", F.lit("")) == "", F.col("raw")).otherwise(F.coalesce("baseline", F.lit(0.0))))


def shape(rows: DataFrame, relative_reward: bool = False, exact: bool = True, diversity: bool = False, residual: bool = False, behaviour: bool = False) -> DataFrame:
    """Adds every shift and the reward to rows with raw and, for what is asked, their statistics.

    relative_reward: baseline; exact: exact_seen; diversity: family_seen; residual: residual, samples, max_corr; behaviour:
    rank_max_corr, rank_samples.  Missing statistics count as 0.  Thresholds look at raw; failures stay -1.
    """
    raw, of = F.col("raw"), lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    none = F.lit(0.0)
    out = rows.withColumns({
        "relative_shift": relative(raw, F.col("baseline")) - raw if relative_reward else none,
        "exact_penalty": repeat_penalty(of("exact_seen"), diversity) if exact else none,
        "family_shift": family_shift(raw, of("family_seen")) if diversity else none,
        "residual_shift": residual_shift(raw, of("residual"), of("samples"), of("max_corr")) if residual else none,
        "behaviour_shift": behaviour_shift(raw, of("rank_max_corr"), of("rank_samples")) if behaviour else none,
    })
    total = F.col("relative_shift") - F.col("exact_penalty") + F.col("family_shift") + F.col("residual_shift") + F.col("behaviour_shift")
    return out.withColumn("reward", final(raw, total))


def updates(batch: DataFrame, exact: DataFrame, family: DataFrame, residual_good: float = 0.16, behaviour_good: float = 0.12) -> dict[str, DataFrame]:
    """What a scored batch (expr, hash, family, raw) adds to the archives: counts of every expression, and the good ones' rows."""
    some = batch.where("coalesce(expr, '') <> ''")
    return {
        "exact": record(some, exact),
        "family": record(some.select(F.col("family").alias("hash")), family),
        "residual": some.where(F.col("raw") >= residual_good),
        "behaviour": some.where(F.col("raw") >= behaviour_good),
    }


def densify(df: DataFrame, names: list[str], metrics: str = "metrics") -> DataFrame:
    """A column for each metric, 0.0 where a row has none."""
    return df.select("*", *[F.coalesce(F.try_element_at(metrics, F.lit(n)), F.lit(0.0)).alias(n) for n in names]).drop(metrics)
