"""What keeps tasks small: blocks with halos, one scan for all bar sizes, joins by bins, sums and ranks by ranges, rounds of a quota."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.ordered import average_ranks, running_sum
from quillon.operators import panel, scoring, seeds, shaping
from quillon.operators.intervals import grouped_within, within
from quillon.plans import catalog, halo
from quillon.plans.lower import factors
from quillon.sources import bars as B
from quillon.sources import tables
from tests.test_engine import frame, minute, series

SF = "/root/testdata/sf0.001"
EXPRS = {
    "a": "ts_mean(close(20))", "b": "ema_arr(close(9), 4)", "c": "corr(returns(9), diff(close(12)))", "d": "ts_max(normalize(close(9)))", "e": "ts_std(log_arr(close(7)) - ts_mean(open(30)))",
    "f": "rank(last(close(3)), slice_arr(close(40), 25))", "g": "ts_skew(diff(diff(close(15))))", "h": "first(returns(33))",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [50, 500])
@pytest.mark.parametrize("arrays", [False, True])
def test_blocks_with_halos_give_the_same_factors(spark, block, arrays):
    bars = B.finite_rows(catalog.event_bars(spark, SF, 7))
    want = {(r.symbol, r.ts): r for r in factors(bars, EXPRS, force_arrays=arrays).collect()}
    got = halo.factors_in_blocks(bars, EXPRS, block=block, position="n", force_arrays=arrays).collect()
    assert len(got) == len(want)
    order = {}
    for s, t in sorted(want):
        order[s, t] = order.get((s, None), 0) + 1
        order[s, None] = order[s, t]
    for r in got:
        w = want[r.symbol, r.ts]
        assert r.n == order[r.symbol, r.ts] and all(r[x] == pytest.approx(w[x], rel=1e-12, abs=1e-12) for x in EXPRS)


@pytest.mark.parametrize("block", [50, 500])
def test_no_block_is_larger_than_asked(spark, block):
    bars = B.finite_rows(catalog.event_bars(spark, SF, 7))
    cut = halo.blocks(bars, 39, block)
    sizes = cut.rows.groupBy("symbol", "_block").agg(F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("halo"), F.min("_at").alias("at")).collect()
    most = cut.cells.agg(F.max("_n")).first()[0]
    assert all(r.own <= block and r.halo < 39 + most for r in sizes) and all(r.halo >= 39 for r in sizes if r["at"] > 0)
    assert sum(r.own for r in sizes) == bars.count() and (block > 50 or len(sizes) > 10)
    # every window is computed within a block
    out = plan(factors(cut.rows, {"a": "ts_mean(close(20))"}, keys=("symbol", "_block")))
    assert "hashpartitioning(symbol" in out and "_block" in out.split("Window")[1]


def test_blocks_of_bursts_and_of_nothing(spark):
    rows = [("s", minute(0 if i < 300 else i), 1.0, 1.0, 1.0, float(i % 7), 1.0) for i in range(600)]
    df = frame(spark, rows)
    cut = halo.blocks(df, 5, 100)
    sizes = sorted(r["n"] for r in cut.rows.where("_own").groupBy("_block").agg(F.count("*").alias("n")).collect())
    assert sum(sizes) == 600 and sizes[-1] == 300 and sizes[-2] <= 100  # one time is not cut apart
    assert halo.factors_in_blocks(df.limit(0), EXPRS, block=10).count() == 0


def test_all_bar_sizes_from_one_scan(spark):
    trades = B.trades(catalog._table(spark, SF, "events"), "event_type", "ts", "value", F.lit(1.0))
    for closed in ("right", "left"):
        grids = B.lattice(trades, [60, 240, 90, 1440], closed)
        assert sorted(grids) == [60, 90, 240, 1440] and grids[1440] is trades
        for m in (60, 90, 240):
            assert "events.parquet" not in plan(grids[m])  # the table is read once, for the finest bars
            assert sorted(map(tuple, grids[m].withColumn("volume", F.round("volume")).collect()), key=str) == sorted(map(tuple, B.resample(trades, m, closed).withColumn("volume", F.round("volume")).collect()), key=str)


JOBS = [(0, "sub(last(close(5)), ts_mean(close(5)))", "2024-01-14", "2024-01-16", 5, 1), (1, "sub(last(close(5)), ts_mean(close(5)))", "2024-01-14", "2024-01-16", 60, 1), (2, "bad(", "2024-01-14", "2024-01-16", 5, 1), (3, "last(close(2)) - last(open(2))", "2024-01-14", "2024-01-16", 5, 3)]


@pytest.mark.parametrize("shard", [100, 1])
def test_jobs_are_scored_on_their_own_bars(spark, monkeypatch, shard):
    monkeypatch.setattr(scoring, "SHARD", shard)
    bars = series(spark, 1440 * 16, ("s", "t"))
    jobs = spark.createDataFrame(JOBS, scoring.JOBS)
    scored, profiles = scoring.score_jobs(bars, jobs)
    raw = {r.job: r.raw for r in scored.collect()}
    assert raw[2] == -1.0 and raw[0] != raw[1]
    for job, expr, start, end, m, h in (JOBS[0], JOBS[3]):
        # five-minute bars: 240 of warm-up, the days that hold them with a reserve, two days more
        days = max(10, math.ceil(m * 240 / 1440) + 5)
        grid = factors(B.finite_rows(B.resample(bars, m)), {"factor": expr}).where(f"ts >= timestamp_ntz'{start}' - make_interval(0, 0, 0, {days + 2}) and ts <= timestamp_ntz'{end}'")
        rows = panel.skip_warmup(grid, 239 + days * (1440 // m)).where(f"ts >= timestamp_ntz'{start}'")
        want = panel.direction_accuracy(panel.series_labels(rows, h)).first()
        assert raw[job] == pytest.approx(want.value / 100 + 0.1)
        assert profiles.where(F.col("expr_hash") == str(job)).count() == panel.aligned(panel.series_labels(rows, h)).count() > 50
    with pytest.raises(ValueError):
        scoring.score_jobs(bars, jobs, "cross_sectional")
    none = spark.createDataFrame([], "hash string, count long")
    with pytest.raises(ValueError):
        scoring.score_answers(spark.createDataFrame([(1, "x")], "id int, text string"), bars, none, none, residual=none, kind=scoring.CROSS)


def test_panel_jobs_and_their_archive(spark):
    names = [f"s{k}" for k in range(9)]
    rng = random.Random(3)
    rows = [(s, minute(1440 * t), 1.0, 1.0, 1.0, 50 + 10 * rng.random(), 1.0) for t in range(200) for s in names]
    bars = spark.createDataFrame([(s, t, *v) for s, t, *v in rows], "symbol string, ts string, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("ts", F.date_add(F.lit("2023-01-01").cast("date"), (F.substring("ts", 9, 2).cast("int") - 1)).cast("timestamp_ntz"))
    days = spark.createDataFrame([(s, t, 50 + 10 * rng.random()) for s in names for t in range(400)], "symbol string, t int, close double")
    bars = days.select("symbol", F.date_add(F.lit("2023-01-01").cast("date"), F.col("t")).cast("timestamp_ntz").alias("ts"), *[F.col("close").alias(f) for f in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    expr, other = "neg(zscore(last(close(8)), close(8)))", "last(close(3))"
    window = ("2023-02-01", "2024-01-20", 1440, 1)
    answers = spark.createDataFrame([(1, f"<expr>{expr}</expr>", "", *window), (2, f"<expr>{other}</expr>", "", *window), (3, "none", "", *window)], "id int, text string, seed_expr string, start_date string, end_date string, bar_minutes int, horizon int")
    none = spark.createDataFrame([], "hash string, count long")
    batch = scoring.score_answers(answers, bars, none, none, scoring.CROSS)
    rows = {r.id: r for r in batch.rows.collect()}
    kept = panel.evaluate_panel(bars.where("ts >= timestamp_ntz'2023-01-20' and ts <= timestamp_ntz'2024-01-20'"), expr, 1, 96, "2023-02-01")
    assert rows[1].raw == pytest.approx(panel.panel_score(kept).first().score) and rows[1].raw > 0.1 and rows[3].reward == -1.0
    assert batch.profiles.columns == ["expr_hash", "ts", "symbol", "rank_pct"]
    items, cells = batch.good_profiles(0.1)
    again = scoring.score_answers(answers, bars, none, none, scoring.CROSS, behaviour=cells)
    r = again.rows.where("id = 1").first()
    assert r.rank_max_corr == pytest.approx(1.0) and r.rank_samples >= 200 and r.behaviour_shift == pytest.approx(-0.08 * 0.15)


def greedy(rows, quota):
    seen, full, out = set(), Counter(), {}
    for idx, score, h, cat in sorted(rows, key=lambda r: (-r[1], r[0])):
        if h and h in seen:
            out[idx] = "duplicate_ast"
        elif quota is not None and full[cat] >= quota:
            out[idx] = "duplicate_category_quota"
        else:
            out[idx] = "kept"
            seen.add(h)
            full[cat] += 1
    return out


@pytest.mark.parametrize(("quota", "seed"), [(None, 1), (1, 2), (3, 3), (10, 4), (0, 5)])
def test_quota_is_that_of_the_walk_in_order(spark, quota, seed):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(40)), rng.choice(["", *[f"h{k}" for k in range(60)]]), rng.choice("aaaaaabcdefg")) for i in range(400)]
    df = spark.createDataFrame([(*r, True, "ok", []) for r in rows], "idx int, seed_score double, canonical_hash string, category string, valid boolean, status string, reasons array<string>")
    got = {r.idx: r for r in seeds.dedup(df, quota).collect()}
    want = greedy(rows, quota)
    assert {i: r.dup_status for i, r in got.items()} == want
    assert all(r.valid == (want[i] == "kept") and r.status == ("ok" if r.valid else want[i]) for i, r in got.items())
    assert {r.reasons[0] for r in got.values() if not r.valid} <= {"duplicate_ast", "category_quota"}


def test_many_draws_of_many_rows(spark):
    n = k = 100_000
    pool = spark.range(n).select(F.format_string("%06d", "id").alias("id"), (F.col("id") % 5).cast("double").alias("seed_score"), F.when(F.col("id") % 2 == 0, "elite_candidate").otherwise("valid_low_score").alias("status"))
    drawn = seeds.softmax_sample(pool, k, 2.0, 0.25, 9)
    text = plan(drawn)
    assert "Cartesian" not in text and "NestedLoop" not in text
    rows = drawn.collect()
    assert len(rows) == k == len({r.draw for r in rows})
    elite = [int(r.id) for r in rows if int(r.id) % 2 == 0]
    assert abs(len(elite) / k - 0.75) < 4 * math.sqrt(0.75 * 0.25 / k)
    weights = [math.exp(s / 2) for s in range(5)]
    for s in range(5):
        p = weights[s] / sum(weights)
        assert abs(sum(i % 5 == s for i in elite) / len(elite) - p) < 4 * math.sqrt(p * (1 - p) / len(elite))
    assert seeds.softmax_sample(pool.limit(0), 5).count() == 0 == seeds.softmax_sample(pool, 0).count()


def test_points_in_intervals(spark):
    rng = random.Random(8)
    spans = [(i, a, a + rng.choice([0, 1, 5, 300])) for i, a in enumerate(rng.randrange(1000) for _ in range(200))] + [(900, 5, 4), (901, None, 9), (902, -50, 2000)]
    points = [(i, rng.randrange(-20, 1100)) for i in range(300)] + [(999, None)]
    left, right = spark.createDataFrame(points, "p int, x long"), spark.createDataFrame(spans, "i int, a long, b long")
    for closed in (True, False):
        got = within(left, F.col("x"), right, F.col("a"), F.col("b"), closed=closed)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        want = {(p, i) for p, x in points for i, a, b in spans if x is not None and a is not None and a <= x and (x <= b if closed else x < b)}
        assert {(r.p, r.i) for r in got.collect()} == want
    with pytest.raises(ValueError):
        within(left, F.col("x"), left, F.col("x"), F.col("x"))


@pytest.mark.parametrize(("closed", "kind"), [(True, "long"), (False, "long"), (True, "double")])
def test_groups_of_points_in_intervals(spark, closed, kind):
    rng = random.Random(9)
    spans = [(i, rng.choice(["p", "q", None]), a, a + rng.choice([0, 1, 5, 300])) for i, a in enumerate(rng.randrange(1000) for _ in range(200))]
    spans += [(900, "p", 5, 4), (901, "q", None, 9), (902, "q", 3, None), (903, "r", -50, 2000), (None, "s", 7, 8), (904, "t", 5000, 6000)]
    points = [(rng.choice(["x", "y", None]), rng.randrange(-20, 1100), rng.choice([None, 0.5, 2.25, -7.0])) for _ in range(300)] + [("z", 700, None), ("x", None, 1.0)]
    left, right = spark.createDataFrame(points, "k string, x long, v double"), spark.createDataFrame(spans, "i int, g string, a long, b long")
    to = lambda c: F.col(c) / 8 if kind == "double" else F.col(c)
    got = grouped_within(left, to("x"), ["k"], right, to("a"), to("b"), ["g"], means={"mean": "v"}, least={"first": "i"}, closed=closed)
    want = {}
    for k, x, v in points:
        for i, g, a, b in spans:
            if None not in (x, a, b) and a <= x and (x <= b if closed else x < b):
                want.setdefault((k, g), []).append((v, i))
    rows = {(r.k, r.g): r for r in got.collect()}
    assert rows.keys() == want.keys() and ("z", "r") in rows and rows["z", "r"].mean is None
    for key, pairs in want.items():
        some, ids = [v for v, _ in pairs if v is not None], [i for _, i in pairs if i is not None]
        assert (rows[key].n, rows[key].first) == (len(pairs), min(ids, default=None))
        assert not some or rows[key].mean == pytest.approx(sum(some) / len(some))
    assert grouped_within(left, F.col("x"), ["k"], right.limit(0), F.col("a"), F.col("b"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        grouped_within(left, F.col("x"), ["k"], left, F.col("x"), F.col("x"), ["k"])


def test_work_of_intervals_does_not_grow_with_pairs(spark):
    """3 * 10^10 pairs: listed one by one they take hours."""
    left = spark.range(200_000).select((F.col("id") % 1000).alias("x"), F.col("id").cast("double").alias("v"), F.lit("k").alias("k"))
    right = spark.range(300_000).select(F.col("id").alias("i"), (-(F.col("id") % 500)).alias("a"), (F.col("id") % 500 + 500).alias("b"), F.lit("g").alias("g"))
    (row,) = grouped_within(left, F.col("x"), ["k"], right, F.col("a"), F.col("b"), ["g"], means={"mean": "v"}, least={"first": "i"}).collect()
    n = 200 * 600 * sum(b + 501 for b in range(500))
    assert (row.n, row.first) == (n, 0)
    x = 200 * 600 * sum((b + 500) * (b + 501) // 2 for b in range(500))
    assert row["mean"] == pytest.approx(x / n + 99_500)


def test_sums_and_ranks_by_ranges(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=3000), 1)
    df = spark.createDataFrame([(i, float(x) if i % 50 else None) for i, x in enumerate(v)], "i int, v double")
    out = average_ranks(df, {"r": "v"})
    assert "SinglePartition" not in plan(out)
    got = {r.i: r.r for r in out.collect()}
    some = np.array([x for i, x in enumerate(v) if i % 50])
    assert all(got[i] is None if not i % 50 else got[i] == (some < x).sum() + ((some == x).sum() + 1) / 2 for i, x in enumerate(v))
    sums = {r.i: r.before for r in running_sum(df.select("i", F.col("i").cast("long").alias("w")), "w", [F.desc("i")], "before", 7).collect()}
    assert sums == {i: sum(range(i + 1, 3000)) for i in range(3000)}
    assert average_ranks(df.limit(0), {"r": "v"}).count() == 0
    rows = series(spark, 200).select("symbol", "ts", F.col("close").alias("factor"), (F.col("open") % 5).alias("fwd"))
    assert panel.rank_ic(rows).first().value == pytest.approx(panel.rank_ic(rows, ("symbol",)).first().value)


def test_only_files_of_chosen_symbols_are_touched(spark, tmp_path):
    series(spark, 2, tuple(f"A{i:03d}/USD" for i in range(300))).repartition(1).createOrReplaceTempView("many")
    rows = spark.table("many").toPandas().astype({"ts": "datetime64[us]"})
    for s, part in rows.groupby("symbol"):
        part.drop(columns="symbol").to_parquet(tmp_path / f"x.{B.symbol_file(s)}.parquet")
    (tmp_path / "x.A000_USD.parquet").write_bytes(b"broken")  # never opened
    template = "x.{symbol}.parquet"
    found = B.symbol_files(spark, str(tmp_path), template)
    assert found.count() == 300 and B.universe(found, 2).collect()[0].symbol == "A000/USD"
    chosen = [f"A{i:03d}/USD" for i in range(10, 18)]
    got = B.scan(spark, str(tmp_path), template=template, symbols=chosen)
    assert len(got.inputFiles()) == 8 and sorted({r.symbol for r in got.collect()}) == chosen and got.count() == 16
    with pytest.raises(ValueError):
        B.scan(spark, str(tmp_path), template=template, symbols=["nothing"])


def test_many_expressions_are_judged_in_tasks(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("ts_mean(close("), F.col("id") % 700 + 1, F.lit("))"), F.when(F.col("id") % 11 == 0, ")").otherwise("")).alias("expr"), F.lit("x").alias("status"))
    got = seeds.validate_candidates(rows.union(spark.createDataFrame([(-1, None, "y")], "id long, expr string, status string")), max_lookback=500)
    assert got.count() == 5001 and got.where("id % 11 = 0 and id >= 0").select("status").distinct().collect()[0].status == "invalid_syntax"
    assert {r.valid for r in got.where("id % 11 <> 0 and id % 700 < 500 and id >= 0").collect()} == {True} and got.where("id = -1").first().status == "invalid_syntax"
    assert got.where("id % 11 <> 0 and id % 700 > 501").select(F.explode("reasons")).distinct().collect()[0][0] == "lookback>500"
    assert shaping.counts(got.select(F.col("family_hash").alias("hash"), F.lit(1).cast("long").alias("count"))).count() > 5


def test_products_by_blocks_equal_those_by_rows(spark, monkeypatch):
    from quillon.operators import gram

    monkeypatch.setattr(gram, "CELLS", 60)
    rng = np.random.default_rng(7)
    cells = {side: [(f"{side}{i}", t, int(rng.integers(-1, 2))) for i in range(4) for t in range(120) for _ in range(int(rng.integers(0, 3)))] for side in "ab"}
    make = lambda rows: spark.createDataFrame(rows, "expr_hash string, ts int, pred int").repartition(5)
    out = shaping.max_behaviour_corr(make(cells["a"] + [("flat", t, 1) for t in range(120)]), make(cells["b"]))
    text = plan(out)
    assert "Join" not in text
    want = {"flat": 0.0}
    for i in range(4):
        best = 0.0
        for j in range(4):
            pairs = [(x, y) for n, t, x in cells["a"] if n == f"a{i}" for m, u, y in cells["b"] if m == f"b{j}" and u == t]
            x, y = np.array(pairs, float).T
            best = max(best, abs(np.corrcoef(x, y)[0, 1]))
        want[f"a{i}"] = best
    assert {r.expr_hash: pytest.approx(r.max_corr, abs=1e-9) for r in out.collect()} == want
    # a row for each pair and task, whatever the number of times
    seen = gram.product_sums(*[make(cells[s]).select(F.col("expr_hash").alias("item"), "ts", F.col("pred").cast("double").alias("v")) for s in "ab"])
    assert seen.count() == 16 and "mapinpandas" in plan(seen).lower()


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quillon.sources.ledger import Ledger, count_batch, counted, first_of

    def batch(i):
        return spark.createDataFrame([(f"h{k}",) for k in range(i % 5, 20) for _ in range(2)] + [("",), (None,)], "hash string")

    log = Ledger(spark, tmp_path / "counts", "hash string, count long")
    assert log.read().count() == 0 and log.live() == [] and log.compact() is None
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: count_batch(Ledger(spark, tmp_path / "counts", "hash string, count long"), batch(i)), range(8)))
    want = Counter(f"h{k}" for i in range(8) for k in range(i % 5, 20) for _ in range(2))
    assert {r.hash: r["count"] for r in counted(log).collect()} == want and len(log.live()) == 8
    # two compactions of the same parts and an append between them
    parts = log.live()
    rows = log.read()
    one = log.add(rows, parts)
    count_batch(log, batch(0))
    log.add(rows, parts)
    want += Counter(f"h{k}" for k in range(20) for _ in range(2))
    assert {r.hash: r["count"] for r in counted(log).collect()} == want and log.live()[0] == one and len(log.live()) == 2
    assert log.compact() and len(log.live()) == 1 and {r.hash: r["count"] for r in counted(log).collect()} == want
    assert log.sweep() == 11 and {r.hash: r["count"] for r in counted(log).collect()} == want
    # a part without a commit does not exist
    counted(log).write.parquet(f"{tmp_path}/counts/parts/99999999999999999999-x")
    assert {r.hash: r["count"] for r in counted(log).collect()} == want
    items = lambda *rows: spark.createDataFrame([(h, h, r, "", "", "") for h, r in rows], "expr_hash string, expr string, raw_score double, task_id string, start_date string, end_date string")
    cells = lambda v: spark.createDataFrame([(h, minute(0), v, v, True, True) for h in "abc"], "expr_hash string, ts string, pred int, label int, mask boolean, correct boolean").withColumn("ts", F.to_timestamp_ntz("ts"))
    kept = tables.profile_ledger(spark, tmp_path / "profiles", tables.DIRECTION)
    for v, rows in ((1, [("a", 0.2), ("b", 0.3), ("d", 0.9)]), (2, [("a", 0.2), ("b", 0.1), ("c", None)])):
        tables.add_profiles(kept, items(*rows), cells(v), tables.DIRECTION)
    assert [(r.expr_hash, r.raw_score, r.pred) for r in tables.best_profiles(kept).orderBy("expr_hash").collect()] == [("a", 0.2, 2), ("b", 0.3, 1), ("c", -9.0, 2)]
    assert [r.expr_hash for r in tables.best_profiles(kept, 1).collect()] == ["b"]
    found = Ledger(spark, tmp_path / "mined", "expr string, score double")
    for score in (0.5, 0.7):
        found.add(spark.createDataFrame([("a", score), ("b" if score < 0.6 else "c", score)], "expr string, score double"))
    assert sorted(map(tuple, first_of(found, "expr").collect())) == [("a", 0.5), ("b", 0.5), ("c", 0.7)]


def test_profiles_are_made_once_for_each_month(spark, tmp_path):
    from quillon.operators import profiles

    trades = B.trades(catalog._table(spark, SF.replace("0.001", "0.01"), "events"), "event_type", "ts", "value", F.lit(1.0))
    # five months of the same bars, with holes
    long = trades.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("ts", F.expr("ts + make_interval(0, k)")).where("not (symbol = 'view' and month(ts) = 3 and day(ts) < 20)").drop("k")
    exprs = ["sub(last(close(5)), ts_mean(close(30)))", "neg(last(returns(3)))"]
    job = lambda e, start, end, h=1: profiles.Job(e, start, end, 240, h)

    def full(jobs):
        table = spark.createDataFrame([(i, j.expr, j.start, j.end, j.bar_minutes, j.horizon) for i, j in enumerate(jobs)], scoring.JOBS)
        rows = scoring.score_jobs(long, table)[1].collect()
        return sorted((jobs[int(r.expr_hash)].hash, jobs[int(r.expr_hash)].horizon, jobs[int(r.expr_hash)].end, *r[1:]) for r in rows)

    store = profiles.ProfileStore(spark, tmp_path / "store")
    computed = []
    whole = store._compute
    store._compute = lambda rows, missing, span: computed.append(sorted({k[3].month for k in missing})) or whole(rows, missing, span)
    ask = lambda jobs: sorted((r.expr_hash, r.horizon, r.end_date, *r[5:]) for r in store.request(long, jobs).collect())
    first = [job(e, "2024-02-01", "2024-02-28") for e in exprs]
    assert ask(first) == full(first) != []
    second = [job(exprs[0], "2024-02-01", "2024-04-20"), job(exprs[1], "2024-02-10", "2024-02-25")]
    assert ask(second) == full(second)
    assert ask(first) == full(first)
    # January and February were there; nothing at all was missing the third time
    assert computed == [[1, 2], [3, 4]]
    third = [job(exprs[0], "2024-02-01", "2024-05-31", 3), job("bad(", "2024-02-01", "2024-05-31")]
    assert ask(third) == full(third[:1]) and computed[2] == [1, 2, 3, 4, 5]
    assert ask(third) == full(third[:1]) and computed[3] == [5]  # the last month has bars without a return


def test_replay_in_micro_batches_equals_the_batch(spark, tmp_path):
    from quillon.streaming.replay import replay

    bars = B.finite_rows(catalog.event_bars(spark, SF, 7))
    rows = bars.toPandas().sort_values("ts").astype({"ts": "datetime64[us]"}).reset_index(drop=True)
    step = -(-len(rows) // 10)
    for i in range(10):
        part = rows.iloc[i * step : (i + 1) * step]
        if i == 4:  # bars that come a second time, and others that come too late
            part = part._append(rows.iloc[:25].assign(close=-1.0))
        part.to_parquet(tmp_path / f"{i:02d}.parquet")
        import os

        os.utime(tmp_path / f"{i:02d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    exprs = {k: EXPRS[k] for k in "abcd"}
    found = []
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = replay(stream, exprs, lambda df, n: found.append((n, df.collect())), warmup=3).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and len(found) == 10
    got = {(r.symbol, r.ts): r for _, part in found for r in part}
    assert len(got) == sum(len(p) for _, p in found)
    want = panel.skip_warmup(factors(bars, exprs), 3).collect()
    assert len(want) == len(got) and all(got[r.symbol, r.ts][x] == pytest.approx(r[x], rel=1e-12, abs=1e-12) for r in want for x in (*exprs, "close"))
    assert min(r.n for r in got.values()) == 3


def test_an_expression_is_tried_out_with_the_warm_up_of_a_backtest(spark, tmp_path, capsys):
    from quillon import __main__ as cli

    bars = series(spark, 1440 * 14, ("s",))
    expr = "neg(sub(last(close(3)), ts_mean(close(3))))"
    row = scoring.try_out(bars, expr, "2024-01-13", "2024-01-14", 30).first()
    grid = factors(B.finite_rows(B.resample(bars, 30)), {"factor": expr}).where("ts >= timestamp_ntz'2024-01-01' and ts <= timestamp_ntz'2024-01-14'")
    kept = panel.skip_warmup(grid, 96 - 1 + 10 * 48).where("ts >= timestamp_ntz'2024-01-13'")
    want = panel.direction_accuracy(panel.aligned(panel.series_labels(kept, 1)))
    n = panel.aligned(panel.series_labels(kept, 1)).count()
    assert (row.valid, row.error) == ((True, None) if n >= 50 else (False, "too_few_samples")) and row.score == want.first().value and 0 < n < 96
    assert scoring.try_out(bars, "bad(", "2024-01-13", "2024-01-14").first().error.startswith("syntax")
    assert scoring.try_out(bars, expr, "2024-01-13", "2024-01-14", 30, scoring.CROSS).first().valid is False  # one symbol is no panel
    bars.write.parquet(str(tmp_path / "b"))
    assert cli.main(["try", str(tmp_path / "b"), expr, "5", "2024-01-12", "2024-01-14"]) == 0
    assert '"valid": true' in capsys.readouterr().out
