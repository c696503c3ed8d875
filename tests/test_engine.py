"""Scans, resampling edges, rewards, panels, archives, prompts, batches and streams through the functions themselves."""

import math

import pytest
from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon.operators import panel, scoring, seeds, shaping, text
from quillon.plans.expr import family_hash, form, validate
from quillon.sources import bars as B
from quillon.sources import tables
from quillon.streaming.bars import stream_bars

BARS = "symbol string, ts string, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS).withColumn("ts", F.to_timestamp_ntz("ts"))


def minute(i):
    return f"2024-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00"


def series(spark, n=200, symbols=("s",)):
    return frame(spark, [(s, minute(i), 10.0 + i % 7, 12.0 + i % 7, 8.0, 10.0 + (i * (3 + k)) % 11, 1.0 + i % 3) for k, s in enumerate(symbols) for i in range(n)])


def test_scan_by_file_names_and_range(spark, tmp_path):
    for symbol in ("BTC/USD", "ETH/USD"):
        rows = series(spark, 20, (symbol,)).drop("symbol").withColumn("extra", F.lit(1))
        rows.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{B.symbol_file(symbol)}_1m.parquet")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["BTC_USD_1m.parquet", "ETH_USD_1m.parquet"]
    got = B.scan(spark, str(tmp_path), "2024-01-01 00:05:00", "2024-01-01 00:07:00", template="{symbol}_1m.parquet")
    assert got.columns == ["symbol", "ts", *B.FIELDS]
    assert {(r.symbol, r.ts.minute) for r in got.collect()} == {(s, m) for s in ("BTC/USD", "ETH/USD") for m in (5, 6, 7)}
    assert [r.symbol for r in B.universe(got).collect()] == ["BTC/USD", "ETH/USD"] and B.universe(got, 1).count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "extra" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert B.scan(spark, str(tmp_path), "2024-01-04", warmup_days=1).count() == 40
    assert B.scan(spark, str(tmp_path), "2024-01-05", warmup_days=1).count() == 0
    assert spark.range(1).select(B.load_start("2024-03-01", 10).alias("x")).first().x.isoformat() == "2024-02-18T00:00:00"
    with pytest.raises(ValueError):
        B.scan(spark, str(tmp_path), time_col="when")


def test_first_and_last_skip_missing_values(spark):
    nan = math.nan
    df = frame(spark, [("s", minute(1), None, 3.0, nan, nan, 1.0), ("s", minute(2), nan, nan, 2.0, 5.0, None), ("s", minute(3), 7.0, 9.0, None, None, 4.0), ("s", minute(7), None, None, nan, nan, None)])
    got = [tuple(r)[2:] for r in B.resample(df, 5).orderBy("ts").collect()]
    assert got == [(7.0, 9.0, 2.0, 5.0, 5.0), (None, None, None, None, None)]
    assert [r.ts.minute for r in B.resample(df, 5).orderBy("ts").collect()] == [5, 10]
    assert B.finite_rows(df).count() == 0


def test_align_keeps_finite_pairs(spark):
    a = spark.createDataFrame([("s", 1, 1.0), ("s", 2, math.nan), ("s", 3, math.inf), ("s", 4, 2.0), ("t", 1, 1.0)], "symbol string, ts int, factor double")
    b = spark.createDataFrame([("s", 1, 0.1), ("s", 2, 0.1), ("s", 3, 0.1), ("s", 4, None), ("u", 1, 0.1)], "symbol string, ts int, fwd double")
    assert [tuple(r) for r in panel.align(a, b).collect()] == [("s", 1, 1.0, 0.1)]


def rewarded(spark, n=60):
    rows = [(i, 1.0 if i % 3 else 0.0, 0.01 * (1 if i % 2 else -1)) for i in range(n)]
    return spark.createDataFrame(rows, "ts int, factor double, fwd double")


def test_rewards_count_and_name_as_defined(spark):
    got = panel.direction_accuracy(rewarded(spark)).first()
    right = sum(i % 2 for i in range(60) if i % 3)
    assert got.metrics == {"samples": 40.0, "coverage": pytest.approx(2 / 3), "direction_acc": right / 40} and got.passed and got.value == pytest.approx((right / 40 - 0.5) * 200)
    few = panel.direction_accuracy(rewarded(spark, 49)).first()
    assert (few.value, few.passed, few.reason, few.metrics) == (-100.0, False, "too_few_samples", {"samples": 49.0})
    none = panel.direction_accuracy(rewarded(spark).withColumn("factor", F.lit(0.0))).first()
    assert (none.value, none.reason, none.metrics) == (-100.0, "zero_signal", {"coverage": 0.0})
    for name in ("ic", "rank_ic"):
        assert panel.reward(name)(rewarded(spark, 49)).first().reason == "too_few_samples"
        assert panel.reward(name)(rewarded(spark).withColumn("factor", F.lit(1.0))).first().reason == "undefined"
        assert set(panel.reward(name)(rewarded(spark)).first().metrics) == {name, "samples"}
    assert set(panel.signal_return(rewarded(spark)).first().metrics) == {"samples", "mean_pnl", "pnl_std", "sharpe_like"} - {"samples"}
    with pytest.raises(KeyError):
        panel.reward("nothing")
    assert panel.single_asset_reward("direction", 0) == ("direction_accuracy", 50, 1) and panel.single_asset_reward("rank_ic", 6) == ("rank_ic", 30, 6) and panel.single_asset_reward("odd")[0] == "direction_accuracy"


def test_composite_is_one_aggregation(spark):
    df = rewarded(spark).withColumn("fwd", F.when(F.col("ts") < 55, F.col("fwd")))
    out = panel.composite(df, {"ic": {"weight": 2.0, "min_samples": 56}, "direction_accuracy": {"min_samples": 10}, "signal_return": 0.5})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    r = out.first()
    parts = {n: panel.reward(n)(df, min_samples=m).first().value for n, m in (("ic", 56), ("direction_accuracy", 10), ("signal_return", 50))}
    assert r.value == pytest.approx(2 * parts["ic"] + parts["direction_accuracy"] + 0.5 * parts["signal_return"])
    assert (r.passed, r.reason, r.metrics["ic/samples"], r.metrics["direction_accuracy/value"]) == (False, "ic:too_few_samples", 55.0, parts["direction_accuracy"])


def test_a_reward_can_be_registered(spark):
    def hits(tag, fwd, keys, min_samples=1):
        return panel.Reward({}, {"n": F.count_if(F.col("factor") * F.col(fwd) > 0)}, F.col(f"{tag}n").cast("double"), F.lit(None).cast("string"), {"hits": F.col(f"{tag}n")})

    panel.register("hits", hits)
    try:
        r = panel.composite(rewarded(spark), {"hits": 1.0, "direction_accuracy": 0.0}).first()
        assert r.value == sum(i % 2 for i in range(60) if i % 3) == r.metrics["hits/hits"]
        with pytest.raises(ValueError):
            panel.register("hits", hits)
    finally:
        del panel.REWARDS["hits"]


def test_undefined_timestamps_take_no_part(spark):
    rows = [(t, f"s{k}", 1.0 if t == 1 else float(k), 50.0 if t == 1 else float(k + t)) for t in range(3) for k in range(8)]
    df = spark.createDataFrame(rows, "ts int, symbol string, factor double, fwd double")
    got = panel.summarise(panel.cross_section(df), 8, min_times=2).first()
    assert (got.times, got.mean_rank_ic, got.mean_ls, got.coverage) == (2, 1.0, 7.0, 1.0)
    assert {r.ts for r in panel.percentile_ranks(df).collect()} == {0, 2}
    assert panel.panel_score(df, min_symbols=8, min_times=2).first().score == pytest.approx(1.0)
    assert panel.panel_score(df, min_symbols=9, min_times=0).first() is None or panel.panel_score(df, 9, 0).first().score == -1.0


def test_panel_of_one_shuffle(spark):
    df = series(spark, 50, ("a", "b"))
    out = panel.evaluate_panel(df, "ts_mean(close(3))", 2, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert out.count() == 96 and out.where("fwd is null").count() == 4
    assert [panel.backtest_warmup(m, 10) for m in (5, 240, 1440)] == [2880, 60, 1]


def candidate(i, score, hash_, category, valid=True, invert=False):
    return i, f"s{i}", score, hash_, category, valid, invert


def test_curation_takes_valid_rows_in_order(spark):
    rows = [candidate(0, 9.0, "h", "a", valid=False, invert=True), candidate(1, 5.0, "g", "a"), candidate(2, 4.0, "h", "a"), candidate(3, 3.0, "h", "b"), candidate(4, 2.0, "h", "c"), candidate(5, 1.0, "", "b"), candidate(6, 1.0, "", "", invert=True), candidate(7, -1.0, "k", None)]
    df = spark.createDataFrame(rows, "idx int, id string, seed_score double, canonical_hash string, category string, valid boolean, invert boolean")
    plain = {r.idx: r.dup_status for r in seeds.dedup(df).collect()}
    assert plain == {0: None, 1: "kept", 2: "kept", 3: "duplicate_ast", 4: "duplicate_ast", 5: "kept", 6: "kept", 7: "kept"}
    # the copy beyond the quota does not stand in the way of the next one
    quota = {r.idx: r.dup_status for r in seeds.dedup(df, 1).collect()}
    assert quota == {0: None, 1: "kept", 2: "duplicate_category_quota", 3: "kept", 4: "duplicate_ast", 5: "duplicate_category_quota", 6: "kept", 7: "duplicate_category_quota"}
    flags = {r.idx: (r.elite, r.diverse, r.contrarian, r.rejected) for r in seeds.library(seeds.dedup(df), 2, 3, 5).collect()}
    assert flags == {0: (False, False, False, True), 1: (True, True, False, False), 2: (True, True, False, False), 3: (False, False, False, True), 4: (False, False, False, True), 5: (False, True, False, False), 6: (False, False, True, False), 7: (False, False, False, True)}


def test_scores_keep_what_was_found_before(spark):
    rows = [("a", True, ["early"], False, {"reward": 2.0}), ("b", True, [], True, {"reward": 0.0, "composite/complexity": 50.0, "coverage": 0.5, "composite/novelty": 1.0}), ("c", True, None, False, {})]
    df = spark.createDataFrame(rows, "id string, valid boolean, reasons array<string>, invert boolean, metrics map<string,double>")
    got = {r.id: (r.valid, r.status, r.reasons, r.invert, r.seed_score) for r in seeds.score(df).collect()}
    assert got == {"a": (False, "filtered", ["early"], False, 2.0), "b": (False, "filtered", ["coverage<0.6"], True, pytest.approx(0.25)), "c": (True, "valid_low_score", [], False, 0.0)}


def test_softmax_draws_follow_scores(spark):
    pool = spark.createDataFrame([("a", 2.0, "elite_candidate"), ("b", 0.0, "elite_candidate"), ("c", 1.0, "valid_low_score")], "id string, seed_score double, status string")
    drawn = [r.id for r in seeds.softmax_sample(pool, 3000, 1.0, 0.3, 5).collect()]
    share = {k: drawn.count(k) / 3000 for k in "abc"}
    odds = math.exp(2) / (math.exp(2) + 1)
    assert share["c"] == pytest.approx(0.3, abs=0.03) and share["a"] == pytest.approx(0.7 * odds, abs=0.03)
    assert {r.id for r in seeds.softmax_sample(pool.where("id <> 'c'"), 50, 1.0, 1.0).collect()} <= {"a", "b"}


def test_validation_and_hashes(spark):
    got = {r.id: (r.status, r.reasons, r.metrics) for r in seeds.validate_candidates(spark.createDataFrame([("a", "close(60)"), ("b", "("), ("c", "nope(1) + 2"), ("d", "ts_mean(3)")], "id string, expr string"), max_nodes=6).collect()}
    assert got["a"] == ("static_valid", [], {"expr_depth": 4.0, "expr_nodes": 5.0}) and got["b"][0] == "invalid_syntax" and got["b"][2] == {}
    assert got["c"][0] == "static_invalid" and got["c"][1][0] == "unknown_ops=nope" and got["c"][1][1] == "nodes>6" and got["d"][1][0].startswith("compile_error=")
    assert form("close(3) + open(3) * -2").text == "(+ (close 3) (* (open 3) (- 2)))"
    assert form("close(3) + open(3) * tick()").heads() == {"+": 1, "*": 1, "close": 1, "open": 1, "tick": 1} and form("close(3) + tick()").strangers() == ["tick"]
    assert form("close( 3 )").digest == form("close(3)").digest != form("close(4)").digest and form("neg(close(3))").digest != form("-close(3)").digest
    assert family_hash("a(b=1)") != family_hash("a(1)") and family_hash("close(5)+1") == family_hash("close(3)+2") != family_hash("close(3)-2")
    assert not validate("ts_mean(close(500))", max_lookback=100).valid


def test_smoke(spark):
    good = seeds.smoke(series(spark, 400), "neg(last(close(2)))", 60).first()
    assert good.valid and good.error is None and good.score == pytest.approx((good.direction_acc - 0.5) * 200) and good.coverage == 1.0
    few = seeds.smoke(series(spark, 280), "neg(last(close(2)))", 5).first()
    assert (few.valid, few.error) == (False, "too_few_samples")
    assert not seeds.smoke(series(spark, 20), "bad(").first().valid


def test_profile_archives(spark, tmp_path):
    path = str(tmp_path / "r")
    cells = spark.createDataFrame([(h, minute(t), 1, 1, True, True) for h in ("h1", "h2") for t in range(3)], "expr_hash string, ts string, pred int, label int, mask boolean, correct boolean").withColumn("ts", F.to_timestamp_ntz("ts"))

    def add(*items):
        tables.append_profiles(spark.createDataFrame([(h, h, s, "", "", "") for h, s in items], "expr_hash string, expr string, raw_score double, task_id string, start_date string, end_date string"), cells, path, tables.DIRECTION)

    assert tables.load_profiles(spark, path, tables.DIRECTION).count() == 0
    add(("h1", 0.2), ("h2", 0.5), ("h3", 0.9))
    add(("h1", 0.1), ("h2", 0.6))
    (tmp_path / "r" / "broken.json").write_text("{no\n")
    got = tables.load_items(spark, path, tables.DIRECTION).collect()
    assert [(r.expr_hash, r.raw_score, r.seq, len(r.profile)) for r in got] == [("h2", 0.6, 2, 3), ("h1", 0.2, 1, 3)]
    one = tables.load_profiles(spark, path, tables.DIRECTION, 1)
    assert one.columns == ["expr_hash", "raw_score", "ts", "pred", "label", "mask", "correct"] and {r.expr_hash for r in one.collect()} == {"h2"} and one.count() == 3
    ranks = spark.createDataFrame([("h1", minute(0), "s", 0.5)], "expr_hash string, ts string, symbol string, rank_pct double").withColumn("ts", F.to_timestamp_ntz("ts"))
    items = spark.createDataFrame([("h1", "e", 0.3, "", "", "")], "expr_hash string, expr string, raw_score double, task_id string, start_date string, end_date string")
    tables.append_profiles(items, ranks, str(tmp_path / "x"), tables.RANKS)
    assert tables.load_profiles(spark, str(tmp_path / "x"), tables.RANKS).first().rank_pct == 0.5


def test_rank_behaviour_by_rows(spark):
    def rows(h, value, symbols):
        return [(h, t, s, float(value(t, k))) for t in range(6) for k, s in enumerate(symbols)]

    mine = rows("m", lambda t, k: k * (1 + t % 2), "abcde")
    old = rows("same", lambda t, k: 3 * k + t, "abcde") + rows("few", lambda t, k: k, "abc") + rows("turned", lambda t, k: -k if k < 4 else 9, "bcdef")
    make = lambda r: spark.createDataFrame(r, "expr_hash string, ts int, symbol string, rank_pct double")
    got = shaping.rank_behaviour_corr(make(mine), make(old), 6, 4).first()
    x, y = [1, 2, 3, 4], [0, -1, -2, -3]  # the shared symbols b to e
    r = abs(sum((a - 2.5) * (b + 1.5) for a, b in zip(x, y, strict=True))) / 5.0
    assert (got.max_corr, got.mean_corr, got.samples) == (pytest.approx(1.0), pytest.approx((1 + r) / 2), 6)


def test_tasks_and_prompts_by_mode(spark, tmp_path):
    bank = spark.createDataFrame([("a__q1", "a", "q1", "close(3)", "momentum", "2024-01-01", "2024-01-02", 1.5, 1.0), ("n", "", "q2", "", "no_seed", None, None, None, 2.0)], tables.TASKS)
    for name in ("b.yaml", "b.json"):
        tables.save_tasks(bank, tmp_path / name)
        assert sorted(map(tuple, tables.load_tasks(spark, tmp_path / name).collect()), key=str) == sorted(map(tuple, bank.collect()), key=str)
    for mode, (seeded, before, _) in seeds.MODES.items():
        rows = seeds.prompts(bank, mode, "sys").collect()
        assert len(rows) == (1 if seeded else 2)
        first = next(r for r in rows if r.extra_info.task_id == "a__q1")
        assert first.prompt[0].content == "sys" and first.prompt[1].content.startswith(f"{before}\ncategory: momentum\nsplit: q1\n")
        assert ("<expr>close(3)</expr>" in first.prompt[1].content) == seeded
    with pytest.raises(ValueError):
        seeds.prompts(bank, "other", "sys")
    assert cli.main(["build-prompts", str(tmp_path / "b.json"), str(tmp_path / "p"), "ocd"]) == 0 and spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_batch_with_archives(spark, tmp_path):
    bars = series(spark, 400)
    good = "neg(sub(last(close(3)), ts_mean(close(3))))"
    day = ("2024-01-01", "2024-01-02", 1, 1)
    answers = spark.createDataFrame([(1, f"<expr>{good}</expr>", "last(close(2))", *day), (2, "none", "", *day), (3, "<expr>bad(</expr>", "", *day), (4, f"x\n{good}", good, *day)], "id int, text string, seed_expr string, start_date string, end_date string, bar_minutes int, horizon int")
    none = spark.createDataFrame([], "hash string, count long")
    batch = scoring.score_answers(answers, bars, none, none, relative=True, warmup=1)
    rows = {r.id: r for r in batch.rows.collect()}
    raw = panel.direction_accuracy(panel.series_labels(scoring.factors(bars, {"factor": good}), 1)).first().value / 100 + 0.1
    assert rows[1].raw == rows[4].raw == pytest.approx(raw) and rows[1].raw > 0.1
    assert rows[2].reward == rows[3].reward == -1.0
    base = {r.expr: r.raw for r in batch.scored.collect()}["last(close(2))"]
    new = 0.02
    assert rows[1].reward == pytest.approx(min(1, raw + 0.5 * max(0, raw - base) + new)) and rows[4].reward == pytest.approx(min(1, raw + new))
    items, cells = batch.good_profiles(0.1)
    assert {r.expr for r in items.collect()} >= {good}
    path = str(tmp_path / "r")
    tables.append_profiles(items, cells, path, tables.DIRECTION)
    old = tables.load_profiles(spark, path, tables.DIRECTION)
    again = scoring.score_answers(answers, bars, spark.createDataFrame([(r.hash, 1) for r in batch.rows.where("id = 1").select(text.exact_hash(F.col("expr")).alias("hash")).collect()], "hash string, count long"), none, residual=old, warmup=1)
    r = again.rows.where("id = 1").first()
    assert r.max_corr == pytest.approx(1.0) and r.exact_penalty == 0.15 and r.residual_shift == pytest.approx(-0.03 * 0.08)
    grown = shaping.updates(batch.rows, none, none)
    assert {k: v.agg(F.sum("count")).first()[0] for k, v in grown.items() if k in ("exact", "family")} == {"exact": 3, "family": 3}


def test_stream_gives_the_bars_of_the_batch(spark, tmp_path):
    rows = series(spark, 37, ("a", "b"))
    # a late row closes the last bars
    late = frame(spark, [("z", "2024-01-03 00:00:00", 1.0, 1.0, 1.0, 1.0, 1.0)])
    for i, part in enumerate((rows.where("minute(ts) < 20"), rows.where("minute(ts) >= 20"), late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    name = "stream_bars_test"
    query = stream_bars(stream, 5, "1 minute").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table(name).collect()))
    assert got == sorted(map(tuple, B.resample(rows, 5).collect()))
