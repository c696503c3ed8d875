"""Files, banks, prompts, archives, scenarios and the command line; sampling against its definition."""

import json

import pytest
from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon.operators import panel, scenario, seeds, text
from quillon.sources import tables
from quillon.sources.config import read_config, write_config

CANDIDATES = {"seeds": [{"expr": "last(close(5))", "category": "momentum", "metadata": {"a": 1}}, {"id": "two", "expr": "bad(", "intuition": "é"}]}


@pytest.mark.parametrize("name", ["a/c.yaml", "a/c.json"])
def test_config_round_trip(tmp_path, name):
    write_config(CANDIDATES, tmp_path / name)
    assert read_config(tmp_path / name) == CANDIDATES
    assert list(read_config(tmp_path / name)["seeds"][1]) == ["id", "expr", "intuition"]


def test_config_refuses_other_files_and_reads_empty_ones(tmp_path):
    with pytest.raises(ValueError):
        read_config(tmp_path / "c.txt")
    (tmp_path / "e.yml").write_text("")
    assert read_config(tmp_path / "e.yml") == {}


def test_candidates_and_validation(spark, tmp_path):
    write_config(CANDIDATES, tmp_path / "c.json")
    rows = tables.candidates(spark, tmp_path / "c.json").collect()
    assert [(r.id, r.name, r.category, r.intuition) for r in rows] == [("seed_0000", "seed_0000", "momentum", ""), ("two", "two", "general", "é")]
    verdicts = {r.id: r.valid for r in seeds.validate_candidates(tables.candidates(spark, tmp_path / "c.json").select("id", "expr")).collect()}
    assert verdicts == {"seed_0000": True, "two": False}
    assert cli.main(["validate", str(tmp_path / "c.json")]) == 1
    assert cli.main([]) == 2


def test_answered_candidates(spark):
    fenced = "so\n```yaml\nseeds:\n- name: none\n- expr: close(3)\n- {id: x, expr: open(3), category: k}\n```"
    assert [(r.idx, r.id, r.expr, r.category) for r in tables.answered_candidates(spark, fenced).collect()] == [(1, "seed_0001", "close(3)", "general"), (2, "x", "open(3)", "k")]
    # not YAML: a second colon in a value
    loose = "- name: a: b\n- name: c: d\n  expr: close(4)\n"
    assert [(r.idx, r.id, r.name, r.expr) for r in tables.answered_candidates(spark, loose).collect()] == [(1, "seed_0001", "c: d", "close(4)")]
    for bad in ("seeds: []", "just words", "- name: a: b"):
        with pytest.raises(ValueError):
            tables.answered_candidates(spark, bad)


def test_evaluations_tasks_and_prompts(spark, tmp_path):
    path = str(tmp_path / "e")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text("\n".join(json.dumps(x) for x in ({"id": "a", "expr": "close(3)", "seed_score": 1.0, "metrics": {"ic": 0.1}}, {"expr": "open(3)", "category": "z", "metrics": {"ic": 0.9}}, {"id": "c", "expr": "close( 3)", "valid": False})))
    got = tables.load_evaluations(spark, path)
    assert {(r.id, r.valid, r.status, r.seed_score) for r in got.collect()} == {("a", True, "loaded", 1.0), ("seed_0001", True, "loaded", 0.0), ("c", False, "loaded", 0.0)}
    splits = spark.createDataFrame([("q1", "2024-01-01", "2024-01-10", 1.0), ("q2", "2024-01-10", "2024-01-20", 1.0)], "name string, start_date string, end_date string, weight double")
    assert [r.seed_id for r in seeds.task_bank(got, splits, 1).collect()] == ["a", "a"]
    assert {r.seed_id for r in seeds.task_bank(got, splits, 1, sort_by="ic").collect()} == {"seed_0001"}
    bank = seeds.task_bank(got, splits, 2)
    assert bank.count() == 4
    drawn = seeds.stratified_sample(bank, 11).collect()
    assert len(drawn) == 11 and {r.category for r in drawn} == {"general", "z"} and abs(sum(r.category == "z" for r in drawn) - 5.5) <= 0.5
    assert seeds.stratified_sample(bank.limit(0), 3).count() == 0
    tables.write_prompts(bank, str(tmp_path / "p"), "sys", "from {expr}", n=6)
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert len(rows) == 6 and all(r.prompt[1].content == f"from {r.extra_info.seed_expr}" and r.reward_model.ground_truth == [] for r in rows)


def test_archives_and_mined_factors(spark, tmp_path):
    batch = spark.createDataFrame([("h1",), ("h1",), ("",), ("h2",)], "hash string")
    path = str(tmp_path / "a")
    for _ in range(2):
        tables.append_counts(batch, path)
    (tmp_path / "a" / "broken.json").write_text("{not json\n")
    from quillon.operators.shaping import read_counts

    assert {(r["hash"], r["count"]) for r in read_counts(spark, path).collect()} == {("h1", 4), ("h2", 2)}
    found = spark.createDataFrame([(e, v, {"value": v, "samples": 60.0}) for e, v in (("e1", 0.02), ("e1", 0.02), ("e2", 0.001))], "expr string, score double, metrics map<string,double>")
    for _ in range(2):
        tables.append_mined(found, str(tmp_path / "m"), F.lit("ic"), lambda n: F.try_element_at("metrics", F.lit(n)))
    assert [r.expr for r in spark.read.parquet(str(tmp_path / "m")).collect()] == ["e1"]


def test_scenario():
    asked = []

    def chat(messages):
        asked.append(messages)
        return "```yaml\nuniverse: BTC, ETH\nhorizon: soon\nconstraints: none\ntarget: ic\nextra: 1\nfields:\n```"

    got = scenario.refine("a request", chat, market="fx")
    assert list(got) == list(scenario.FIELDS)
    assert {k: got[k] for k in ("raw", "universe", "horizon", "constraints", "target", "market")} == {"raw": "a request", "universe": ["BTC", "ETH"], "horizon": 1, "constraints": {"notes": "none"}, "target": "ic", "market": "fx"}
    assert got["fields"] == ["open", "high", "low", "close", "volume"]
    assert asked[0][-1]["content"] == "a request"
    assert scenario.scenario() == {k: v for k, (_, v) in scenario.FIELDS.items()}
    assert scenario.scenario({"horizon": "7", "universe": ("A", 2)}) | {} == scenario.scenario() | {"horizon": 7, "universe": ["A", "2"]}
    assert scenario.refine("r", lambda m: '{"raw": "own", "horizon": 3}')["raw"] == "own"
    with pytest.raises(ValueError):
        scenario.refine("r", lambda m: "- a")
    assert "universe: A, 2" in scenario.context(scenario.scenario({"universe": "A,2"}))


@pytest.mark.parametrize("body, rows", [
    ("", []),
    ("x", []),
    (None, []),
    ("name: a\nexpr: 'f(1)'\nexpr: g(2)\n\nname: b\n- category: c\nexpr: \"h: 3\"", [(0, "a", "g(2)", "general"), (2, "seed_0002", "h: 3", "c")]),
    ("- name: only\n- expr: k(1)\n junk\n  category: z", [(1, "seed_0001", "k(1)", "z")]),
    ("expr: a\nname: n\nname: m\nexpr: b", [(0, "seed_0000", "a", "general"), (1, "m", "b", "general")]),
])
def test_loose_candidates(spark, body, rows):
    got = text.loose_candidates(spark.createDataFrame([(1, body)], "id long, body string")).orderBy("idx").collect()
    assert [(r.idx, r.name, r.expr, r.category) for r in got] == rows


def test_evaluate_and_user_factor(spark):
    rows = [("s", f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", 10.0 + i % 7, 11.0 + i, 9.0, 10.0 + (i * 5) % 11, 1.0) for i in range(120)]
    bars = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = {r.id: r for r in seeds.evaluate(bars, [("a", "neg(last(close(2)))"), ("zero", "sub(last(close(2)), last(close(2)))"), ("bad", "nope(1)")]).collect()}
    assert got["a"].status == "evaluated" and got["a"].metrics["samples"] == 119 and got["a"].metrics["reward"] == (got["a"].metrics["direction_acc"] - 0.5) * 200
    assert (got["zero"].status, got["zero"].reasons) == ("eval_filtered", ["zero_signal"])
    assert got["bad"].status == "eval_error" and not got["bad"].valid
    out = panel.user_factor(bars, lambda r: r.assign(factor=r.close.diff().fillna(0.0))[["symbol", "ts", "factor"]])
    assert out.count() == 120
