"""The corpus pipeline and each of its stages against brute force, with nulls, repeats, no rows and clashing names."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import toxicity
from quillon.llm._spark import fold
from quillon.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, _bad int, _hit string, N_Dropped int, sequence_id string"
LINE = "a footer line that stands in many of the documents, word for word"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def rows():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    item = " ".join(rng.choice(vocab) for _ in range(14))
    texts = []
    for i in range(70):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60)))
        if i % 6 == 0:
            t += " foul vile"
        if i % 4 == 0:
            t += "\n" + LINE.upper()
        if i in (9, 31):
            t += " " + item
        texts.append(t)
    texts += [texts[3], texts[3] + " more", texts[5].upper(), None, "", LINE, "same words", "same words"]
    out = [(i, t, "en", "s", len(t or ""), 1, 2, "h", 99, "q") for i, t in enumerate(texts)]
    return [*out, (None, "without an id " + item, "en", "s", 5, 1, 2, "h", 99, "q")], item


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    data, item = rows()
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(data, SCHEMA).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), data, item


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def near(texts):
    """Of (id, text), the ids that are not the smallest of their component."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) != i}


def dropped(data):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in data:
        if i is not None:
            for x in {key(s) for s in (t or "").split("\n")}:
                if len(x) >= 40:
                    held.setdefault(x, set()).add(i)
    out = []
    for i, t in data:
        kept = [s for s in (t or "").split("\n") if i is None or len(held.get(key(s), ())) < 5 or max(held[key(s)]) == i]
        out.append((i, t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)))
    return out


def hit(t, item):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    w, q = words(t), words(item)
    return any(w[p : p + 10] == q[j : j + 10] for j in range(len(q) - 9) for p in range(len(w) - 9))


def test_stages_and_run_against_brute_force(spark, corpus):
    path, data, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    # toxicity: what its scores say, and the planted words go
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score >= 0.5 and r.doc_id is not None}
    out = stages["toxicity"](spark, docs, path)
    assert out.columns == docs.columns
    left = [(r[0], r[1]) for r in data if r[0] not in bad]
    assert ids(out) == sorted((i for i, _ in left), key=str)
    assert {i for i in range(70) if i % 6 == 0} <= bad and all(i is None or i % 6 == 0 or i > 69 for i in bad)
    # line dedup on the whole input
    out = stages["line_dedup"](spark, docs, path)
    assert out.columns == docs.columns
    want = dropped([(r[0], r[1]) for r in data])
    lost = dict(want)
    chars = {r[0]: r[4] if lost[r[0]] == r[1] else len(lost[r[0]]) for r in data}
    assert sorted(((r.doc_id, r.text, r.n_chars, r.N_Dropped) for r in out.collect()), key=str) == sorted(((i, t, chars[i], 99) for i, t in want), key=str)
    # near dedup and decontamination, each on the whole input
    out = stages["near_dedup"](spark, docs, path)
    assert out.columns == docs.columns
    gone = near([(r[0], r[1]) for r in data if r[0] is not None])
    assert gone and ids(out) == sorted((r[0] for r in data if r[0] not in gone), key=str)
    out = stages["decontamination"](spark, docs, path)
    assert out.columns == docs.columns
    assert ids(out) == sorted((r[0] for r in data if r[0] is None or not hit(r[1], item)), key=str) and {9, 31}.isdisjoint(ids(out))
    # the whole pipeline: each stage on what its predecessor kept
    left = dropped(left)
    gone = near([r for r in left if r[0] is not None])
    left = [r for r in left if r[0] not in gone]
    left = [r for r in left if r[0] is None or not hit(r[1], item)]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length) for r in got), key=str) == sorted(((i, 0, 0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in left), key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 1024


def test_stages_of_no_rows(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_repeated_rows_go_or_stay_together(spark, corpus):
    path, data, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where(F.col("doc_id").isin(9, 10, 31, 70))
    twice = docs.union(docs)
    out = dict(corpus_pipeline.STAGES)["decontamination"](spark, twice, path)
    assert ids(out) == [10, 10, 70, 70]
    assert np.unique(ids(dict(corpus_pipeline.STAGES)["line_dedup"](spark, twice, path)), return_counts=True)[1].tolist() == [2, 2, 2, 2]
