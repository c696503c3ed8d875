"""Resampling towards a target, repeated byte strings and filter orders against brute force, with nulls, empty and long texts, ties, repeats, no rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import filter_audit, queries, substring_dedup, target_resampling
from quillon.llm._kernels import string_buffers

COLUMNS = "doc_id long, text string, source string, id long, part string, key long, score double, rank long, n long, mask int, digest string"


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source), beside columns whose names the operators use themselves"""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 7, "x", 1, 0.5, 3, 4, 1, "d") for r in rows], COLUMNS)


def words(text, lower=True):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


# -- 11


def resampled(docs, bench, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    def feats(text):
        w = words(text)
        return [b" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(zlib.crc32(f) % buckets for f in feats(x))
    for x in bench:
        t.update(zlib.crc32(f) % buckets for f in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain(zlib.crc32(v) % buckets) for v in f)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score, i is not None and len(words(x)) >= least))
    able = sorted([r for r in out if r[4]], key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"Wort{i}" for i in range(60)] + ["é", "日本語", "a-b", "x" * 90]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "?! \n"), (None, " ".join(vocab)), (3, out[5][1]), (n + 3, "Lang " * 5000)]


@pytest.mark.parametrize(("runs", "buckets", "percent", "piece", "block"), [(1, 10_000, 10, 1 << 20, 1 << 20), (3, 97, 37, 50, 1), (2, 5, 100, 7, 3)])
def test_resampling_is_the_draw_by_score(spark, monkeypatch, runs, buckets, percent, piece, block):
    monkeypatch.setattr(target_resampling, "_PIECE", piece)
    monkeypatch.setattr(target_resampling, "PER_BLOCK", block)
    docs, bench = corpus(runs), ["wort1 wort2 wort3 é", None, "wort1"]
    target = spark.createDataFrame([(x,) for x in bench], "text string")
    got = target_resampling.resample(frame(spark, docs).repartition(5), target, runs=runs, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, bench, runs, buckets, percent)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert target_resampling.resample(frame(spark, [(1, "a")]).limit(0), none).count() == 0
    docs = [(i, "eins zwei drei") for i in range(30)]
    assert sorted(map(tuple, target_resampling.resample(frame(spark, docs), none, percent=0, min_words=1).collect()), key=str) == resampled(docs, [], percent=0, least=1)


def test_ranks_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), i % 3) for i in range(200)] + [(7, 2, 0)] * 3 + [(500, None, 1)]
    df = spark.createDataFrame(rows, "id long, score long, other long")
    for k in (0, 1, 37, 120, 500):
        got = target_resampling.draw(df, k).collect()
        order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], *r))
        want = [(*r, j + 1 if j < k else None) for j, r in enumerate(order)] + [(500, None, 1, None)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# -- 12


def without_repeats(docs, length):
    first = {}
    order = sorted(range(len(docs)), key=lambda j: (docs[j][0] is None, docs[j][0] or 0))
    for j in order:
        raw = (docs[j][1] or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (docs[j][0], p))
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] != (i, p):
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)
        begin = np.flatnonzero(gone[1:] & ~gone[:-1])
        end = np.flatnonzero(gone[:-1] & ~gone[1:])
        out.append((i, len(raw), int(gone.sum()), len(begin), hashlib.sha256(kept).hexdigest(), [(int(a), int(b)) for a, b in zip(begin, end, strict=True)], kept))
    return sorted(out, key=str)


def repeated(seed, length):
    rng = random.Random(seed)
    alphabet = "abcdé日 \n"
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [some(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [some(rng.randint(0, 2 * length)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        out.append((3 * i - 20, "".join(parts)))
    out += [(1000, "x" * (7 * length)), (1001, "ab" * (3 * length)), (1002, "x" * length), (1003, out[9][1]), (1004, None), (1005, ""), (1006, "y" * (length - 1)), (None, passages[0] * 2), (1007, passages[0][: length - 1])]
    out.append((out[4][0], out[4][1]))  # a row that repeats another
    base = passages[3] * 2
    for i in range(12):  # near copies
        at = rng.randrange(len(base))
        out.append((2000 + i, base[:at] + "Q" + base[at + 1 :]))
    return out


@pytest.mark.parametrize(("length", "piece", "per_key"), [(100, 1 << 20, 20_000), (100, 333, 1), (20, 64, 2), (31, 1 << 20, 3)])
def test_repeated_strings_go(spark, monkeypatch, length, piece, per_key):
    monkeypatch.setattr(substring_dedup, "_PIECE", piece)
    monkeypatch.setattr(substring_dedup, "PER_KEY", per_key)
    docs = repeated(length + per_key, length)
    got = substring_dedup.remove_repeats(frame(spark, docs).repartition(6), length=length, keep=True).collect()
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=str)
    assert rows == without_repeats(docs, length)


def test_repeated_strings_of_many_partitions_and_of_nothing(spark):
    docs = [(i, "same line of text that is quite a bit longer than the hundred bytes that count, so that it is found again. " + str(i) * (i % 40)) for i in range(300)]
    got = substring_dedup.remove_repeats(frame(spark, docs).repartition(40)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == sorted((r[0], r[2], r[4]) for r in without_repeats(docs, 100))
    empty = substring_dedup.remove_repeats(frame(spark, docs[:1]).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_every_string_is_in_one_phrase_and_equal_ones_share_a_key():
    import pyarrow as pa

    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(3000))
    data, offs, _ = string_buffers(pa.array([text, "zz" + text[500:2500], "w" * 500]))
    keys, seen = {}, Counter()
    for doc, start, n, key, _ in substring_dedup.phrases(data, offs, 100):
        for d, s, m, k in zip(doc.tolist(), start.tolist(), n.tolist(), key.tolist(), strict=True):
            for p in range(s, s + m):
                seen[d, p] += 1
                keys.setdefault(bytes(data[offs[d] + p : offs[d] + p + 100]), set()).add(k)
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, int(b - a) - 99) for a, b in itertools.pairwise(offs))
    assert all(len(k) == 1 for k in keys.values())
    starts = np.array([p for p in range(2900)])
    order, group = substring_dedup.suffix_order(data, starts, 100)
    strings = [bytes(data[p : p + 100]) for p in starts[order]]
    assert strings == sorted(strings) and all((a == b) == (g == h) for (a, b), (g, h) in zip(itertools.pairwise(strings), itertools.pairwise(group.tolist()), strict=True))


# -- 13


def audited(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = [], Counter()
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        for p in itertools.permutations("ABCDE"):
            for k, f in enumerate(p):
                left = [r for r in own if not any(r[1][g] for g in p[:k])]
                gone = [r for r in left if r[1][f]]
                total[part, f] += len(gone)
                out.append([part, "".join(p), k + 1, len(left) - len(gone), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_all_orders_of_the_filters(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        w = [rng.choice(["alpha", "Beta", "BETA", "é", "z#", "wort"]) + str(rng.randrange(400) if rng.random() < 0.7 else 1) for _ in range(rng.choice([0, 5, 199, 200, 230]))]
        docs.append((i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(w), rng.choice(["a", "a", "a", "b", None, ""])))
    docs += [(200 + i, docs[2][1], "a") for i in range(9)] + [(300, None, "c"), (301, "", "c"), (None, "", "b"), (None, docs[2][1], None), (5, docs[5][1], "b"), (2, docs[2][1], "b"), (400, "W " * 30000, "a")]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 210, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, docs).repartition(7), known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == 4 * 600 and rows == audited(docs, labels)


def test_orders_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, [(1, "x")]).limit(0), none).count() == 0
    assert sorted(map(tuple, filter_audit.audit(frame(spark, [(1, "x")]), none).collect())) == audited([(1, "x", "s")], [])


# -- contracts of the registered queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_language": "doc_id bigint, held_out boolean, lang_pred string, score double", "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", "op4_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", "op9_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op11_target_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint", "op12_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_have_the_columns_of_their_contract(spark, name):
    out = queries.QUERIES[name](spark, SF)
    want = [c.rsplit(" ", 1) for c in CONTRACT[name].split(", ")]
    assert [list(x) for x in out.dtypes[: len(want)]] == want
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ("op1_language", "op6_toxicity"):
        mod, value = (4, 2) if name == "op1_language" else (5, 0)
        got = out.collect()
        assert len(got) == rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == value) for r in got)
        assert all(0 <= r.score <= 1 for r in got) and (name == "op1_language" or all(r.predicted == int(r.score >= 0.5) for r in got))
    elif name not in ("op3_warc", "op8_packing", "op13_filter_audit"):
        assert out.select(F.count_distinct("doc_id"), F.count("*")).first() == (rows, rows)


# -- 2, pretokens of more bytes than a small table holds


def test_prefix_tables_of_rare_letters():
    from quillon.llm import tokens
    from quillon.llm.queries import tokenizer_path

    counter, engine = tokens.PrefixCounter(tokenizer_path()), tokens.load(tokenizer_path())
    rng = random.Random(12)
    texts = [c * n for c in ("\U000f1234", "\U00010f3a", "\U00013080") for n in (60, 63, 64, 65, 70)]
    texts += ["".join(rng.choice("\U000f1234\U00010f3a\U00013080\U00013081é") for _ in range(rng.randint(60, 70))) for _ in range(30)]
    for t in texts:
        assert counter.table(t).tolist() == [len(engine.ids(t[:i])) for i in range(len(t) + 1)]
        assert counter.table(t).tolist() == [len(engine.ids(t[:i])) for i in range(len(t) + 1)]  # from the cache
    assert counter.cut("\U000f1234" * 64, 100) == 25


# -- 9, runs are merged as they lie


def above_scans(df):
    """For each scan of a run in the plan, the operators above it up to the join, from below."""
    lines = [(len(x) - len(x.lstrip(" :+-|")), x.lstrip(" :+-|")) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    out = []
    for i, (depth, text) in enumerate(lines):
        if "Scan" in text.split("(")[0] and "line_run_" in text:
            path = []
            for d, t in reversed(lines[:i]):
                if d < depth:
                    depth = d
                    path.append(t.split("(")[0].split(" ")[0].lstrip("*"))
                    if "Join" in t.split("[")[0]:
                        break
            out.append((text, path))
    return out


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_runs_are_merged_without_shuffle_or_sort(spark, fanout):
    from quillon.llm import line_dedup

    rng = random.Random(fanout)
    rows = sorted({(i, rng.randrange(60), rng.randrange(3)) for i in range(200) for _ in range(6)})
    make = lambda lo, hi: spark.createDataFrame([r for r in rows if lo <= r[0] < hi], "id long, h1 long, h2 long").repartition(3)
    store = line_dedup.LineRuns(spark, fanout)
    try:
        for lo in (150, 100, 50, 0):
            store.add(make(lo, lo + 50))
        want = {}
        for i, a, b in rows:
            top, n = want.get((a, b), (0, 0))
            want[a, b] = max(top, i), n + 1
        assert len(store.runs()) == {2: 1, 3: 2, 9: 4}[fanout]
        if len(store.runs()) == 1:
            store.add(make(300, 301))
        with line_dedup._sorted_scans(spark):
            batch = make(0, 50).groupBy("h1", "h2").agg(F.max("id").alias("top"))
            for plan in (store.unseen(batch), store.merged(*store.runs()[:2])):
                found = above_scans(plan)
                assert len(found) == (len(store.runs()) if "top" in plan.columns else 2)
                for scan, path in found:
                    assert "Bucketed: true" in scan and path[-1].startswith("SortMergeJoin") and not {"Sort", "Exchange", "BroadcastExchange"} & set(path), path
            assert store.unseen(batch).count() == 0
        got = {(r.h1, r.h2): r.owner for r in store.repeated(12).collect()}
        assert got == {k: top for k, (top, n) in want.items() if n >= 12}
    finally:
        store.close()
    assert not [t for t in spark.catalog.listTables() if t.name in store.made] and not store.made


# -- 5, longest matches of repeated words


def longest_match(doc, bench, window=10):
    """(words, item, place in the item, place in the document) by trying every pair."""
    w, best = words(doc), None
    for item, text in bench:
        v = words(text)
        need = min(window, len(v))
        for j in range(len(v) - need + 1) if v else ():
            for i in range(len(w)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= need:
                    got = (-n, item, i, j)
                    best = got if best is None or got < best else best
    return (0, None, None, None) if best is None else (-best[0], best[1], best[3], best[2])


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches_of_repeated_words(spark, seed):
    from quillon.llm import decontaminate

    rng = random.Random(seed)
    some = lambda n, k: " ".join(rng.choice("abcdef"[:k]) for _ in range(n))
    bench = [(i, some(rng.choice([0, 1, 3, 9, 10, 14, 40]), rng.choice([1, 2, 3]))) for i in range(14)] + [(3, "a " * 25), (20, "b a " * 12), (21, "q r s"), (22, None)]
    rng.shuffle(bench)
    docs = [(i, some(rng.choice([0, 5, 12, 60]), rng.choice([1, 2, 3, 6]))) for i in range(40)] + [(50, "a " * 90), (51, "x " + bench[0][1] + " y " + (bench[1][1] or "")), (52, "Q R s q"), (53, None)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs).repartition(3), items).collect()
    want = {i: longest_match(t, bench) for i, t in docs}
    assert {r.doc_id: (r.longest_words, r.longest_item, r.longest_item_word, r.longest_doc_word) for r in got} == want


def test_a_document_of_one_word_takes_seconds():
    import time

    from quillon.llm import decontaminate
    from quillon.llm import _kernels as K

    q = decontaminate.prepare([1, 2], ["same " * 2000, "other words"])
    raw = np.frombuffer(b"same " * 100_000, np.uint8)
    h, _, _, first = K.words(raw, np.array([0, len(raw)]), K.ALNUM_WORDS)
    began = time.process_time()
    array = decontaminate.SuffixArray(h, first, q)
    best = array.longest(*array.matches(), first)
    assert best[:, np.lexsort(best[::-1])][:, 0].tolist() == [0, -2000, 1, 0, 0]
    assert time.process_time() - began < 20  # some seconds on a slow machine; pairs of places took most of a minute
