"""Small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing columns, against brute force."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillon.llm import _spark, decontaminate, fingerprint, graph, language, line_dedup, near_dedup, packing, quality, queries, tokens, toxicity, warc
from quillon.llm._spark import scratch
from quillon.llm.features import ngrams
from quillon.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string, _id string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None, len(t or ""), 7, "x", None) for i, t in enumerate(texts)], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "日本"]
    base = [rng.choice(vocab) for _ in range(80)]
    line = "a Line that many documents hold and is long enough " + "x" * 5
    out = [None, "", "   ", "one two", "one two", "ONE two\t", "word " * 3000]
    for k in range(40):
        w = list(base)
        for _ in range(k // 8):
            w[rng.randrange(80)] = rng.choice(vocab)
        out.append(" ".join(w) + ("\n  " + line.upper() + " \n" + line if k % 3 == 0 else ""))
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    return out


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (7, 6), (None, 4), (8, 7), (9, 8)], "a long, b long")
    assert {(r.node, r.component) for r in graph.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6)}


@pytest.mark.parametrize("per_block", [256, 2])
def test_near_duplicates(spark, monkeypatch, per_block):
    monkeypatch.setattr(near_dedup, "PER_BLOCK", per_block)
    ts = texts()
    sets = {}
    for i, t in enumerate(ts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, ts)).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_line_dedup(spark):
    ts = texts(1)
    df = frame(spark, ts)
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in enumerate(ts):
        for x in {key(s) for s in (t or "").split("\n")}:
            if len(x) >= 40:
                held.setdefault(x, []).append(i)
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns[: len(df.columns)] == df.columns
    dropped = 0
    for r in out.collect():
        lines = (ts[r.doc_id] or "").split("\n")
        kept = [s for s in lines if len(held.get(key(s), [])) < 5 or max(held[key(s)]) == r.doc_id]
        dropped += len(lines) - len(kept)
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        assert (r.text or "") == "\n".join(kept)
    assert dropped


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_contamination(spark, block):
    rng = random.Random(3)
    items = [" ".join(f"q{rng.randrange(9)}" for _ in range(n)) for n in (25, 12, 3, 1)] + [None, "--"]
    docs = [None, "", items[2], f"zz {items[0]} zz", f"a. {items[1].upper()}! {items[3]}", " ".join(f"q{rng.randrange(9)}" for _ in range(400))]
    bench = spark.createDataFrame([(10 * i, t) for i, t in enumerate(items)], "item_id long, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, docs), bench, block_bytes=block).collect()}
    for d, t in enumerate(docs):
        w, hit, found = words(t), set(), set()
        for i, item in enumerate(items):
            q = words(item)
            n = min(10, len(q))
            for j in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[j : j + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(10 * i))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256) == (len(w), len(hit), len(found), decontaminate.items_digest(list(found)))
        assert sum(s["end"] - s["begin"] for s in got[d].spans) == len(hit)
    longest = {(r["item"], r["item_word"]): r.n_words for r in decontaminate.longest_matches(frame(spark, docs), bench).collect()}
    assert longest[0, 0] == 25 and longest[20, 0] == 3
    for d, t in enumerate(docs):
        w, best = words(t), None
        for i, item in enumerate(items):
            q = words(item)
            for j, p in itertools.product(range(len(q)), range(len(w))):
                n = next((n for n in range(min(len(q) - j, len(w) - p)) if q[j + n] != w[p + n]), min(len(q) - j, len(w) - p))
                if n >= min(10, len(q)) > 0:
                    best = min(best or (1,), (-n, 10 * i, p, j))
        r = got[d]
        if block > 600 or not best or best[0] >= -10:
            assert (-r.longest_words, r.longest_item, r.longest_doc_word, r.longest_item_word) == (best or (0, None, None, None))


def test_blocks_of_the_benchmark_share_one_scan(spark):
    item = " ".join(f"u{i} v{i % 7}" for i in range(400))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item[:90]), (3, "x " * 300), (None, "x y"), (4, None), (5, "one two")], "item_id long, text string")
    docs = frame(spark, [item, "a " + item[30:170] + " b", "x " * 30, "one", "one two", None, "x y"])
    whole = decontaminate.contamination(docs, bench)
    blocks = decontaminate.contamination(docs, bench, block_bytes=1500)
    assert len(decontaminate._blocks(bench, "item_id", "text", 1500, 10)) >= 3
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(whole.select(cols).collect()) == sorted(blocks.select(cols).collect())
    assert [r.n_items for r in whole.orderBy("doc_id").collect()] == [2, 2, 1, 0, 1, 0, 0]


def test_prefix_counts_match_the_library():
    from tokenizers import Tokenizer

    lib, own, fast = Tokenizer.from_file(tokenizer_path()), tokens.counter(tokenizer_path()), tokens.load(tokenizer_path())
    rng = random.Random(5)
    parts = ["a", "th", "'re", "'", "l", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "<|", "1", "!!", "\t", "ing", "🙂", "x" * 90]
    for _ in range(120):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ref = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert own.table(t).tolist() == ref
        assert own.cut(t, 3) == max(i for i, n in enumerate(ref) if n <= 3)
        assert fast.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_counts_and_packing(spark):
    df = frame(spark, texts(2))
    counts = {r.doc_id: r for r in tokens.token_counts(df, tokenizer_path()).collect()}
    rows = packing.pack_documents(df, tokenizer_path(), group=20).collect()
    own, bins = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum(r.length for r in p) for d, p in own.items()} == {d: c.n_tokens + 1 for d, c in counts.items()}
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    for p in own.values():
        p = sorted(p, key=lambda r: r.piece)
        assert [r.start for r in p] == [sum(x.length for x in p[:i]) for i in range(len(p))] and all(r.length == 1024 for r in p[1:])
    assert len(bins) <= sum(r.length for r in rows) / 1024 + 3


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_warc_round_trip_with_magic_in_payloads(spark, split):
    trap = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    html = [None, "", "é" * 50, trap, trap, "same", "same", trap * 100, "end"] + [f"p{i}" * 40 for i in range(40)]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nA: b", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, record long").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = scratch(spark, "t")
    warc.write_warc(df, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(html)
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r, sha = got[f"urn:page:{i}"], base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ref = first.setdefault(raw, i)
        assert (r.full, r.digest, r.type, r.refers_to, r.ok) == (len(raw), sha, "response" if ref == i else "revisit", None if ref == i else f"urn:page:{ref}", True)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_warc_repeated_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = [(1, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "own"), (3, "own"), (4, None), (5, ""), (5, "own"), (None, "a")]
    path = scratch(spark, "t")
    warc.write_warc(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string"), path)
    first = {}
    for i, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, h in pages:
        ref = None if i is None or first[h or ""] == i else f"urn:page:{first[h or '']}"
        want.append((f"urn:page:{'' if i is None else i}", warc.digest((h or "").encode()), "revisit" if ref else "response", ref or ""))
    assert sorted((r.record_id, r.digest, r.type, r.refers_to or "") for r in warc.read_warc(spark, path).collect()) == sorted(want)


def test_fingerprints(spark):
    ts = texts(4)
    rows = {r.doc_id: r for r in fingerprint.edit_likeness(frame(spark, ts), parts=4).collect()}
    assert len(rows) == len(ts)
    for i, t in enumerate(ts):
        t, nxt = t or "", ts[i - 1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + nxt[:third]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) if t == new else True
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert rows[3].fingerprint == rows[4].fingerprint


def test_likeness_counts_every_anchor(monkeypatch):
    rng = random.Random(11)

    def print_of(text):
        return fingerprint.anchors(np.frombuffer(text.encode(), np.uint8))

    def brute(a, b, reach=fingerprint.TOLERANCE):
        at = [{}, {}]
        for own, (h, p) in zip(at, (a, b), strict=True):
            for x, y in zip(h.tolist(), p.tolist(), strict=True):
                own.setdefault(x, []).append(y)
        pairs = {h: [(x, y) for x in at[0][h] for y in at[1][h]] for h in at[0].keys() & at[1].keys()}
        best = 0
        for d in {x - y - o for both in pairs.values() for x, y in both for o in (0, reach)}:
            near = [[(x, y) for x, y in both if d <= x - y <= d + reach] for both in pairs.values()]
            best = max(best, sum(min(len({x for x, _ in m}), len({y for _, y in m})) for m in near))
        return 2 * best / (len(a[0]) + len(b[0]))

    # repeated anchors by pairs and by correlation
    def correlated(p, q, sa, ca, sb, cb, lo, size, tolerance):
        one = [fingerprint._steps_by_correlation(p[s : s + c], q[t : t + d], int(p.max()), int(q.max()), size, tolerance) for s, c, t, d in zip(sa, ca, sb, cb, strict=True)]
        return sum(one)

    cases = []
    for k in range(40):
        vocab = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range((1, 2, 4, 20)[k % 4])]
        one, two = (" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(2))
        a, b = print_of(one), print_of(one[: len(one) // 2] + two if k % 8 < 4 else two)
        cases.append((a, b, brute(a, b)))
    assert any(len(set(a[0].tolist())) < len(a[0]) for a, _, _ in cases)
    assert all(fingerprint.likeness(a, b) == pytest.approx(w, abs=1e-12) for a, b, w in cases)
    monkeypatch.setattr(fingerprint, "_steps_by_pairs", correlated)
    assert all(fingerprint.likeness(a, b) == pytest.approx(w, abs=1e-12) for a, b, w in cases)
    # a short passage that two long texts share is seen, and their whole fingerprints are stored
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(20_000)]
    for _ in range(10):
        passage = [rng.choice(vocab) for _ in range(60)]
        a, b = (print_of(" ".join([rng.choice(vocab) for _ in range(n)] + passage + [rng.choice(vocab) for _ in range(1500)])) for n in (1500, 1800))
        assert fingerprint.likeness(a, b) > 0
        assert len(a[0]) > 2000 and all((x == y).all() for x, y in zip(fingerprint.decode(fingerprint.encode(a)), a, strict=True))


def test_language_toxicity_and_quality(spark):
    rng = random.Random(8)
    de, en = ["der", "die", "nicht", "schön", "straße", "haus"], ["the", "of", "with", "house", "thing", "these"]
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(30)) + (" scum idiot" if i % 10 == 0 else ""), "de" if i % 2 else "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(df)
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "DER Straßen"), (4, "unthings"), (None, "the")], "doc_id long, text string")
    got = [(r.lang_pred, 0 <= r.score <= 1) for r in language.identify(odd, m).collect()]
    assert got == [("und", True), ("und", True), ("de", True), ("en", True), ("en", True)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0), i % 2) for i in range(200)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    t = toxicity.train(df, labels)
    wrong = [r for r in toxicity.score(df, t).collect() if (r.score >= 0.5) != (r.doc_id % 10 == 0)]
    assert len(wrong) <= 4
    assert toxicity.train(df, labels.limit(0)).weights.size == 0
    out = quality.resample(df, df.where("lang = 'de' and doc_id < 100").select("doc_id"), k=100)
    picked = [r for r in out.collect() if r.selected]
    assert len(picked) == 100 and sum(r.doc_id % 2 for r in picked) >= 95
    keys = sorted((r.gumbel_key for r in out.collect()), reverse=True)
    assert {r.gumbel_key for r in picked} == set(keys[:100])


def test_language_learns_from_more_than_a_few_thousand_documents(spark):
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrst", repeat=4), 6000)]
    rows = spark.createDataFrame([(i, w, "en") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    assert set(language.train(rows).words) == set(words)


def test_toxicity_counts_features_of_every_document(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "house", "thing", "green"]) for _ in range(12)) + (" scum" if i % 10 == 0 else "") + (" zork" if i % 150 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic int")
    raw = np.frombuffer(b"zork", np.uint8)
    rare = int(ngrams(raw, np.array([0, 4]), (1,), toxicity.BITS)[0][0])
    # 14 texts have the word
    one = toxicity.train(docs, labels, steps=2)
    assert rare in one.features.tolist()
    monkeypatch.setattr(_spark, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(toxicity, "broadcast_if_small", lambda df: df)
    assert (toxicity.train(docs, labels, steps=1).features == one.features).all()


def test_quality_counts_every_target(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(4))) for i in range(30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # where every document is a target, both models are equal
    assert queries.op10_importance_resampling(spark, str(tmp_path)).selectExpr("max(abs(log_weight))").first()[0] < 1e-9
    docs = spark.createDataFrame([*rows[:500], (None, "w1 w2"), (3, "w7")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(3,), (None,), (9999,)], "doc_id long")
    few = quality.bucket_counts(docs, ids, "doc_id", "text")
    assert (few[1].sum(), few[0].sum()) == (502 * 7 - 4 - 6, 168 * 7 - 6)  # 4 words and 3 pairs a text
    monkeypatch.setattr(_spark, "BROADCAST_ROWS", 0)
    many = quality.bucket_counts(docs, ids, "doc_id", "text")
    assert (few[0] == many[0]).all() and (few[1] == many[1]).all()


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    assert fingerprint.edit_likeness(none).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.resample(none, none.select("doc_id")).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch(spark, "t")
    warc.write_warc(pages, path)
    assert warc.read_warc(spark, path).count() == 0
