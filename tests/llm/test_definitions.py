"""Operators against their definitions written out, and inputs with nulls, repeats, ties, clashing names and no rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import _kernels as K
from quillon.llm import _spark, decontaminate, fingerprint, language, line_dedup, near_dedup, packing, quality, tokens, toxicity
from quillon.llm.features import ngrams
from quillon.llm.queries import tokenizer_path


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


# -- 1


def test_language_is_word_first_backoff(spark):
    rng = random.Random(1)
    sylls = {"de": ["sch", "ung", "ö", "ein"], "en": ["th", "ing", "ou", "an"]}
    rows = [(i, " ".join("".join(rng.choice(sylls[g]) for _ in range(rng.randint(1, 3))) for _ in range(12)), g) for i in range(60) for g in ("de", "en")]
    rows += [(1, None, "de"), (2, "x", None), (None, "thanks", "en")]
    model = language.train(frame(spark, rows, "doc_id long, text string, lang string"), max_words=None, max_grams=None)
    word = re.compile(r"[^\W\d_]+")
    counts = {}
    for _, t, g in rows:
        if t is None or g is None:
            continue
        for w in word.findall(t.lower()):
            for n in range(6):
                for x in [w] if n == 0 else [(f"#{w}#" if n > 1 else w)[i : i + n] for i in range(len(f"#{w}#" if n > 1 else w) - n + 1)]:
                    counts.setdefault((n, g), Counter())[x] += 1
    kinds = {n: set(counts[n, "de"]) | set(counts[n, "en"]) for n in range(6)}

    def weight(n, x, g):
        return math.log((counts[n, g][x] + 0.5) / (sum(counts[n, g].values()) + 0.5 * (len(kinds[n]) + 1)))

    def brute(t):
        ws, z = word.findall((t or "").lower()), {"de": 0.0, "en": 0.0}
        for w in ws:
            for n in (0, 5, 4, 3, 2, 1):
                xs = [w] if n == 0 else [(f"#{w}#" if n > 1 else w)[i : i + n] for i in range(len(f"#{w}#" if n > 1 else w) - n + 1)]
                xs = [x for x in xs if x in kinds[n]]
                if xs:
                    for g in z:
                        z[g] += sum(weight(n, x, g) for x in xs) / len(xs)
                    break
        if not ws:
            return "und", 0.0
        best = min(z, key=lambda g: (-z[g], g))
        return best, 1 / sum(math.exp((v - z[best]) * min(len(ws), 20) / len(ws)) for v in z.values())

    texts = [None, "", "12 -", "qqq", "thing", "Schung", "ungs thing", "x", "anan " * 4000, "thing"] + [r[1] for r in rows[:6]]
    odd = frame(spark, [(i, t, "q", 1) for i, t in enumerate(texts)] + [(3, "qqq", "q", 1), (None, "an", "q", 1)], "doc_id long, text string, lang_pred string, ID int")
    got = language.identify(odd, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute("an" if r.doc_id is None else texts[r.doc_id])
        assert (r.lang_pred, r.score) == (want[0], pytest.approx(want[1], abs=1e-9))
    # no letter known at all: equal evidence, the first language
    assert brute("qqq") == ("de", 0.5)


# -- 2


def test_prefix_tables_and_counts(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(tokenizer_path()), random.Random(3)
    parts = ["a", "the", "'re", "'s", "'", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "<|endof", "!!", "\u0301", "\u00a0", "²"]
    texts = [None, "", "x" * 300, " " * 50] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    size = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    df = frame(spark, [(i, t, 5) for i, t in enumerate(texts)] + [(None, "a", 5), (1, "", 5)], "doc_id long, text string, N_TOKENS int")
    tables = {r.doc_id: r.counts for r in tokens.prefix_tables(df, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        assert tables[i] == [size((t or "")[:k]) for k in range(len(t or "") + 1)]
        for limit in (0, 3, 9):
            assert tokens.within(np.array(tables[i]), limit) == max(k for k, n in enumerate(tables[i]) if n <= limit)
    rows = tokens.token_counts(df, tokenizer_path(), limit=9).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = "a" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) == (len(t.encode()), size(t), size(t) > 9, max(k for k in range(len(t) + 1) if size(t[:k]) <= 9))
    assert tokens.token_counts(df.limit(0), tokenizer_path()).count() == tokens.prefix_tables(df.limit(0), tokenizer_path()).count() == 0


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 5000)
    own = tokens.PrefixCounter(tokenizer_path())
    for i in range(500):
        own.boundaries(f"w{i} {'z' * 5000}{i}")
    assert own.held < 6000 and max(map(len, own.tables)) <= tokens.LONGEST


def test_counts_keep_numbers_and_not_tables(monkeypatch):
    """Of so many pretokens the tables do not fit the bound, their numbers do: a second pass makes no table but those at a limit."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 60_000)
    own, lib, rng = tokens.PrefixCounter(tokenizer_path()), tokens.load(tokenizer_path()), random.Random(4)
    words = [f"w{i}" for i in range(250)] + ["é", "日本", "'re", "'", "\n", "\n\n", " ", "  ", "\u00a0", "!!", "x" * 90]
    texts = ["", " ", "\n"] + [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a <|endoftext|> b <|endof", "<|endoftext|>"]
    want = [(len(lib.ids(t)), {n: max(i for i in range(len(t) + 1) if len(lib.ids(t[:i])) <= n) for n in (0, 5, 40)}) for t in texts]
    for limit in (0, 5, 40):
        assert [own.counted(t, limit) for t in texts] == [(n, fit[limit]) for n, fit in want]
    made = []
    table = own.piece_table
    monkeypatch.setattr(own.totals, "table", lambda raw: made.append(raw) or table(raw))
    assert [own.counted(t, 1 << 20)[0] for t in texts] == [n for n, _ in want]
    assert all(len(raw.decode()) > tokens.LONGEST for raw in made)
    for i in range(5000):
        own.counted(f"v{i} {'z' * 5000}{i}", 9)
    assert own.totals.held < 62_000 and len(own.totals) + len(own.totals.older) < 1000 and max(map(len, own.totals)) <= tokens.LONGEST


# -- 4, 9, 5 on repeats and nulls


def test_near_duplicates_with_nulls_and_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(9, a), (9, b), (3, a), (None, a), (None, None), (7, b), (7, b), (1, "lone words"), (2, "Lone  words"), (4, "")]
    got = near_dedup.near_duplicates(frame(spark, [(*r, "z", 1) for r in rows], "doc_id long, text string, component_id string, KEPT int"))
    want = [(9, 56, 3, False), (9, 56, 7, False), (3, 56, 3, True), (None, 56, None, True), (None, 0, None, True), (7, 56, 7, True), (7, 56, 7, True), (1, 1, 1, True), (2, 1, 1, False), (4, 0, 4, True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_first_rows_of_a_large_bucket(spark):
    rows = [(1, i, i * 7 % 13) for i in range(500)] + [(2, i, 1) for i in range(3)]
    got = near_dedup._first_rows(frame(spark, rows, "bucket long, rep long, u long"), 20).collect()
    want = {(b, r): i + 1 for b in (1, 2) for i, (_, r) in enumerate(sorted((u, r) for x, r, u in rows if x == b)[:20])}
    assert {(r.bucket, r.rep): r.r for r in got} == want


def test_line_dedup_with_clashing_names_nulls_and_repeats(spark):
    line = "the same line of more than forty code points, again"
    rows = [(i, f"own {i}\n{line}", 99, "s") for i in range(6)] + [(None, line, 99, "s"), (5, f"{line}\n{line}", 99, "s"), (8, None, 99, "s"), (9, "", None, None)]
    docs = frame(spark, rows, "doc_id long, text string, N_Dropped int, kept_sha256 string")
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect())
    want = [(str(i), f"own {i}", 2, 1) for i in range(5)] + [("5", f"own 5\n{line}", 2, 0), ("5", f"{line}\n{line}", 2, 0), ("None", line, 1, 0), ("8", None, 1, 0), ("9", "", 1, 0)]
    assert got == sorted(want, key=lambda x: (x[0], x[1])) or sorted(map(str, got)) == sorted(map(str, want))
    named = line_dedup.drop_repeated_lines(docs, measures=("a", "b", "c"))
    assert named.columns == [*docs.columns, "a", "b", "c"] and {r.N_Dropped for r in named.collect()} == {99, None}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_decontaminate_keeps_columns_and_null_ids(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = frame(spark, [(1, item, 1, 2), (1, "clean", 1, 2), (2, "clean", 1, 2), (None, item, 1, 2), (3, None, 1, 2)], "doc_id long, text string, gone int, _hit int")
    out = decontaminate.decontaminate(docs, frame(spark, [(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None"]


# -- 6


def dense_nnpu(x, positive, prior, steps, rate=toxicity.RATE, l2=toxicity.L2):
    """The risk and Adam written out on a matrix."""
    p, n = x[positive], len(x)
    w, m, v = np.zeros(x.shape[1] + 1), 0, 0
    w[-1] = math.log(prior / (1 - prior))
    one = lambda a: np.concatenate([a, np.ones((len(a), 1))], axis=1)
    p, x = one(p), one(x)
    for step in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(p @ w))), 1 / (1 + np.exp(-(x @ w)))
        negative = np.log1p(np.exp(x @ w)).sum() / n - prior * np.log1p(np.exp(p @ w)).mean()
        down = x.T @ su / n - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + down if negative >= 0 else -down
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def test_toxicity_minimises_the_risk_over_all_rows(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(6)) + (" foul vile" if i % 7 == 0 else " fine")) for i in range(140)] + [(None, "foul"), (500, None), (0, "foul foul")]
    docs = frame(spark, rows).repartition(5)
    labels = frame(spark, [(i, int(i % 7 == 0)) for i in range(70)] + [(7, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_TASK_BYTES", 64)
    model = toxicity.train(docs, labels, steps=25)
    kept = [(i, t) for i, t in rows if i is not None and t is not None]
    sets = []
    for _, t in kept:
        raw = np.frombuffer(t.encode(), np.uint8)
        sets.append(set(ngrams(raw, np.array([0, len(raw)]), bits=toxicity.BITS)[0].tolist()))
    positive = np.array([i % 7 == 0 and i < 70 for i, _ in kept])
    n_p, n_u = positive.sum(), len(kept)
    count = Counter(f for s in sets for f in s)
    own = Counter(f for s, y in zip(sets, positive, strict=True) if y for f in s)
    xlog = lambda k, n, q: k * math.log(min(max(q, 1e-12), 1 - 1e-12)) + (n - k) * math.log(1 - min(max(q, 1e-12), 1 - 1e-12))
    ratio = {f: 2 * (xlog(own[f], n_p, own[f] / n_p) + xlog(c, n_u, c / n_u) - xlog(own[f], n_p, (own[f] + c) / (n_p + n_u)) - xlog(c, n_u, (own[f] + c) / (n_p + n_u))) for f, c in count.items()}
    features = sorted(f for f in own if own[f] / n_p > count[f] / n_u and ratio[f] > 2 * math.log(len(own)))
    assert model.features.tolist() == features and features
    prior = 11 / 71
    assert model.prior == pytest.approx(prior)
    x = np.array([[float(f in s) for f in features] for s in sets])
    want = dense_nnpu(x, positive, prior, 25)
    assert np.allclose(np.append(model.weights, model.bias), want, atol=1e-6)
    got = toxicity.score(frame(spark, [(1, "foul"), (1, "foul"), (2, None), (3, ""), (None, "vile " * 9000)]), model).collect()
    none = 1 / (1 + math.exp(-model.bias))
    assert [r.score for r in got[2:4]] == [pytest.approx(none)] * 2 and got[0].score == got[1].score > none and got[4].score > none
    # no rows, no positive: the prior
    assert toxicity.score(docs.limit(0), model).count() == 0
    for m in (toxicity.train(docs.limit(0), labels), toxicity.train(docs, labels.where("toxic = 0"))):
        assert len(m.features) == 0 and 0 < 1 / (1 + math.exp(-m.bias)) < 0.5


# -- 7


def test_closed_syncmers_by_definition(spark):
    rng = random.Random(9)
    texts = ["", "short", "a" * 200, "".join(rng.choice("abcdefgh ") for _ in range(400)), "é日本 " * 40]

    def brute(raw, k=fingerprint.K_BYTES, s=fingerprint.S_BYTES):
        value = lambda a, b: int(K.span_hash(K.prefix_hash(np.frombuffer(raw[a:b], np.uint8)), np.array([0]), np.array([b - a]))[0])
        out = []
        for i in range(len(raw) - k + 1):
            inner = [value(j, j + s) for j in range(i, i + k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                out.append((value(i, i + k), i))
        return out or ([(value(0, len(raw)), 0)] if raw else [])

    for t in texts:
        raw = t.encode()
        h, at = fingerprint.anchors(np.frombuffer(raw, np.uint8))
        assert sorted(zip(h.tolist(), at.tolist(), strict=True)) == sorted(brute(raw))
        text = fingerprint.encode((h, at))
        assert len(base64.b64decode(text)) == 9 * len(h)


def test_texts_are_shuffled_packed(spark):
    """Nothing but the row's place and its packed text goes through the shuffle, in less than lz4 makes of it."""
    import pyarrow as pa

    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [None, "", "é\n", "日本" * 40_000] + [" ".join(rng.choice(vocab) for _ in range(500)) for _ in range(60)]
    rows = fingerprint.with_next(frame(spark, list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 3)
    assert rows.columns == ["part", "tail", "id", "packed"]
    held = [r for r in rows.collect() if not r.tail]
    assert {r.id: fingerprint.unpack(bytes(r.packed)) for r in held} == {i: (t or "").encode() for i, t in enumerate(texts)}
    plain = b"".join(t.encode() for t in texts[4:])
    lz4 = sum(len(pa.compress(plain[i : i + 32768], codec="lz4", asbytes=True)) for i in range(0, len(plain), 32768))
    assert sum(len(r.packed) for r in held if r.id >= 4) < 0.9 * lz4


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_of_successors(spark, parts):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(rng.randrange(30), t) for t in base] + [(None, t) for t in base[:9]] + [(100, None), (-5, "é" * 50), (3, base[0]), (3, base[0])]
    docs = frame(spark, [(i, t, 1, True) for i, t in rows], "doc_id long, text string, part int, TAIL boolean").repartition(4)
    got = fingerprint.edit_likeness(docs, parts=parts).collect()
    hashes = {r.t: r.h for r in frame(spark, [(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        own, other, follow = (fingerprint.anchors(np.frombuffer(x.encode(), np.uint8)) for x in (t, new, nxt))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.encode(own), fingerprint.encode(other), fingerprint.likeness(own, other), fingerprint.likeness(own, follow)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# -- 8


@pytest.mark.parametrize("early", [True, False])
def test_sum_of_squares_by_definition(early):
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randint(5, 30)
        sizes = [rng.randint(1, capacity - 1) for _ in range(60)]
        bins, offsets, fill = packing.sum_of_squares(np.array(sizes), capacity, early)
        state = []
        for s, b, o in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):

            def squares(x):
                return sum(c * c for c in Counter(capacity - v for v in x if v < capacity).values())

            fits = [i for i, v in enumerate(state) if v + s <= capacity]
            costs = {i: squares([*state[:i], state[i] + s, *state[i + 1 :]]) for i in fits}
            if early or not fits:
                costs[len(state)] = squares([*state, s])
            state += [0] * (b == len(state))
            assert costs[b] == min(costs.values()) and state[b] == o
            state[b] += s
        assert state == fill.tolist()


def test_packing_of_all_lengths_and_ids(spark):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(tokenizer_path()), random.Random(6)
    texts = [None, "", "w " * 5000] + ["word " * rng.randint(1, 900) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 1), (None, "x y", 1)]
    got = packing.pack_documents(frame(spark, rows, "doc_id long, text string, Offset int"), tokenizer_path(), group=30).collect()
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    assert len(docs[4]) == 2 * len({r.piece for r in docs[4]})
    for i, t in [*enumerate(texts), (None, "x y")]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        for r in docs[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in docs[i]) == len(ids) * (1 + (i == 4))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 5


def test_packing_of_sizes_that_never_fill_and_of_one_group(spark):
    parts = spark.range(300).select("id", F.lit(700).cast("long").alias("length"))
    out = packing.pack(parts, group=50)
    assert out.select("sequence_id").distinct().count() == 300
    rng = random.Random(1)
    sizes = spark.createDataFrame([(i, rng.randint(1, 400)) for i in range(3000)], "id long, length long")
    one, many = (packing.pack(sizes, group=g).select("sequence_id").distinct().count() for g in (None, 600))
    bound = -(-sizes.agg(F.sum("length")).first()[0] // 1024)
    assert bound <= one <= bound + 1 and bound <= many <= bound + 5  # a sequence a group


# -- 10


def test_importance_and_gumbel_by_definition(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab[: 20 + 20 * (i % 3 == 0)]) for _ in range(15))) for i in range(90)] + [(200, None), (201, ""), (None, "v1 v2"), (5, "v3 v3")]
    docs = frame(spark, [(*r, 0, 1.0) for r in rows], "doc_id long, text string, selected int, LOG_WEIGHT double")
    aims = frame(spark, [(i,) for i in range(0, 90, 3)] + [(None,), (5000,)], "doc_id long")
    got = quality.resample(docs, aims, k=30).collect()

    def buckets(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return ngrams(raw, np.array([0, len(raw)]), bits=quality.BUCKET_BITS)[0].tolist()

    def words_and_pairs(t):
        w = re.findall("[0-9a-z]+", t or "")
        return len(w) + max(0, len(w) - 1)

    target = Counter(b for i, t in rows if i is not None and i % 3 == 0 and i < 90 for b in buckets(t))
    raw = Counter(b for _, t in rows for b in buckets(t))
    n = 1 << quality.BUCKET_BITS
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n))
    noise = {r.i: ((r.h >> 11) & ((1 << 53) - 1), r.i) for r in frame(spark, [(r.doc_id,) for r in got if r.doc_id is not None], "i long").select("i", F.xxhash64("i", F.lit(7)).alias("h")).distinct().collect()}
    left, keys = list(rows), []
    for r in got:
        t = next(x for x in left if x[0] == r.doc_id and words_and_pairs(x[1]) == r.n_grams and r.log_weight == pytest.approx(sum(map(ratio, buckets(x[1]))), abs=1e-9))
        left.remove(t)
        if r.doc_id is None:
            assert r.gumbel_key is None and not r.selected
        else:
            u = (noise[r.doc_id][0] + 0.5) / (1 << 53)
            assert r.gumbel_key == pytest.approx(r.log_weight - math.log(-math.log(u)), abs=1e-9)
            keys.append((-r.gumbel_key, r.doc_id, r.selected))
    assert not left
    keys.sort()
    assert [k[2] for k in keys] == [True] * 30 + [False] * (len(keys) - 30)
    # ties of the key: the smaller id; a single value; more asked than there are
    flat = frame(spark, [(i, float(i // 4)) for i in range(20)], "id long, x double")
    assert [quality.top_k_bound(flat, "x", k) for k in (1, 4, 5, 20)] == [4.0, 4.0, 3.0, None]
    assert quality.top_k_bound(flat.where("x = 1"), "x", 2) == 1.0


# -- shared


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        _spark.shared_dir(Session())


def test_free_names(spark):
    df = frame(spark, [], "Gone int, gone_ int")
    assert _spark.free_name("gone", df) == "gone__" and _spark.free_name("x", df) == "x"
