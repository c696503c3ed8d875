"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, filter_audit, fingerprint, language, line_dedup, near_dedup, packing, quality, substring_dedup, target_resampling, tokens, toxicity, warc
from quillon.llm._spark import fold, load, scratch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(load(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1), F.lit("")).cast("long")
    return warc.read_warc(spark, path).select(
        number("record_id").alias("page_id"), F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    seen = fold("doc_id", 5) != 0
    model = toxicity.train(docs.where(seen), load(spark, sf_dir, "labels").where(seen))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(load(spark, sf_dir, "documents"), keep_text=False)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language, op2_token_counts, op3_warc, op4_near_duplicates, op5_decontamination, op6_toxicity, op7_fingerprints, op8_packing, op9_line_dedup, op10_importance_resampling,
        op11_target_resampling, op12_substring_dedup, op13_filter_audit,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, strlen(body) AS n, array_to_string(list_transform(range(8), lambda g:
                 array_to_string(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, g::INT * 5 + 1, 5))::BIGINT >> s) & 31)::INT, 1)), '')), '') AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest)
        SELECT page_id::BIGINT AS page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END::BIGINT AS refers_to
        FROM d JOIN f USING (digest)""",
    "op4_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        i AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM i),
        p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
        h AS (SELECT doc_id, p.n, k, item_id, j FROM p JOIN i ON i.n = p.n AND i.x = array_to_string(p.w[k:k + p.n - 1], ' ')),
        q AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM h) GROUP BY doc_id),
        runs AS (SELECT doc_id, n, item_id, k, j, k - row_number() OVER (PARTITION BY doc_id, n, item_id, k - j ORDER BY k) AS run FROM h),
        longest AS (SELECT doc_id, item_id, min(k) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + n - 1 AS words FROM runs GROUP BY doc_id, n, item_id, k - j, run),
        top AS (SELECT * FROM longest QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item_id, doc_word, item_word) = 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(words, 0)::BIGINT AS longest_words,
               top.item_id::BIGINT AS longest_item, item_word::BIGINT AS longest_item_word, doc_word::BIGINT AS longest_doc_word
        FROM d LEFT JOIN q USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN top USING (doc_id)""",
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
        r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, line, pos, (owner IS NOT NULL AND owner <> k.doc_id) AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op11_target_resampling": f"""
        WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS tbl),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
        words AS (SELECT x, xor(list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(x), 2 * i::INT + 1, 2))::BIGINT),
                     lambda c, v: xor(tbl[(xor(c, v) & 255)::INT + 1], c >> 8), 4294967295), 4294967295) % 10000 AS slot
                  FROM (SELECT x FROM dw UNION SELECT x FROM bw), crc),
        s AS (SELECT slot, count(*) AS s FROM dw JOIN words USING (x) GROUP BY slot), t AS (SELECT slot, count(*) AS t FROM bw JOIN words USING (x) GROUP BY slot),
        n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
        g AS (SELECT slot, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (slot), n),
        v AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN words USING (x) JOIN g USING (slot) GROUP BY doc_id),
        r AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN v USING (doc_id)),
        k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS n FROM r WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN i <= n * 10 // 100 THEN i END::BIGINT AS rank FROM r LEFT JOIN k USING (doc_id)""",
    "op12_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        b AS (SELECT doc_id, n, unnest(range(0, n - 99, 100)) AS j, h FROM d WHERE n >= 100),
        c AS (SELECT doc_id, n, j, substr(h, 2 * j + 1, 400) AS h FROM b),
        w AS (SELECT doc_id, j + unnest(range(least(100, n - 99 - j))) AS x, substr(h, 2 * unnest(range(least(100, n - 99 - j))) + 1, 200) AS s FROM c),
        r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY s ORDER BY doc_id, x) AS i FROM w),
        g AS (SELECT doc_id, x, sum(CASE WHEN x <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY x) AS span
              FROM (SELECT doc_id, x, lag(x, 1, -1000) OVER (PARTITION BY doc_id ORDER BY x) AS before FROM r WHERE i > 1)),
        p AS (SELECT doc_id, min(x) AS lo, max(x) + 100 AS hi FROM g GROUP BY doc_id, span),
        k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS kept_from FROM p),
        a AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS tail,
                string_agg(substr(h, 2 * kept_from + 1, 2 * (lo - kept_from)), '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op13_filter_audit": """
        WITH f AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                       regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS bad,
                     coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
              FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
        c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY ALL),
        x AS (SELECT unnest(range(1, 6)) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        r AS (SELECT part, p, i AS step, n, g, t, bad[p[i]::INT] AS fails, list_bool_or(list_transform(p[:i - 1], lambda j: bad[j::INT])) AS gone,
                     list_sum(list_transform(bad, lambda z: z::INT)) AS n_bad FROM c, o, x),
        s AS (SELECT part, array_to_string(list_transform(p, lambda j: substr('ABCDE', j::INT, 1)), '') AS filter_order, step, substr('ABCDE', p[step]::INT, 1) AS filter,
                sum(n) FILTER (NOT fails AND NOT coalesce(gone, false)) AS kept, sum(n) FILTER (fails AND NOT coalesce(gone, false)) AS removed,
                sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND n_bad = 1) AS unique_fails,
                sum(g) FILTER (fails AND NOT coalesce(gone, false)) AS good_lost, sum(t) FILTER (fails AND NOT coalesce(gone, false)) AS toxic_lost
              FROM r GROUP BY part, p, step)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
               coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM s""",
}
