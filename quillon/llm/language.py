"""Language identification by word-first backoff.

A word known from training is scored by its log frequency in each language.
An unseen word falls back to its longest character n-grams (``#`` marks its
ends) of which any is known, from ``max_n`` letters down to single letters,
and is scored by their mean log frequency.  A text is scored by the sum over
its words.

Training counts words and n-grams on the executors, over a sample of about
``max_docs`` labelled documents per language, and keeps the ``max_words`` most
frequent words and ``max_grams`` n-grams of each length, None for all of the
sample's: the model's size does not grow with the corpus.  A word that is cut
off is scored by its n-grams, as an unseen one.  Prediction is a scan without
a shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import arrow_map, cut

MAX_DOCS, MAX_WORDS, MAX_GRAMS, MAX_N = 20_000, 60_000, 20_000, 5
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Bytes of rows of unseen words that a worker remembers, and such words at most.
_CACHE_BYTES, _CACHE = 16 << 20, 400_000


def text_words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def grams(word: str, n: int) -> list[str]:
    padded = f"#{word}#" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class LanguageModel:
    def __init__(self, langs: list[str], tables: dict[int, tuple[dict[str, int], np.ndarray]]):
        """tables[0]: words, tables[n]: n-grams, each to a row of log frequencies by language."""
        self.langs, self.tables = langs, tables
        self.words, known = tables.get(0, ({}, np.zeros((0, len(langs)))))
        self.n_known = len(known)
        # rows of known words, then of unseen ones met so far
        self.room = max(1000, min(_CACHE, _CACHE_BYTES // (8 * max(1, len(langs)))))
        self.rows = np.concatenate([known, np.zeros((self.room, len(langs)))])
        self.unseen: dict[str, int] = {}

    def __getstate__(self):
        return self.langs, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def from_counts(cls, rows: list[tuple[int, str, str, int]], alpha: float = 0.5) -> LanguageModel:
        """rows: (order, entry, language, count); order 0 is words."""
        langs = sorted({r[2] for r in rows})
        at = {g: i for i, g in enumerate(langs)}
        counts: dict[int, dict[str, np.ndarray]] = {}
        for n, entry, lang, c in rows:
            counts.setdefault(n, {}).setdefault(entry, np.zeros(len(langs)))[at[lang]] += c
        tables = {}
        for n, table in counts.items():
            c = np.array(list(table.values()))
            tables[n] = {e: i for i, e in enumerate(table)}, np.log((c + alpha) / (c.sum(axis=0) + alpha * (len(c) + 1)))
        return cls(langs, tables)

    def _row(self, word: str) -> int:
        """Row of a word that training did not see."""
        at = self.unseen.get(word)
        if at is None:
            if len(self.unseen) >= self.room:
                self.unseen.clear()
            at = self.unseen[word] = self.n_known + len(self.unseen)
            self.rows[at] = self._back_off(word)
        return at

    def word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        return self.rows[self._row(word) if at is None else at]

    def _back_off(self, word: str) -> np.ndarray | float:
        for n in sorted((n for n in self.tables if n), reverse=True):
            table, rows = self.tables[n]
            found = [table[g] for g in grams(word, n) if g in table]
            if found:
                return rows[found].sum(axis=0) / len(found)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the evidence in 0..1); ties go to the first language in alphabetical order."""
        counts = text_words(text)
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        total, known = np.zeros(len(self.langs)), self.words.get
        items = list(counts.items())
        # rows of unseen words may be reused after so many new ones
        for i in range(0, len(items), self.room // 2):
            part = items[i : i + self.room // 2]
            if len(self.unseen) + len(part) > self.room:
                self.unseen.clear()
            at = [known(w, -1) for w, _ in part]
            at = [self._row(w) if a < 0 else a for a, (w, _) in zip(at, part, strict=True)]
            total += np.array([c for _, c in part], float) @ self.rows[at]
        best = int(total.argmax())
        n = sum(counts.values())
        # words of a text are not independent: at most 20 of them count as evidence
        z = (total - total[best]) * (min(n, 20) / n)
        return self.langs[best], float(1 / np.exp(z).sum())


def train(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_words: int | None = MAX_WORDS, max_grams: int | None = MAX_GRAMS, max_n: int = MAX_N) -> LanguageModel:
    """Learn from (text, language) rows; rows without either are skipped, rows that repeat count each.  No rows give a model that predicts ``und``.

    Among equally frequent entries at a cut, the first in alphabetical order stay.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in per.items():
        if n > max_docs:
            share = F.when(F.col("lang") == lang, F.lit(max_docs / n)).otherwise(share)
    sample = rows.where("text is not null").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))

    def tally(batches, entries, names: list[str], types: list[pa.DataType]):
        """Sums of the (key, count) pairs of each batch's entries, as rows of the key's fields and the sum."""
        counts: Counter = Counter()

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate(types)] + [pa.array(list(counts.values()), pa.int64())], [*names, "c"])
            counts.clear()
            return out

        for batch in batches:
            for key, c in entries(batch):
                counts[key] += c
                if len(counts) > 300_000:
                    yield flush()
        if counts:
            yield flush()

    def words_of(batch):
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for w, c in text_words(text.as_py()).items():
                yield (w, lang), c

    def grams_of(batch):
        for w, lang, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            for n in range(1, max_n + 1):
                for g in grams(w, n):
                    yield (n, g, lang), c

    # n-grams are counted over the distinct words, weighted by the words' counts
    words = sample.select("text", "lang").mapInArrow(lambda b: tally(b, words_of, ["entry", "lang"], [pa.string(), pa.string()]), "entry string, lang string, c long")
    words = cut(words.groupBy("entry", "lang").agg(F.sum("c").alias("c")))
    parts = words.mapInArrow(lambda b: tally(b, grams_of, ["n", "entry", "lang"], [pa.int32(), pa.string(), pa.string()]), "n int, entry string, lang string, c long")
    parts = parts.groupBy("n", "entry", "lang").agg(F.sum("c").alias("c"))
    counted = words.select(F.lit(0).alias("n"), "entry", "lang", "c").union(parts)
    counted = cut(counted)
    whole = counted.groupBy("n", "entry").agg(F.sum("c").alias("t"))
    got: list[tuple[int, str, str, int]] = []
    for n in range(max_n + 1):
        most = max_words if n == 0 else max_grams
        own = counted.where(F.col("n") == n)
        if most is not None:
            best = whole.where(F.col("n") == n).orderBy(F.desc("t"), "entry").limit(most).select("entry")
            own = own.join(F.broadcast(best), "entry")
        got += [tuple(r) for r in own.select("n", "entry", "lang", "c").collect()]
    return LanguageModel.from_counts(got)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row.

    Defined cases: a null text, or one without letters, is ``und`` with score 0; ties go to the first language in
    alphabetical order; repeated rows are each answered, null ids kept; very long texts are scored whole; an empty table
    gives an empty table; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        got = [sent.value.predict(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
