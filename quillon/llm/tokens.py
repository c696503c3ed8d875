"""Byte-level BPE token ids and exact token counts of every prefix.

``load`` reads the tokenizers JSON at a path.  Ids come from the same ranks run
by a faster engine when the file allows (plain byte-level BPE whose ids follow
the order of its merges), else from the tokenizers library itself.

``PrefixCounter`` counts by dynamic programming.  Within a pretoken the
encoding of a prefix ends in token t exactly if t is a suffix of it, the
encoding of what precedes ends in some token u, and (u, t) is its own
encoding; so one pass over the pretoken stores the token count of every
prefix.  The tables of pretokens are kept by a worker, within a bound in bytes,
and a text's table is these tables set end to end.  Where only a text's count and
the place of a limit are asked for, the last number of each table is kept instead, and
tables are made for the pretokens at the limit.  A prefix that ends within a
pretoken splits like the text but in three places, which have tables of their
own: a run of white space is one pretoken as long as nothing follows, an
unfinished contraction is an apostrophe and letters, and an unfinished special
string is ordinary text.  Limits, truncation and budgets are then read off the
table; nothing is encoded again.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import arrow_map

#: The pretoken pattern of byte-level BPE files with use_regex.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of tables that a worker remembers in each of two generations, about; longer pretokens are not kept; token pairs.
CACHE_BYTES, LONGEST, CACHE = 48 << 20, 64, 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Engine:
    """ids(text) as the tokenizers library gives them, without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model, pre = path, spec["model"], spec.get("pre_tokenizer") or {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_alphabet()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
        order = [model["vocab"].get(m, -1) for m in merged]
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(set(t) <= set(letters) for t in model["vocab"]) and len(model["vocab"]) == 256 + len(merged)
            and order == sorted(order) and len(set(order)) == len(order)
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if plain:
            import tiktoken

            self.ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
            self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            self.ranks, self._fast, self._slow = None, None, Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None:
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, raw: bytes) -> list[int]:
        return self._fast._encode_single_piece(raw)


@lru_cache(maxsize=4)
def load(path: str) -> Engine:
    return Engine(path)


class Totals(dict):
    """pretoken: its tokens, the last number of its table; in two generations of about CACHE_BYTES each."""

    def __init__(self, table):
        super().__init__()
        self.table, self.older, self.held = table, {}, 0

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = self.table(piece.encode())[-1]
        if len(piece) <= LONGEST:
            if self.held > CACHE_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = n
            self.held += 150 + 4 * len(piece)
        return n


class PrefixCounter:
    """Token counts of all prefixes, for engines with ranks."""

    def __init__(self, path: str):
        self.engine = load(path)
        if self.engine.ranks is None:
            raise ValueError(f"{path}: prefix counts need a plain byte-level BPE file")
        self.ranks = self.engine.ranks
        self.tokens = {i: t for t, i in self.ranks.items()}
        # finds all tokens that end at each byte in one pass
        self.finder = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.finder.add_word(t.decode("latin-1"), (len(t), i))
        self.finder.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.engine.special, key=len, reverse=True))) if self.engine.special else None
        self.pairs: dict[int, bool] = {}
        # pretoken: (tokens, token count before each code point and at the end)
        self.tables: dict[str, tuple[int, np.ndarray]] = {}
        self.older: dict[str, tuple[int, np.ndarray]] = {}
        self.held = 0
        self.totals = Totals(self.piece_table)

    def _follows(self, u: int, t: int) -> bool:
        """Whether tokens u, t are the encoding of their bytes."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        ok = self.pairs[u << 32 | t] = self.engine.piece(self.tokens[u] + self.tokens[t]) == [u, t]
        return ok

    def piece_table(self, raw: bytes) -> list[int]:
        """count[i]: tokens of raw[:i], for i from 0 to len(raw)."""
        pairs = self.pairs
        count, last = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (size, t) in self.finder.iter(raw.decode("latin-1")):
            i = end + 1
            if count[i]:
                continue
            j = i - size
            if j:
                u = last[j]
                ok = pairs.get(u << 32 | t)
                if ok is None:
                    ok = self._follows(u, t)
                if not ok:
                    continue
            count[i] = count[j] + 1
            last[i] = t
        return count

    def entry(self, piece: str) -> tuple[int, np.ndarray]:
        """(tokens of a pretoken, its table by code point)."""
        got = self.tables.get(piece) or self.older.get(piece)
        if got is None:
            raw = piece.encode()
            count = self.piece_table(raw)
            if len(raw) > len(piece):
                data = np.frombuffer(raw, np.uint8)
                table = np.array(count, np.int32)[np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))]
            else:
                table = np.array(count, np.int32)
            got = count[-1], table.astype(np.uint8) if len(raw) < 256 else table  # at most a token a byte
        if len(piece) <= LONGEST:
            if self.held > CACHE_BYTES:
                self.tables, self.older, self.held = {}, self.tables, 0
            if piece not in self.tables:
                self.tables[piece] = got
                self.held += 300 + 4 * len(piece) + got[1].nbytes
        return got

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Pretokens in order; True marks a special string."""
        if self.special is None or not self.special.search(text):
            return [(p, False) for p in self.pattern.findall(text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(p, False) for p in self.pattern.findall(text[at : m.start()])] + [(m.group(), True)]
            at = m.end()
        return out + [(p, False) for p in self.pattern.findall(text[at:])]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[str, bool]]]:
        """(code points, tokens) before each pretoken and at the end: the table at pretokens."""
        pieces = self.pieces(text)
        chars = np.fromiter((len(p) for p, _ in pieces), np.int64, len(pieces))
        known, entry = self.tables.get, self.entry
        tokens = np.fromiter((1 if s else (known(p) or entry(p))[0] for p, s in pieces), np.int64, len(pieces))
        return np.concatenate(([0], np.cumsum(chars))), np.concatenate(([0], np.cumsum(tokens))), pieces

    def counted(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of a text, the largest number of code points whose prefix has at most ``limit``)."""
        if any(s in text for s in self.engine.special):
            coarse = self.boundaries(text)
            return int(coarse[1][-1]), self.cut(text, limit, coarse)
        pieces = self.pattern.findall(text)
        sizes = list(map(self.totals.__getitem__, pieces))
        n = sum(sizes)
        if n <= limit:
            return n, len(text)
        # as far as a cut at the limit looks
        some = next(i for i, at in enumerate(accumulate(sizes)) if at > limit) + 3
        chars = np.cumsum([0, *map(len, pieces[:some])])
        return n, self.cut(text, limit, (chars, np.cumsum([0, *sizes[:some]]), [(p, False) for p in pieces[:some]]))

    def _within(self, out: np.ndarray, text: str, k: int, coarse) -> None:
        """Fills out[i], the tokens of text[:i], for the prefixes that end inside pretoken k or at its end."""
        chars, tokens, pieces = coarse
        piece, special = pieces[k]
        a, b = int(chars[k]), int(chars[k + 1])
        if special:
            # as ordinary text, an unfinished special string can continue the pretoken before it
            back = k - 1 if k and not pieces[k - 1][1] else k
            base = text[int(chars[back]) : a]
            plain = base + piece[:-1]
            sub = self.ordinary(plain)
            out[a + 1 : b] = tokens[back] + sub[len(base) + 1 :]
            out[b] = tokens[k + 1]
            return
        out[a + 1 : b + 1] = tokens[k] + self.entry(piece)[1][1:]
        if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
            out[a + 2] = tokens[k] + self.entry("'")[0] + self.entry(piece[1])[0]
        if piece[0].isspace():
            # white space that ends a prefix is one pretoken, from where its run begins
            run = k
            while run and not pieces[run - 1][1] and pieces[run - 1][0].isspace():
                run -= 1
            start = int(chars[run])
            end = a + (len(piece) if piece.isspace() else 1)
            out[a + 1 : end + 1] = tokens[run] + self.entry(text[start:end])[1][a + 1 - start :]

    def ordinary(self, text: str) -> np.ndarray:
        """The table of a text without special strings."""
        pieces = [(p, False) for p in self.pattern.findall(text)]
        sizes = [self.entry(p)[0] for p, _ in pieces]
        coarse = np.cumsum([0, *(len(p) for p, _ in pieces)]), np.cumsum([0, *sizes]), pieces
        out = np.zeros(len(text) + 1, np.int64)
        for k in range(len(pieces)):
            self._within(out, text, k, coarse)
        return out

    def table(self, text: str) -> np.ndarray:
        """count[i]: tokens of text[:i], for every code point i."""
        coarse = self.boundaries(text)
        out = np.zeros(len(text) + 1, np.int64)
        for k in range(len(coarse[2])):
            self._within(out, text, k, coarse)
        return out

    def cut(self, text: str, limit: int, coarse=None) -> int:
        """The largest number of code points whose prefix has at most ``limit`` tokens."""
        coarse = coarse or self.boundaries(text)
        chars, tokens, pieces = coarse
        if tokens[-1] <= limit:
            return len(text)
        k = int(np.searchsorted(tokens, limit, side="right")) - 1
        out = np.full(int(chars[min(k + 2, len(pieces))]) + 1, limit + 1, np.int64)
        out[int(chars[k])] = tokens[k]
        # later pretokens start beyond the limit; one more covers white space that is one pretoken at an end
        for m in range(k, min(k + 2, len(pieces))):
            self._within(out, text, m, coarse)
        return int(np.flatnonzero(out <= limit)[-1])


def within(table: np.ndarray, limit: int) -> int:
    """The largest number of code points within a budget, read off a table."""
    return int(np.flatnonzero(table <= limit)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars: the longest prefix, in code points, of at most ``limit`` tokens.

    Defined cases: a null text counts as empty: no bytes, no tokens, fits.  Strings of special tokens inside a text are
    one token, as the library's default has it.  Repeated rows are each answered, null ids kept; an empty table gives an
    empty table; very long texts are counted whole; other columns are not read.
    """

    def run(batch: pa.RecordBatch):
        own = counter(path)
        n_bytes, n_tokens, fit = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            n_bytes.append(len(text.encode()))
            n, chars = own.counted(text, limit)
            n_tokens.append(n)
            fit.append(chars)
        n = pa.array(n_tokens, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n, pa.compute.greater(n, limit), pa.array(fit, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and counts: the exact token count of every prefix of every text, by code points from 0 to all.

    Stored once, it answers any budget: ``F.size(F.filter("counts", lambda n: n <= limit)) - 1`` code points at least.
    Null texts count as empty and have the table [0]; null ids are kept, repeated rows answered each.
    """

    def run(batch: pa.RecordBatch):
        own, first, held, size = counter(path), 0, [], 0
        for i, text in enumerate(batch.column(1), 1):
            held.append(own.table(text.as_py() or ""))
            size += len(held[-1])
            if size > 1 << 20 or i == batch.num_rows:
                ends = np.cumsum([0, *(len(t) for t in held)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held), pa.int32()))], ["id", "counts"])
                first, held, size = i, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "id long, counts array<int>").withColumnRenamed("id", id_col)


__all__ = ["Engine", "PrefixCounter", "counter", "load", "prefix_tables", "token_counts", "within"]
