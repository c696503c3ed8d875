"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing.  Every record ends in CRLF CRLF, so an archive is a text file with that
line separator; Spark's text writer and its commit protocol put it on any file
system, safe against lost executors.  Records with equal payloads become
revisits of the one with the smallest id.

Reading.  Spark's text reader, splitting at the magic ``WARC/1.1`` line, gives every
task its candidates; the magic may also stand inside a payload.  A task emits for
every candidate its place and that of its successor, which its header's length
implies.  Places within a split are relative; a running sum over the splits of a file
makes them absolute.  The records are the candidates on the chain from the
file's start: pointer jumping runs first within each split on arrays, then
over the remaining pointers between splits, in log2(splits of a file) rounds of
joins.  All tables that are shuffled hold places and header fields, never payloads.  A payload
that holds the magic is put together from its pieces, in the task where it
lies within a split, else by a second scan for these records alone.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._spark import arrow_map, cut

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Revisit tables up to so many rows are broadcast (36 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Candidates of unfinished length that a task follows at a time; the others are left to the second scan.
FOLLOWED = 64
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, sha1, refers_to) of every page that repeats the payload of one with a smaller id."""

    def run(batch: pa.RecordBatch):
        raw = [(x.as_py() or "").encode() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], ["id", "sha1", "n"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("string").alias("payload")).where("id is not null")
    known = cut(arrow_map(rows, run, "id long, sha1 binary, n long").where(F.col("n") >= min_bytes))
    first = known.groupBy("sha1").agg(F.min("id").alias("refers_to"), F.count("*").alias("times")).where("times > 1").select("sha1", "refers_to")
    return known.join(first, "sha1").where("id > refers_to").select("id", "sha1", "refers_to").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record without its magic line's successor: headers, blank line, block."""
    clean = "".join(c for c in url or "" if c >= " " and c != "\x7f")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return MAGIC.encode() + "\r\n".join(head).encode() + END.encode() + block


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives below path, a record for every row.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the smallest id is a response, the others
    revisit it.  A null payload counts as empty, a null url too; rows with a null id are responses without an id;
    rows that repeat an id are written each.
    """
    revisits = cut(plan_revisits(pages, id_col, payload_col, min_bytes).select(F.col("id").alias("r"), F.col("sha1").alias("s"), "refers_to"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    few = revisits.count() <= BROADCAST_ROWS
    # an id may repeat with another payload, which is not a revisit
    same = (F.col("id") == F.col("r")) & (F.unhex(F.sha1(F.coalesce("payload", F.lit("")).cast("binary"))) == F.col("s"))
    rows = rows.join(F.broadcast(revisits) if few else revisits, same, "left").select("id", "url", "payload", "refers_to")

    def run(batch: pa.RecordBatch):
        out, size = [], 0
        for i, u, p, r in zip(*batch.columns, strict=True):
            out.append(record(i.as_py(), u.as_py(), (p.as_py() or "").encode(), r.as_py(), date))
            size += len(out[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    arrow_map(rows, run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).text(path)


def _parse(row: bytes) -> tuple[dict[str, str], int, int] | None:
    """(headers, bytes before the block, block length) of what follows a magic line, if it is a record's header."""
    end = row.find(END.encode())
    if end < 0:
        return None
    fields = {}
    for line in row[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in fields:
        return None
    return fields, end + len(END), int(length)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic line, by file and split, in order."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


_NODE = "file string, block long, rel long, next long, used long, type string, record_id string, refers_to string, uri string, named string, full long, n long, digest string"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def _urn(text: str | None) -> str | None:
    return text[1:-1] if text and text.startswith("<") and text.endswith(">") else text


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each candidate, places relative to what the split's reader consumes; and one (rel null) with what it used.

    n and digest are of the block as read, null if it goes on in another split.
    """

    def run(batches):
        file = block = None
        at, done, waiting = 0, [], []
        skip = len(MAGIC)

        def new_rows():
            nonlocal done
            rows, done = done, []
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

        def close(row, sha=None, size=None):
            done.append((*row, size, base64.b32encode(sha.digest()).decode() if sha else None))

        def finish():
            nonlocal waiting
            for row, _, _, _ in waiting:
                close(row)
            waiting = []
            if file is not None:
                done.append((file, block, None, None, at, None, None, None, None, None, None, None, None))

        for batch in batches:
            for f, b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (f, b) != (file, block):
                    finish()
                    file, block, at = f, b, 0
                    # only the first split of a file starts with what precedes the first magic
                    started = b > 0
                    value = v.as_py()
                    if not started:
                        at = len(value) + skip
                        continue
                else:
                    value = v.as_py()
                rel = at - skip if at or block == 0 else -skip
                still = []
                for row, end, sha, want in waiting:
                    piece = MAGIC.encode() + value
                    take = min(len(piece), end - (at - skip))
                    sha.update(piece[:take])
                    if end <= at + len(value):
                        close(row, sha, want)
                    else:
                        still.append((row, end, sha, want))
                waiting = still
                parsed = _parse(value)
                if parsed:
                    fields, before, length = parsed
                    start = at + before
                    row = (file, block, rel, start + length + len(END), None, fields["warc-type"], _urn(fields.get("warc-record-id")), _urn(fields.get("warc-refers-to")), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(x) if (x := fields.get("x-payload-length", "")).isdigit() else None)
                    sha = hashlib.sha1(value[before : before + length])
                    if start + length <= at + len(value):
                        close(row, sha, length)
                    elif len(waiting) < FOLLOWED:
                        waiting.append((row, start + length, sha, length))
                    else:
                        close(row)
                at += len(value) + skip
            if len(done) > 20_000:
                yield new_rows()
        finish()
        yield new_rows()

    return _raw(spark, path).mapInArrow(run, _NODE)


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one split on the chain from its entry; pdf has pos, next and the entry."""
    pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
    pos, nxt, entry = pdf["pos"].to_numpy(), pdf["next"].to_numpy(), pdf["entry"].iloc[0]
    keep = np.zeros(len(pos), bool)
    i = int(np.searchsorted(pos, entry)) if entry == entry and entry is not None else len(pos)
    while i < len(pos):
        keep[i] = True
        j = int(np.searchsorted(pos, nxt[i]))
        if j >= len(pos) or pos[j] != nxt[i]:
            break
        i = j
    return pdf[keep]


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves the split: pointer jumping on arrays."""
    pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
    pos, nxt = pdf["pos"].to_numpy(), pdf["next"].to_numpy()
    j = np.searchsorted(pos, nxt)
    inside = (j < len(pos)) & (pos[np.minimum(j, len(pos) - 1)] == nxt)
    to = np.where(inside, j, np.arange(len(pos)))
    while (to[to] != to).any():
        to = to[to]
    pdf["exit"] = nxt[to]
    return pdf[["file", "block", "pos", "exit"]]


def chain(nodes: DataFrame) -> DataFrame:
    """Of (file, block, pos, next, ...) candidates those reachable from place 0 of their file."""
    kept = nodes.columns
    splits = nodes.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    if splits > 1:
        exits = cut(nodes.select("file", "block", "pos", "next").groupBy("file", "block").applyInPandas(_exits, "file string, block long, pos long, exit long"))
        jump = exits.select("file", F.col("pos").alias("p"), F.col("exit").alias("q"))
        reach = jump.where("p = 0").select("file", "p")
        for _ in range(max(1, (splits - 1).bit_length() + 1)):
            hop = reach.join(jump, ["file", "p"]).select("file", F.col("q").alias("p"))
            reach = cut(reach.union(hop).distinct())
            far = jump.select("file", F.col("p").alias("q"), F.col("q").alias("r"))
            jump = cut(jump.join(far, ["file", "q"]).select("file", "p", F.col("r").alias("q")))
        entries = exits.join(reach, (exits.file == reach.file) & (exits.pos == reach.p)).groupBy(exits.file.alias("f"), exits.block.alias("b")).agg(F.min("pos").alias("entry"))
    else:
        entries = nodes.where("pos = 0").groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.min("pos").alias("entry"))
    joined = nodes.join(entries, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select(*kept, "entry")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    return joined.groupBy("file", "block").applyInPandas(_mark, schema).select(*kept)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, type, record_id, refers_to, uri, digest, full (length of the full payload), n (bytes of the block), ok.

    One row for each record on the chain from its file's start.  digest and n are computed from the block; for a
    revisit, whose block is empty, digest and full are those its header names.  ok: the block's digest is the one its
    header names.  A file that does not start with a record has none; bytes behind a broken link are not
    records; an empty archive has no rows.
    """
    seen = cut(candidates(spark, path))
    used = seen.where("rel is null").select("file", "block", "used")
    before = F.coalesce(F.sum("used").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = used.select(F.col("file").alias("bf"), F.col("block").alias("bb"), before.alias("base"))
    placed = seen.where("rel is not null").join(base, (F.col("file") == F.col("bf")) & (F.col("block") == F.col("bb")))
    nodes = placed.select("file", "block", (F.col("rel") + F.col("base")).alias("pos"), (F.col("next") + F.col("base")).alias("next"), "type", "record_id", "refers_to", "uri", "named", "full", "n", "digest")
    records = cut(chain(cut(nodes)))
    records = _complete(spark, path, records, base)
    revisit = F.col("type") == "revisit"
    return records.select(
        "file", "pos", "type", "record_id", "refers_to", "uri", F.when(revisit, F.col("named")).otherwise(F.col("digest")).alias("digest"),
        F.when(revisit, F.col("full")).otherwise(F.col("n")).alias("full"), "n", (revisit | (F.col("digest") == F.col("named"))).alias("ok"),
    )


def _complete(spark: SparkSession, path: str, records: DataFrame, base: DataFrame) -> DataFrame:
    """Length and digest of records whose payload goes on in other splits, by one scan for these."""
    open_ = records.where("digest is null")
    if open_.isEmpty():
        return records
    wanted = cut(open_.select("file", "block", "pos", "next"))
    skip = len(MAGIC)

    def run(batches):
        file = block = None
        at = 0
        for batch in batches:
            f_, b_, r_, p_ = [], [], [], []
            for f, b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = v.as_py()
                if (f, b) != (file, block):
                    file, block, at = f, b, 0
                f_.append(f)
                b_.append(b)
                r_.append(at - skip)
                p_.append(v)
                at += len(v) + skip
            yield pa.RecordBatch.from_arrays([pa.array(f_), pa.array(b_, pa.int64()), pa.array(r_, pa.int64()), pa.array(p_, pa.binary())], ["file", "block", "rel", "value"])

    rows = _raw(spark, path).mapInArrow(run, "file string, block long, rel long, value binary")
    rows = rows.join(base, (F.col("file") == F.col("bf")) & (F.col("block") == F.col("bb"))).select("file", (F.col("rel") + F.col("base")).alias("at"), "value")
    w = wanted.select(F.col("file").alias("wf"), "pos", "next")
    few = wanted.count() <= BROADCAST_ROWS
    pieces = rows.join(F.broadcast(w) if few else w, (F.col("file") == F.col("wf")) & (F.col("at") >= F.col("pos")) & (F.col("at") < F.col("next"))).select("wf", "pos", "at", "value")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        row = MAGIC.encode().join(pdf["value"])
        _, before, length = _parse(row)
        block = row[before : before + length]
        return pd.DataFrame({"wf": [pdf["wf"].iloc[0]], "wp": [pdf["pos"].iloc[0]], "wn": [len(block)], "wd": [digest(block) if len(block) == length else None]})

    got = pieces.groupBy("wf", "pos").applyInPandas(whole, "wf string, wp long, wn long, wd string")
    joined = records.join(got, (F.col("file") == F.col("wf")) & (F.col("pos") == F.col("wp")), "left")
    return joined.select(*[c for c in records.columns if c not in ("n", "digest")], F.coalesce("n", "wn").alias("n"), F.coalesce("digest", "wd").alias("digest"))
