"""Vectorised numpy kernels over the raw UTF-8 buffers of Arrow string columns.

All kernels work on *chunks*: a contiguous uint8 array holding several
documents back to back, plus their boundaries.  Documents are never cut; a
chunk holds whole documents up to a byte target, or one longer document.
Hash values are 64-bit: a tabulated polynomial hash whose prefix sums give the
hash of any substring in O(1), followed by a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEQ = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII digits, ASCII letters and everything above ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _power(which: str, n: int) -> np.ndarray:
    """B^i (``up``) or B^-i (``down``) for i < n, mod 2^64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1) if n <= CHUNK_BYTES + 1 else n
        out = np.full(size, _BASE if which == "up" else _BASE_INV, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= CHUNK_BYTES + 1:
            _powers[which] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = B^s * hash(data[s:e])."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _power("down", len(prefix))
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _SEQ[63])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary Arrow array; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else np.asarray(column.is_valid())
    return raw[offs[0] : offs[-1]], offs - offs[0], valid


def chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within the bytes) of whole rows, about target bytes each."""
    data, offs, _ = string_buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document: (hashes, starts, ends, index of the first word of each document + total)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offs), np.int64)
    low = LOWER[data] if lower else data
    inside = table[low]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return span_hash(prefix_hash(low), starts, ends), starts, ends, np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each document, and the index of each document's first.

    A document with fewer words, but some, has one shingle: its whole sequence.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(count)))
    total = int(begin[-1])
    if total == 0:
        return np.zeros(0, np.uint64), begin
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - begin[doc] + first[doc]
    out = np.zeros(total, dtype=np.uint64)
    span = np.minimum(n[doc], width)
    for j in range(width):
        ok = j < span
        out[ok] += hashes[at[ok] + j] * _SEQ[j]
    return mix(out + span.astype(np.uint64) * _SEQ[62]), begin


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (length + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
