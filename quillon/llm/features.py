"""Hashed word n-gram features shared by the classifiers."""

from __future__ import annotations

import numpy as np

from quillon.llm import _kernels as K


def ngrams(data: np.ndarray, offs: np.ndarray, orders: tuple[int, ...] = (1, 2), bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(feature in 0 .. 2^bits - 1, document) of every word n-gram of every document of a chunk."""
    h, _, _, first = K.words(data, offs, K.ALNUM_WORDS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, docs = [], []
    for n in orders:
        m = max(0, len(h) - n + 1)
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g += h[j : j + m] * K._SEQ[20 + j]
        g = K.mix(g + np.uint64(n))
        same = doc[:m] == doc[n - 1 : n - 1 + m]
        out.append((g[same] >> np.uint64(64 - bits)).astype(np.int64))
        docs.append(doc[:m][same])
    return np.concatenate(out), np.concatenate(docs)


def distinct(feature: np.ndarray, doc: np.ndarray, bits: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once per document."""
    both = np.unique((doc << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits
