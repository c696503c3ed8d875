"""Products of profiles by blocks of times: what every pair of items has in common, without a row for each pair and time.

The cells of both sides are dealt out by time, so that all cells of a time meet in one task.  A task
takes some thousand times at once as dense matrices, items by times, multiplies them and adds the results up; it
hands on a row for each pair of items, however many times it has seen.  What is shuffled is the cells once, and pairs times tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a dense matrix that a task holds at a time.
CELLS = 1 << 21
_PAIR = "expr_hash string, item string"


def _summed(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], sums: list[str]) -> DataFrame:
    """Sums by pair of what fn finds in the cells of some times; left and right are (item, ts, cells...) with equal columns."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "ts").sortWithinPartitions("ts")

    def add(rows: pd.DataFrame, done: list[pd.DataFrame]) -> None:
        one, two = (rows[rows["_side"] == s] for s in (0, 1))
        if len(one) and len(two):
            done.extend(fn(one, two))
        if len(done) > 16:
            done[:] = [total(done)]

    def total(done: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(done).groupby(["expr_hash", "item"], as_index=False, sort=False)[sums].sum()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = None, []
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            last = rows["ts"].iloc[-1] if len(rows) else None
            whole = (rows["ts"] != last).to_numpy()  # the last time may go on in the next batch
            if whole.any():
                add(rows[whole], done)
            held = rows[~whole]
        if held is not None and len(held):
            add(held, done)
        if done:
            yield total(done)

    schema = ", ".join([_PAIR, *[f"{s} double" for s in sums]])
    return both.mapInPandas(run, schema).groupBy("expr_hash", "item").agg(*[F.sum(s).alias(s) for s in sums])


def _times(one: pd.DataFrame, two: pd.DataFrame, per_time: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Both sides cut to their shared times, so many at once that CELLS holds."""
    shared = np.intersect1d(one["ts"].to_numpy(), two["ts"].to_numpy())
    step = max(1, CELLS // max(1, per_time))
    for i in range(0, len(shared), step):
        lo, hi = shared[i], shared[min(i + step, len(shared)) - 1]
        pick = lambda x: x[(x["ts"] >= lo) & (x["ts"] <= hi) & x["ts"].isin(shared[i : i + step])]  # noqa: B023, E731
        yield pick(one), pick(two)


def _codes(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x.to_numpy(), return_inverse=True)


def product_sums(left: DataFrame, right: DataFrame) -> DataFrame:
    """(expr_hash, item, n, sx, sy, sxx, syy, sxy): moments over all pairs of cells of one time, of (item, ts, v) on both sides.

    An item may have several cells of a time; each meets each of the other side's.
    """

    def fn(one: pd.DataFrame, two: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, _ = _codes(one["item"])
        b, _ = _codes(two["item"])
        for x, y in _times(one, two, max(len(a), len(b))):
            t = np.unique(x["ts"].to_numpy())

            def moments(rows: pd.DataFrame, items: np.ndarray) -> list[np.ndarray]:
                at = (np.searchsorted(items, rows["item"].to_numpy()), np.searchsorted(t, rows["ts"].to_numpy()))  # noqa: B023
                out = np.zeros((3, len(items), len(t)))  # noqa: B023
                v = rows["v"].to_numpy()
                for k, w in enumerate((np.ones(len(v)), v, v * v)):
                    np.add.at(out[k], at, w)
                return list(out)

            (cx, sx, qx), (cy, sy, qy) = moments(x, a), moments(y, b)
            n = cx @ cy.T
            i, j = np.nonzero(n)
            parts = {"n": n, "sx": sx @ cy.T, "sy": cx @ sy.T, "sxx": qx @ cy.T, "syy": cx @ qy.T, "sxy": sx @ sy.T}
            yield pd.DataFrame({"expr_hash": a[i], "item": b[j], **{k: m[i, j] for k, m in parts.items()}})

    return _summed(left, right, fn, ["n", "sx", "sy", "sxx", "syy", "sxy"])


def unit_products(left: DataFrame, right: DataFrame, symbols: dict[str, set[str]], least_symbols: int) -> DataFrame:
    """(expr_hash, item, n, c): times at which both items have a scaled cross-section, and the sum of their absolute products.

    left and right: (item, ts, symbol, v).  symbols: all symbols of each item of a side, under ``0`` or ``1`` and its name.  A
    cross-section is cut to the symbols that both items have at all, centred, and scaled to length 1; it counts if it has
    ``least_symbols`` cells that are not all equal.
    """

    def unit(v: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = has.sum(axis=1)
        mean = np.divide((v * has).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)
        d = (v - mean[:, None]) * has
        ss = (d * d).sum(axis=1)
        ok = (n >= least_symbols) & (ss > 1e-12)
        return d / np.sqrt(np.where(ok, ss, 1.0))[:, None], ok

    def fn(one: pd.DataFrame, two: pd.DataFrame) -> Iterator[pd.DataFrame]:
        a, _ = _codes(one["item"])
        b, _ = _codes(two["item"])
        names = np.union1d(one["symbol"].to_numpy(), two["symbol"].to_numpy())
        known = {(s, i): np.isin(names, list(symbols[f"{s}{i}"])) for s, items in ((0, a), (1, b)) for i in items}
        for x, y in _times(one, two, (len(a) + len(b)) * len(names)):
            t = np.unique(x["ts"].to_numpy())

            def dense(rows: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
                out = {}
                for i, part in rows.groupby("item", sort=False):
                    v, has = np.zeros((2, len(t), len(names)))  # noqa: B023
                    at = (np.searchsorted(t, part["ts"].to_numpy()), np.searchsorted(names, part["symbol"].to_numpy()))  # noqa: B023
                    v[at], has[at] = part["v"].to_numpy(), 1.0
                    out[i] = v, has
                return out

            found, rows = dense(y), []
            for i, (v, has) in dense(x).items():
                for j, (w, own) in found.items():
                    shared = known[0, i] & known[1, j]
                    if shared.sum() < least_symbols:
                        continue
                    (p, ok), (q, ko) = unit(v, has * shared), unit(w, own * shared)
                    # a time counts if both are scaled and have a symbol of it in common
                    met = ok & ko & ((has * own)[:, shared].sum(axis=1) > 0)
                    if met.any():
                        rows.append((i, j, float(met.sum()), float(np.abs((p * q).sum(axis=1))[met].sum())))
            if rows:
                yield pd.DataFrame(rows, columns=["expr_hash", "item", "n", "c"])

    return _summed(left, right, fn, ["n", "c"])
