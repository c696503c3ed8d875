"""Factors bar by bar: a stream of bars with the rows that its windows look back on.

Each symbol's state is a ring of its last rows and the number of bars seen.  A
micro-batch gives its new rows together with the ring before them, which is what ``lower.factors`` needs to
compute the same windows as over the whole history; only the new rows are handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.plans.expr import lookback, parse
from quillon.plans.lower import factors
from quillon.sources.bars import FIELDS

_OUT = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, n long, own boolean"
_STATE = "ts array<timestamp_ntz>, " + ", ".join(f"{f} array<double>" for f in FIELDS) + ", n long"


def with_history(bars: DataFrame, back: int) -> DataFrame:
    """A stream of bars (symbol, ts, ohlcv) with n, a bar's number within its symbol from 1, and own: false for the up to ``back`` rows
    that a micro-batch repeats in front of a symbol's new ones.

    A symbol's bars must come in the order of time.  A bar that is not later than the last of its symbol comes too late and is left
    out, as is a second one of the same time; the first to come holds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["ts", *FIELDS]
        old, seen = pd.DataFrame({c: [] for c in names}), 0
        if state.exists:
            *rings, seen = state.get
            old = pd.DataFrame(dict(zip(names, rings, strict=True)))
        new = pd.concat([f[names] for f in frames]).sort_values("ts", kind="stable").drop_duplicates("ts")
        if len(old):
            new = new[new["ts"] > old["ts"].iloc[-1]]
        if not len(new):
            return
        rows = pd.concat([old, new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        rows["n"] = range(seen - len(old) + 1, seen + len(new) + 1)
        rows["own"] = rows.index >= len(old)
        # a ring of at least one row, whose time says what comes too late
        ring = rows.tail(max(1, back))
        state.update((ring["ts"].dt.to_pydatetime().tolist(), *[[None if pd.isna(v) else float(v) for v in ring[f]] for f in FIELDS], seen + len(new)))
        rows.insert(0, "symbol", key[0])
        yield rows

    rows = bars.select("symbol", "ts", *FIELDS)
    return rows.groupBy("symbol").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def replay(bars: DataFrame, exprs: dict[str, str], sink: Callable[[DataFrame, int], None], warmup: int = 1, **options) -> DataStreamWriter:
    """A stream's writer that hands every micro-batch's (symbol, ts, ohlcv, n, factors) to sink(rows, batch number).

    The rows are those of ``factors`` over the whole history from the warmup-th bar of a symbol on.  A micro-batch that is run again after a
    failure has the same rows and number, so a sink that keeps the number writes each once.
    """
    back = max((lookback(parse(e)) for e in exprs.values()), default=0)

    def each(rows: DataFrame, number: int) -> None:
        wide = factors(rows, exprs, **options)
        sink(wide.where("own").where(F.col("n") >= warmup).drop("own"), number)

    return with_history(bars, back).writeStream.foreachBatch(each)
