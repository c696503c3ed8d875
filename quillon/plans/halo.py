"""Factors over histories that are too long for one task: blocks of time with a halo.

A symbol's rows are cut into blocks of consecutive rows.  A block also gets the
``lookback`` rows before it, which are computed on but not returned, so that
its windows are those of the whole history.  Rows are counted by cells of time
first (added up before they are shuffled), the running sums over the cells give the blocks,
and a cell is sent to its own block and to those whose halo it touches: no task sorts
a symbol, and none holds more than a block with its halo.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.plans.expr import lookback, parse
from quillon.plans.lower import factors
from quillon.sources.scratch import small, stash

#: Rows of a block; some 100 MB with a few dozen columns.
BLOCK = 500_000
#: A cell has at most this share of a block, unless more rows than that have one and the same time.
_SHARE = 8


@dataclass
class Blocks:
    """rows: the table with ``_block``, ``_own`` (false for halo rows) and ``_at``, the number of the block's first row."""

    rows: DataFrame
    cells: DataFrame


def _cells(rows: DataFrame, keys: tuple[str, ...], order: str, block: int) -> tuple[DataFrame, Column]:
    """(keys, cell, n) with at most a share of a block in each cell, and the cell of a row."""
    us = F.unix_micros(F.col(order).cast("timestamp"))
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(us) - F.min(us) + 1).alias("span"))
    width = per.agg(F.min(F.greatest(F.lit(1), F.floor(F.col("span") / F.col("n") * (block / _SHARE))))).first()[0] or 1
    while True:
        cell = F.floor(us / F.lit(int(width))).cast("long")
        cells = stash(rows.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n")), "cells")
        most = cells.agg(F.max("_n")).first()[0] or 0
        if most <= max(1, block // _SHARE) or width == 1:
            return cells, cell
        # bursts: as much narrower as the densest cell asks for
        width = max(1, width * block // (_SHARE * 2 * most))


def blocks(rows: DataFrame, before: int, block: int = BLOCK, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Blocks:
    """rows in blocks of at most ``block`` rows, each with the ``before`` rows ahead of it, or a few more, as its halo.

    Rows of one time are not cut apart: a block is larger where more than ``block`` rows of a key have the same time.  rows is
    read several times, so it should be a stored table.
    """
    cells, cell = _cells(rows, keys, order, block)
    most = cells.agg(F.max("_n")).first()[0] or 0
    step = max(1, block - most)
    ahead = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # a row a cell: a key's history is some hundreds of blocks times a few cells
    cells = stash(cells.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("_block", F.floor(F.col("_start") / step).cast("long")), "blocks")
    own = cells.select(*keys, "_cell", "_start", "_block", F.lit(True).alias("_own"))
    if before > 0:
        starts = cells.groupBy(*keys, "_block").agg(F.min("_start").alias("_first"))
        last = F.floor((F.col("_start") + F.col("_n") + before) / step).cast("long")
        later = cells.where(last > F.col("_block")).select(*keys, "_cell", "_start", "_n", F.explode(F.sequence(F.col("_block") + 1, last)).alias("_block")).join(starts, [*keys, "_block"])
        own = own.union(later.where(F.col("_first") - before < F.col("_start") + F.col("_n")).select(*keys, "_cell", "_start", "_block", F.lit(False)))
    places = stash(own.withColumn("_at", F.min("_start").over(Window.partitionBy(*keys, "_block"))).drop("_start"), "places")
    return Blocks(rows.withColumn("_cell", cell).join(small(places), [*keys, "_cell"]).drop("_cell"), cells)


def factors_in_blocks(bars: DataFrame, exprs: dict[str, str], block: int = BLOCK, position: str | None = None, **options) -> DataFrame:
    """What ``lower.factors`` gives, for symbols of any length.

    position: name of a column for the row's number within its symbol, from 1, which no task needs the whole symbol for.
    Options are those of ``factors``.
    """
    before = max((lookback(parse(e)) for e in exprs.values()), default=0)
    cut = blocks(stash(bars, "bars"), before, block)
    rows = factors(cut.rows, exprs, keys=("symbol", "_block"), **options)
    if position:
        number = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy("ts"))
        rows = rows.withColumn(position, (F.col("_at") + number).cast("long"))
    return rows.where("_own").select(*bars.columns, *exprs, *[position] * bool(position))
