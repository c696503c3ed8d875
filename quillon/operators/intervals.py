"""Points in intervals, as an equi-join on bins.

An interval is copied to every bin that it touches, a point belongs to one bin, and the ends are compared
exactly afterwards.  Nothing is compared with everything, and neither side has to be small.

What is only wanted by groups of pairs is found without listing them: the ends of all intervals cut the line into
pieces, an interval is a few cells of a binary tree over the pieces, and of the cells above a point exactly one is
among those of an interval that holds it.  Both sides are added up by cell before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.ordered import running_sum
from quillon.sources.scratch import small, stash


def bin_width(intervals: DataFrame, begin: Column, end: Column, copies: float = 2.0) -> float:
    """A width at which an interval touches about ``copies`` bins on average, from the mean length."""
    mean = intervals.agg(F.avg((end - begin).cast("double"))).first()[0]
    return max(float(mean or 0.0) / max(copies - 1, 1e-9), 1e-300) if mean else 1.0


def _distinct_names(points: DataFrame, intervals: DataFrame) -> None:
    clash = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")


def within(points: DataFrame, at: Column, intervals: DataFrame, begin: Column, end: Column, width: float | None = None, closed: bool = True) -> DataFrame:
    """Each point with each interval that holds it: columns of both, whose names must differ.

    at, begin and end are numbers.  closed: both ends belong to an interval, else only the first.  An interval without
    both ends, or with the end before the begin, holds nothing, and a point without a number is in none.
    """
    _distinct_names(points, intervals)
    width = bin_width(intervals, begin, end) if width is None else width
    cell = lambda x: F.floor(x / F.lit(width)).cast("long")
    left = points.withColumns({"_at": at, "_bin": cell(at)}).where("_bin is not null")
    right = intervals.withColumns({"_a": begin, "_b": end}).where("_a <= _b")
    right = right.withColumn("_cell", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_b")))))
    last = F.col("_at") <= F.col("_b") if closed else F.col("_at") < F.col("_b")
    out = left.join(right, (F.col("_bin") == F.col("_cell")) & (F.col("_at") >= F.col("_a")) & last)
    return out.drop("_at", "_bin", "_a", "_b", "_cell")


def grouped_within(
    points: DataFrame, at: Column, by_point: list[str], intervals: DataFrame, begin: Column, end: Column, by_interval: list[str],
    count: str = "n", means: dict[str, str] | None = None, least: dict[str, str] | None = None, closed: bool = True,
) -> DataFrame:
    """The pairs of ``within`` by columns of both sides: their number, means of columns of the points, minima of columns of the intervals.

    means and least: out -> column; NULLs do not count.  The work is that of points and intervals (times the logarithm of the
    number of ends) and of the groups, however many pairs there are.
    """
    _distinct_names(points, intervals)
    means, least = means or {}, least or {}
    held = intervals.withColumns({"_a": begin, "_b": end}).where("_a <= _b" if closed else "_a < _b")
    sums = [F.count("*").alias("_n"), *[f(v).alias(f"_{name}_{m}") for m, v in means.items() for name, f in (("sum", F.sum), ("count", F.count))]]
    # a row for each place and group, so that no place is many rows
    spots = points.withColumn("_x", at).where("_x is not null").groupBy("_x", *by_point).agg(*sums)
    marks = held.select(F.explode(F.array("_a", "_b")).alias("_x")).distinct().select("_x", F.explode(F.array(F.lit(0), F.lit(2))).alias("_kind"), F.lit(1).alias("_mark"))
    laid = spots.withColumns({"_kind": F.lit(1), "_mark": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    # every end has a mark before it and one after it: 2 i marks precede end i, which is piece 2 i; piece 2 i + 1 lies between it and the next
    placed = running_sum(laid, "_mark", [F.asc("_x"), F.asc("_kind"), *[F.asc(c) for c in by_point]], "_before")
    added = [F.sum(x).alias(x) for x in ("_n", *[f"_{f}_{m}" for m in means for f in ("sum", "count")])]
    placed = stash(placed.where("_kind < 2").groupBy("_before", "_kind", *by_point).agg(F.min("_x").alias("_x"), *added), "pieces")
    ends = placed.where("_kind = 0").select("_x", F.col("_before").cast("long").alias("_piece"))
    n = ends.count()
    depth = max(1, (2 * n).bit_length())
    held = held.join(small(ends.toDF("_a", "_first"), n), "_a").join(small(ends.toDF("_b", "_last"), n), "_b")
    # cells are numbered as in a heap, the pieces from 2^depth on; of a level, an interval has its first cell if that is a right child and its last if that is a left one
    held = held.select(*by_interval, *set(least.values()) - set(by_interval), (F.col("_first") + (1 << depth)).alias("_lo"), (F.col("_last") + (1 << depth) + int(closed)).alias("_hi"))
    held = held.withColumn("_k", F.explode(F.sequence(F.lit(0), F.log2(F.col("_hi") - F.col("_lo")).cast("int") + 1)))
    held = held.withColumns({"_lo": F.expr("shiftright(_lo + shiftleft(1L, _k) - 1, _k)"), "_hi": F.expr("shiftright(_hi, _k)")}).where("_lo < _hi")
    held = held.withColumn("_cell", F.explode(F.array(F.expr("if(_lo % 2 = 1, _lo, null)"), F.expr("if(_hi % 2 = 1, _hi - 1, null)")))).where("_cell is not null")
    right = held.groupBy("_cell", *by_interval).agg(F.count("*").alias("_m"), *[F.min(v).alias(f"_min_{m}") for m, v in least.items()])
    left = placed.where("_kind = 1 and _before > 0").withColumn("_leaf", F.col("_before") - 1 + (1 << depth))
    left = left.withColumn("_cell", F.expr(f"explode(transform(sequence(0, {depth}), k -> shiftright(_leaf, k)))")).groupBy("_cell", *by_point).agg(*added)
    pairs = left.join(right, "_cell")
    return pairs.groupBy(*by_point, *by_interval).agg(
        F.sum(F.col("_n") * F.col("_m")).alias(count),
        *[(F.sum(F.col(f"_sum_{m}") * F.col("_m")) / F.nullif(F.sum(F.col(f"_count_{m}") * F.col("_m")), F.lit(0))).alias(m) for m in means],
        *[F.min(f"_min_{m}").alias(m) for m in least],
    )
