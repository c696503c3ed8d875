"""Connected components of an edge table, without gathering edges anywhere.

Alternating large-star / small-star rounds (Kiveris et al., 2014): after
O(log^2 n) rounds every node points at the smallest node of its component.
Each round is two aggregations and two joins; a hub's rows are only ever
pre-aggregated (min) or split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import cut, parts_for


def connected_components(edges: DataFrame, max_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """(a, b) long edges -> (node, component) with component = smallest reachable node.

    Null ends and loops are ignored; repeated edges count once; an empty table
    gives an empty table.  Nodes without an edge do not appear.  parts: files of
    the first edge table at most; later ones follow the number of edges.
    """
    stars = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    stars = cut(stars, parts)
    seen = None
    for _ in range(max_rounds):
        state = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        parts = parts_for(edges.sparkSession, state[0])
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct()
        # now every edge points from the larger end a to a smaller b
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        joined = large.join(small, F.col("a") == F.col("k"))
        stars = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select(F.col("k").alias("a"), F.col("m").alias("b")))
        stars = cut(stars.coalesce(parts).distinct(), parts)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends)
