"""Connected components of a graph given as rows, by alternating stars.

Large-star and small-star steps hang every node under the least node it has seen; both are a
grouped minimum, which combines before the shuffle, and an equi-join on the node, whose hot keys
Spark splits. Each round is stored in the shared folder, so plans stay short and a lost executor
costs one round. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    row = edges.agg(
        F.count("*"), F.sum(F.shiftright(mixed, 20)), F.sum(mixed.bitwiseAND(F.lit((1 << 20) - 1)))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns), the component's least node.

    Repeated edges change nothing; loops and edges with a null end are left out, and a node that has
    no other edge with them. No edges, no rows.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    ends = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    now = stored(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(under, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.union(under.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = stored(small, "stars")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
