"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of edges(a, b) and the least vertex of its component. Edges from a vertex to itself are ignored.

    By contraction: each round, every vertex goes over into the least of itself and its neighbours, edges follow, and equal ones become one. So the
    edges shrink from round to round (vertices should be numbered at random, as hashes are), and the rows of all rounds together stay in
    proportion to the edges. The rounds' steps are then composed from the last to the first."""
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = common.cut(edges.filter("a <> b").select(*pair("a", "b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("o")))
        step = common.cut(ends.groupBy("v").agg(F.min("o").alias("o")).select("v", F.least("v", "o").alias("c")))
        of = lambda x: step.select(F.col("v").alias(x), F.col("c").alias(f"{x}_to"))  # noqa: B023, E731
        moved = edges.join(of("a"), "a").join(of("b"), "b").filter("a_to <> b_to")
        was, edges = edges, common.cut(moved.select(*pair("a_to", "b_to")).distinct())
        common.discard(was)
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    out = steps.pop()
    while steps:
        step, later = steps.pop(), out
        out = common.cut(step.join(later.select(F.col("v").alias("c"), F.col("c").alias("_to")), "c", "left").select("v", F.coalesce("_to", "c").alias("c")))
        common.discard(step, later)
    return out
