"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no adjacency list, component or link set is ever held by one task or
by the driver; only a count and a checksum come back, to see when nothing changes any more. Each round is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written


def _step(links: DataFrame, larger_only: bool) -> DataFrame:
    """links (u > v). Large star: neighbours above u go to u's least neighbour; small star: those below."""
    if larger_only:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Written first, so that both sides of the join are plain exchanges and a node with very many links can be split.
    least = written(least, "components-least").withColumnRenamed("u", "n")
    joined = both.join(least, F.col("u") == F.col("n"))
    moved = joined.where("v > u") if larger_only else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        out = out.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) of longs, in either order, repeats and self-links allowed -> (node, component): the smallest
    node reachable, for every node that has a link to another one."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        now = written(_step(_step(now, True), False), "components")
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = (n, check)
    raise RuntimeError(f"no components after {max_rounds} rounds")
