"""Connected components of an edge table, by alternating star contractions.

Each round is two aggregations and joins over the edges; nothing of the graph
reaches the driver but a count.  Rounds grow with the logarithm of the longest
path.  Every round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrid.llm.tables import release, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node links its larger (or smaller) neighbours to
    the smallest one it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.where("b > a") if large else near
    out = linked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of an edge (``a``, ``b``) that is not
    itself the smallest node of its component."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "components")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = mark
        before, now = now, written(_star(_star(now, True), False), "components")
        release(before)
