"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

A hub with a large share of all edges is looked up in a broadcast table (``join_spread``),
so its edges don't meet in one task.  Edges with a null end are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around: larger neighbours (large star) or the node and its smaller ones (small star)."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "star")
        return join_spread(both.where("v > u"), least, ["u"], "n", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
    moved = join_spread(down, least, ["u"], "n", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Rounds are written to the shared folder; only counts come to the driver.  Self-links and repeated edges are allowed.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    state = None
    while not now.isEmpty():
        now = materialize(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
