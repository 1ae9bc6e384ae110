"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").filter("v > u")
            .select(F.col("v").alias("a"), F.least("u", "m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges arrive and leave as (larger, smaller)."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable nodes to ``(node, root)``: root is the
    least node of the node's component; nodes without an edge are left out.

    Runs until the edges stop changing (every edge then joins a node to its
    root).  Each round is written to the shared folder, so a lost executor
    costs part of one round; self links and repeated edges change nothing; no
    edges give no rows; an edge with a null end is no edge."""
    e = (edges.select("a", "b").filter("a <> b")
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e, before = saved(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        e = saved(_small_star(_large_star(e).distinct()).distinct(), "edges")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
