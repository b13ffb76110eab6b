"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, written

MOST_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with ``m``, the least of its ``u`` and all that ``u`` is joined to. Minima are pre-aggregated, so a node with very
    many edges costs one row a task; the join back can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    held = _with_least(down)
    out = held.select(F.col("v").alias("u"), F.col("m").alias("v")).union(held.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v`` (one comparable type): root is the least node of its component.

    Nodes without a link to another node do not occur. Each round is written to the shared folder, which cuts the lineage.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        # done when every node has one edge, to a node that has none
        nxt = written(small_star(large_star(edges)), "links")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
