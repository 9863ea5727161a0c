"""Connected components over a table of links, by alternating stars.

Large-star and small-star steps (each a map-side combined minimum and a join)
turn every component into a star around its smallest member.  Each step writes
its table to the shared folder, so lineage stays short; the driver only sees a
count and a checksum.  A hub with a third of all links is combined before the
shuffle; its minimum is written before it is joined, so that AQE can broadcast the
minima or split the hub's links.

Defined cases: links with a null end and links to oneself are ignored; repeated
links count once; ids without a link have no row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.workspace import Workspace


def _large_star(edges: DataFrame, space: Workspace) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = space.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, space: Workspace) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = space.save(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, space: Workspace) -> DataFrame:
    """``(a, b)`` links of long ids to ``(id, component)`` for every id that has
    a link to another; component is the smallest id reachable.  Links with a
    null end and links to oneself are ignored; repeated links count once."""
    edges = space.save(links.select("a", "b").filter("a <> b"), "links")
    seen = None
    while True:
        large = space.save(_large_star(edges, space), "large")
        stars = space.save(_small_star(large, space), "stars")
        space.drop(large)
        space.drop(edges)
        edges = stars
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
