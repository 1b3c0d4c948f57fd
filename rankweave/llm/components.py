"""Connected components of a link table by repeated contraction, without ever gathering links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def contract(links: DataFrame) -> DataFrame:
    """``v``, ``c``: for every end of a link (columns a, b) the smallest end that it is connected with.

    Each pass maps every vertex to its smallest neighbour or itself and rewrites the links' ends; links inside a
    vertex vanish. At least half of the vertices that still have links vanish too, so passes are logarithmic. Both
    ends are pre-aggregated, so a vertex with very many links costs one row a task.
    """
    edges = stash(links.select("a", "b").where("a <> b").distinct(), "edges")
    label = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("to"))
        down = stash(down, "down")
        label = label.join(down, "c", "left").select("v", F.coalesce("to", "c").alias("c"))
        left = down.select(F.col("c").alias("a"), F.col("to").alias("x"))
        right = down.select(F.col("c").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = stash(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return stash(label, "label")


def merged(label: DataFrame, fresh: DataFrame) -> DataFrame:
    """``label`` (v, c) after more links: only the components that they join are contracted anew."""
    named = lambda e, x: label.select(F.col("v").alias(e), F.col("c").alias(x))
    ends = fresh.select("a", "b").join(named("a", "x"), "a", "left").join(named("b", "y"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    step = contract(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("v").alias("c"), F.col("c").alias("to"))
    every = label.unionByName(ends.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(label, "v", "left_anti").withColumn("c", F.col("v")))
    return stash(every.join(step, "c", "left").select("v", F.coalesce("to", "c").alias("c")), "label")
