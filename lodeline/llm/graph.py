"""Connected components of links that no machine could hold, by alternating stars.

Large and small star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): each step links every neighbour of a node to the smallest
node known there, and the links become stars around each component's smallest
node after a number of rounds logarithmic in the longest path. Links and labels
stay in tables of the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, new_dir, table

#: Far beyond what any graph that fits a cluster needs; beyond it an error, never a part of the result.
MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool, paths: list[str]) -> DataFrame:
    """One star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # The minima are written so that the join deals both sides anew and a hub's links can be split.
    paths.append(new_dir(links.sparkSession, "star"))
    placed = both.join(table(least, "", paths[-1]), "u")
    if large:
        made = placed.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = placed.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*")
    return made.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (node, component): for each linked node the smallest node it reaches.

    Nodes without links don't appear; links to oneself and repeated links change nothing.
    """
    spark = links.sparkSession
    old: list[str] = []
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    old.append(new_dir(spark, "links"))
    now = table(oriented, "", old[-1])
    state = None
    for _ in range(MOST_ROUNDS):
        paths: list[str] = []
        for large in (True, False):
            paths.append(new_dir(spark, "links"))
            made = paths[-1]
            now = table(_star(now, large, paths), "", made)
        keep = made
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, *old, *(p for p in paths if p != keep))
        old = [keep]
        if (row[0], row[1]) == state:
            break
        state = (row[0], row[1])
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    result = table(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop(spark, *old)
    return result
