"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two aggregates, combined before the shuffle, and two joins on node and a salt;
nothing is collected, and no task holds a component.  A step's links are written in the shared folder, which cuts lineage.  The rounds
end when the links are stars, after about the logarithm of the largest component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import salted_join, written


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (itself counts)."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both.filter("v > u"), least, ["u"], ["v"], salts=4).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = salted_join(down, least, ["u"], ["v"], salts=4).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether links (u, v), u above v, are stars: each u has one, and no v is a u.  That is one aggregate, where another round would be several joins."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of every node that has a link (u, v, longs): the component's least node."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most):
        links = written(_small(written(_large(links), "large")), "links")  # each reads its links twice
        if _settled(links):
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
