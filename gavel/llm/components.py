"""Connected components of a link table by alternating star contractions, in joins and sums per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and itself, to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether no node is linked to two smaller ones, or to a smaller and a larger one."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(links.select(F.col("a").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    open_nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 0 and below + above > 1")
    return open_nodes.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root: the smallest node of its component.

    links: (a, b), any direction; loops and repeats don't matter, none gives an empty table. The rounds grow with
    the logarithm of the longest path; each is cut by a checkpoint and ends in one row at the driver. They end as soon as
    all links are stars around their smallest node, so links that come as such stars need no round, and no round is run
    to see that nothing changes. Small stars come first: many links of one node to a few smaller ones, as lists of near
    copies give, are one link a node from there on.
    """
    links = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _are_stars(links):
        links = cut_lineage(_large_star(_small_star(links)))
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
