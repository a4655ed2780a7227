"""Connected components of an edge table, inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.session import cut_lineage


def components(edges: DataFrame, group: list[str]) -> DataFrame:
    """`(group…, node, root)` of all nodes of `edges(group…, a, b)`; root: the smallest node that is reachable.

    Each round links larger neighbours, then smaller ones, to the smallest node around (alternating stars), in joins and
    minima per node, so a round is two shuffles whatever the size of a component, and rounds grow with the logarithm
    of its longest path. Only one row a round reaches the driver.
    """
    on = lambda c: [*group, c]
    links = edges.where("a <> b").select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, before = cut_lineage(links), None
    while True:
        now = links.agg(F.count("*"), F.expr(f"sum(cast(xxhash64({', '.join([*group, 'a', 'b'])}) as decimal(38,0)))")).first()
        if now == before or now[0] == 0:
            stars = links.select(*group, F.col("b").alias("node"), F.col("a").alias("root"))
            return stars.unionByName(links.select(*group, F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
        both = links.unionByName(links.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*on("a")).agg(F.min("b").alias("m")).select(*group, "a", F.least("a", "m").alias("m"))
        links = both.join(least, on("a")).where("b > a").select(*group, F.col("m").alias("a"), "b").distinct()
        least = links.groupBy(*on("b")).agg(F.min("a").alias("m"))
        moved = links.join(least, on("b")).where("a <> m").select(*group, F.col("m").alias("a"), F.col("a").alias("b"))
        links = cut_lineage(moved.unionByName(least.select(*group, F.col("m").alias("a"), "b")).distinct())
