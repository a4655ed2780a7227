"""Order-dependent greedy choices over a sparse edge table.

The sequential rules ("take the first item, drop what resembles it, go on" and "match each prediction with the first
free gold item") pick the lexicographically first independent set, respectively matching, of a sparse graph. Parts of the
graph that no edge joins are independent, so each is walked in order by one task, and a task walks many: groups of up
to WALK edges as they are; larger groups are split into their connected components first. Only a component of more than WALK
edges goes block by block: its items are numbered by a distributed sort, a round settles a block of them at once, with
what earlier blocks decided joined in, and is cut by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.graph import components
from gavel.functions.ordered import numbered_by_sort
from gavel.session import cut_lineage

BLOCK = 2048  # items a round of a component that is too large for one walk
WALK = 1 << 20  # edges that one walk takes: what it remembers is bounded by them
KEY = "_g"  # the group as one text, in which nulls are values


def _fields(edges: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema if f.name in columns)


def _cover() -> Callable:
    """Takes edges in order; says which cover a node for the first time."""
    covered: set = set()

    def step(lo, hi) -> bool:
        if lo in covered or hi in covered:
            return False
        covered.add(hi)
        return True

    return step


def _match() -> Callable:
    """Takes edges in order; says which are matches."""
    lefts, rights = set(), set()

    def step(left, right) -> bool:
        if left in lefts or right in rights:
            return False
        lefts.add(left)
        rights.add(right)
        return True

    return step


def _walked(edges: DataFrame, unit: list[str], ends: list[str], rule: Callable[[], Callable]) -> DataFrame:
    """The edges that the rule chooses, each unit walked by one task in the order of its edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, rule()
        for batch in batches:
            keep = []
            for i, (key, a, b) in enumerate(zip(zip(*(batch[c].tolist() for c in unit)), batch[ends[0]].tolist(), batch[ends[1]].tolist())):
                if key != last:
                    last, step = key, rule()
                if step(a, b):
                    keep.append(i)
            yield batch.iloc[keep]

    return edges.repartition(*unit).sortWithinPartitions(*unit, *ends).mapInPandas(run, edges.schema)


def _large(edges: DataFrame, unit: list[str], walk: int) -> DataFrame:
    return edges.groupBy(*unit).agg(F.count("*").alias("_n")).where(F.col("_n") > walk).drop("_n")


def _chosen(edges: DataFrame, group: list[str], ends: list[str], rule: Callable, links: Callable[[DataFrame], DataFrame], blockwise: Callable[[DataFrame], DataFrame], walk: int) -> DataFrame:
    """`(group…, ends)` of the chosen edges; links gives `a` and `b` of the edges for the components."""
    columns = [*group, KEY, *ends]
    edges = cut_lineage(edges.select(*group, *ends).distinct().withColumn(KEY, F.to_json(F.struct(*group))).select(*columns))
    large = cut_lineage(_large(edges, [KEY], walk))
    if large.isEmpty():
        return _walked(edges, [KEY], ends, rule)
    small = _walked(edges.join(large, KEY, "left_anti").select(*columns), [KEY], ends, rule)
    rest = links(edges.join(large, KEY, "left_semi"))
    roots = components(rest.select(KEY, "a", "b"), [KEY]).withColumnsRenamed({"node": "a", "root": "_root"})
    unit = [KEY, "_root"]
    placed = cut_lineage(rest.join(roots, [KEY, "a"]).select(*columns, F.to_json(F.struct("_root")).alias("_root")))
    giant = cut_lineage(_large(placed, unit, walk))
    small = small.unionByName(_walked(placed.join(giant, unit, "left_anti").select(*columns, "_root"), unit, ends, rule).select(*columns))
    if giant.isEmpty():
        return small
    return small.unionByName(blockwise(placed.join(giant, unit, "left_semi").select(*columns)).select(*columns))


def _numbered(edges: DataFrame, group: list[str], ends: list[str], block: int) -> DataFrame:
    """Adds the block of each end, `<end>_b`; both ends are numbered together."""
    nodes = None
    for end in ends:
        own = edges.select(*group, F.col(end).alias("_node"))
        nodes = own if nodes is None else nodes.unionByName(own)
    nodes = numbered_by_sort(nodes.distinct(), [*group, "_node"], "_b")
    blocks = cut_lineage(nodes.select(*group, "_node", F.floor(F.col("_b") / block).cast("int").alias("_b")))
    for end in ends:
        edges = edges.join(blocks.withColumnsRenamed({"_node": end, "_b": f"{end}_b"}), [*group, end])
    return cut_lineage(edges)


def _blocks(edges: DataFrame, end: str) -> range:
    last = edges.agg(F.max(f"{end}_b")).first()[0]
    return range(0 if last is None else last + 1)


def first_independent(edges: DataFrame, group: list[str], block: int = BLOCK, walk: int = WALK) -> DataFrame:
    """Covered nodes of the greedy pass over `edges(group…, lo, hi)`, lo < hi: `(group…, node, seed)`.

    A node is a seed unless an earlier seed resembles it; a covered node belongs to its first seed. Nodes
    missing from the result are seeds.
    """

    def blockwise(large: DataFrame) -> DataFrame:
        all_edges = _numbered(large, [KEY], ["lo", "hi"], block)
        covered = all_edges.limit(0).select(KEY, F.col("hi").alias("lo"))
        for b in _blocks(all_edges, "lo"):
            own = all_edges.where(F.col("lo_b") == b).join(covered, [KEY, "lo"], "left_anti")
            inside = _walked(own.where(F.col("hi_b") == b).select(KEY, "lo", "hi"), [KEY], ["lo", "hi"], _cover).select(KEY, F.col("hi").alias("lo"))
            hit = own.join(inside, [KEY, "lo"], "left_anti").select(KEY, F.col("hi").alias("lo"))
            covered = cut_lineage(covered.unionByName(hit).distinct())
        return all_edges.join(covered, [KEY, "lo"], "left_anti").groupBy(*group, KEY, "hi").agg(F.min("lo").alias("lo"))

    links = lambda e: e.withColumns({"a": F.col("lo"), "b": F.col("hi")})
    chosen = _chosen(edges, group, ["lo", "hi"], _cover, links, blockwise, walk)
    return chosen.select(*group, F.col("hi").alias("node"), F.col("lo").alias("seed"))


def first_matching(edges: DataFrame, group: list[str], block: int = BLOCK, walk: int = WALK) -> DataFrame:
    """Greedy one-to-one pairs of `edges(group…, left, right)`: every left item, in order, takes its first
    free right item. Returns the chosen `(group…, left, right)`."""

    def blockwise(large: DataFrame) -> DataFrame:
        all_edges = _numbered(large, [KEY], ["left"], block)
        chosen = all_edges.limit(0).select(*group, KEY, "left", "right")
        for b in _blocks(all_edges, "left"):
            open_edges = all_edges.where(F.col("left_b") == b).join(chosen.select(KEY, "right"), [KEY, "right"], "left_anti")
            chosen = cut_lineage(chosen.unionByName(_walked(open_edges.select(*chosen.columns), [KEY], ["left", "right"], _match)))
        return chosen

    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("item"))
    links = lambda e: e.withColumns({"a": side(0, "left"), "b": side(1, "right")})
    return _chosen(edges, group, ["left", "right"], _match, links, blockwise, walk).select(*group, "left", "right")
