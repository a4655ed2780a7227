"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the sources of a tree domain - language - source. The token budget is propagated from the root: each node
shares its budget among its children by their weights, but no child gets more than its leaves can give (their tokens
times the number of epochs allowed). What a child cannot take goes to its siblings by their weights; only what all
siblings together cannot take is missing at the node, which the shares of its own siblings have made up for already,
as capacities are known for whole subtrees. Each leaf then reads its documents in an order shuffled by a seed, epoch
after epoch, up to its budget: whole epochs for all documents, and a prefix of one more epoch.

All numbers are integers (tokens and weights), so the result doesn't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.session import cut_lineage

LEVELS = ("domain", "lang", "source")
EPOCHS = 2
DIGITS = (3, 3)  # hex digits of the key by which a leaf's prefix is found, step by step: 4096 parts of 4096 parts
WIDE = "decimal(38,0)"
BROADCAST_LEAVES = 100_000


def tokens_of(text: Column) -> Column:
    """Number of runs of visible characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """A domain for sources that come without one: the number in the source's name modulo `domains`."""
    return F.concat(F.lit("domain"), (F.coalesce(F.regexp_extract(source, r"(\d+)", 1).try_cast("long"), F.lit(0)) % domains).cast("string"))


def share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `budget` to rows of (parent..., child, weight, capacity, parent_budget); weights are positive integers.

    In ascending order of capacity by weight, children are full as long as their capacity is at most their share of
    what is left; the others share the rest by weight, rounded down, and tokens lost to rounding go one each to the
    first of them by name.
    """
    everyone = Window.partitionBy(*parent)
    order = everyone.orderBy(F.col("capacity").cast("double") / F.col("weight"), child)
    before = F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(WIDE))
    w = nodes.withColumns({"_w": F.col("weight").cast(WIDE), "_c": F.col("capacity").cast(WIDE)})
    w = w.withColumns({"_left": F.col("parent_budget").cast(WIDE) - before, "_weights": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    w = w.withColumn("_open", F.expr("_c * _weights > _left * _w"))
    w = w.withColumns({"_rest": F.max(F.expr("if(_open, _left, null)")).over(everyone), "_shares": F.max(F.expr("if(_open, _weights, null)")).over(everyone)})
    w = w.withColumn("budget", F.expr("if(_open, (_rest * _w) div _shares, capacity)"))
    w = w.withColumns({"_lost": F.expr("cast(_rest as bigint)") - F.sum(F.expr("if(_open, budget, 0)")).over(everyone), "_place": F.row_number().over(Window.partitionBy(*parent, "_open").orderBy(child))})
    return w.withColumn("budget", F.expr("budget + if(_open and _place <= _lost, 1, 0)")).select(*nodes.columns, "budget")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    of = weights.get(level) or {}
    if any(not isinstance(v, int) or v <= 0 for v in of.values()):
        raise ValueError("weights are positive integers")
    named = F.create_map(*[F.lit(x) for pair in of.items() for x in pair]) if of else None
    return F.lit(1).cast("long") if named is None else F.coalesce(F.try_element_at(named, F.col(level)), F.lit(1)).cast("long")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Rows of (levels..., tokens) with `budget`: tokens to read of each leaf."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs).withColumn("_all", F.lit(0))
    total = nodes.groupBy("_all").agg(F.sum("capacity").alias("capacity"), F.least(F.floor(F.sum("tokens") * F.lit(share)), F.sum("capacity")).cast("long").alias("budget"))
    above = total.select("_all", F.col("budget").alias("parent_budget"))
    for depth, level in enumerate(levels):
        parent = ["_all", *levels[:depth]]
        children = nodes.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        shared = share_out(children.join(above, parent), parent, level)
        above = shared.select(*parent, level, F.col("budget").alias("parent_budget"))
    return leaves.join(above.select(*levels, F.col("parent_budget").alias("budget")), list(levels))


def plan(rows: DataFrame, weights: dict[str, dict[str, int]], share: float, epochs: int, seed: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels..., whole, last): whole epochs of each leaf, and the last key of the prefix of one more.

    Up to BROADCAST_LEAVES leaves, some 20 MB, are broadcast to joins with rows, also to the caller's; more are joined by
    shuffle. They are counted once, as no later table has more rows than there are leaves.

    rows: (levels..., id, tokens), stored. The prefix is found by sums over parts of the key range, then inside the
    part where the budget ends, so no task sorts a whole leaf.
    """
    on = list(levels)
    leaves = cut_lineage(rows.groupBy(*on).agg(F.sum("tokens").alias("tokens")))
    hinted = F.broadcast if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else lambda some: some
    budgets = leaf_budgets(leaves, weights, share, epochs, levels)
    budgets = budgets.withColumn("whole", F.expr("if(tokens > 0, budget div tokens, 0)")).withColumn("part", F.expr("budget - whole * tokens"))
    budgets = cut_lineage(budgets.select(*on, "whole", "part"))

    def inside(known: DataFrame) -> DataFrame:
        keyed = rows.join(hinted(known), on).withColumn("key", order_key(F.col("id"), F.col("whole"), seed))
        return keyed.where(F.col("key").startswith(F.col("at")))

    known = budgets.where("part > 0").select(*on, "whole", "part", F.lit("").alias("at"))
    for digits in DIGITS:
        sums = inside(known).groupBy(*on, "whole", "part", F.substring("key", F.lit(1), F.length("at") + digits).alias("at")).agg(F.sum("tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*on).orderBy("at"))
        crossed = sums.withColumn("upto", upto).where("upto > part")
        first = F.min_by(F.struct("whole", (F.col("part") - F.col("upto") + F.col("n")).alias("part"), "at"), "at").alias("s")
        known = cut_lineage(crossed.groupBy(*on).agg(first).select(*on, "s.whole", "s.part", "s.at"))
    keys = inside(known).groupBy(*on, "part", "at", "key").agg(F.sum("tokens").alias("n"))
    fits = keys.withColumn("upto", F.sum("n").over(Window.partitionBy(*on).orderBy("key"))).where("upto <= part")
    last = hinted(known.select(*on, "at")).join(fits.groupBy(*on).agg(F.max("key").alias("key")), on, "left").select(*on, F.coalesce("key", "at").alias("last"))
    return hinted(cut_lineage(budgets.join(last, on, "left").select(*on, "whole", F.coalesce("last", F.lit("")).alias("last"))))


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_col))


def mix(
    docs: DataFrame, weights: dict[str, dict[str, int]], share: float, epochs: int = EPOCHS, seed: int = 42,
    levels: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows that are read, with the names of their leaf (`_llm_domain`, `_llm_lang`, `_llm_source`) and `_llm_copies`, the epochs that read them.

    weights: by level, by name, positive integers; names not listed have weight 1. share: the budget as a part of all
    tokens. Null names make a leaf of their own (""), null ids are ordered by the text's MD5. Rows that stand equal in
    an epoch (repeated ids) are read together or not at all. Documents without tokens cost nothing and are read with
    the prefix or the epochs in which they stand; a leaf of only such documents is not read.
    """
    levels = levels or {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    names = {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()}
    identity = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = cut_lineage(docs.select(*[v.alias(k) for k, v in names.items()], identity.alias("id"), tokens_of(F.col(text_col)).alias("tokens")))
    found = plan(rows, weights, share, epochs, seed, tuple(levels))
    found = found.select(*[F.col(k).alias(f"_llm_{k}") for k in levels], F.col("whole").alias("_llm_whole"), F.col("last").alias("_llm_last"))
    marked = docs.withColumns({f"_llm_{k}": v for k, v in names.items()} | {"_llm_id": identity}).join(found, [f"_llm_{k}" for k in levels])
    more = F.when(order_key(F.col("_llm_id"), F.col("_llm_whole"), seed) <= F.col("_llm_last"), 1).otherwise(0)
    marked = marked.withColumn("_llm_copies", (F.col("_llm_whole") + more).cast("long")).where("_llm_copies > 0")
    return marked.drop("_llm_id", "_llm_whole", "_llm_last")


def mixed_documents(docs: DataFrame, weights: dict[str, dict[str, int]], share: float, **options) -> DataFrame:
    """The rows that are read, once for each epoch, with the columns of docs."""
    copies = mix(docs, weights, share, **options).withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_copies").cast("int"))))
    return copies.select(*docs.columns)
