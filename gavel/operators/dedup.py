"""Duplicate tasks: equal titles, then similar ones, inside a meeting or across the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.greedy import first_independent
from gavel.functions.pairs import similar_pairs
from gavel.functions.text import once, strip
from gavel.session import cut_lineage


def drop_equal_titles(tasks: DataFrame) -> DataFrame:
    """One row per (meeting, lower-case title): the most confident, the earliest of equals. Empty titles
    all stay. A grouped maximum, combined map-side, so a title repeated millions of times is no hot spot."""
    title = strip(F.lower(F.coalesce("task", F.lit(""))))
    key = F.when(title == "", F.concat(F.lit("\n"), F.col("ord"))).otherwise(title)
    best = tasks.groupBy("meeting_id", key.alias("_key")).agg(
        F.max_by(
            F.struct(*[c for c in tasks.columns if c != "meeting_id"]),
            F.struct("confidence", (-F.col("ord")).alias("_o")),
        ).alias("_best")
    )
    return best.select("meeting_id", "_best.*").select(*tasks.columns)


def duplicate_pairs(
    tasks: DataFrame, group: list[str], threshold: float = lx.DUPLICATE_SIMILARITY, vectors: str | None = None
) -> DataFrame:
    """I2 + I3: pairs of tasks of one group that are duplicates, by vectors or by text ratio."""
    rows = tasks.select(*group, F.col("ord").alias("idx"), F.col(vectors or "task").alias("v"))
    if vectors is None:
        rows = rows.select(*group, "idx", strip(F.coalesce("v", F.lit(""))).alias("v"))
    return similar_pairs(rows, group, "v", threshold, texts=vectors is None)


def drop_similar(
    tasks: DataFrame,
    threshold: float = lx.DUPLICATE_SIMILARITY,
    vectors: str | None = None,
    group: list[str] | None = None,
) -> DataFrame:
    """I4: seeds in order; a seed's group is itself plus the later similar tasks not taken yet; each group
    emits its most confident task, the earliest of equals."""
    group = ["meeting_id"] if group is None else group
    # The candidate tasks are read several times below (blocks, owners); store them instead of recomputing
    # the transcripts behind them.
    tasks = cut_lineage(tasks)
    taken = first_independent(duplicate_pairs(tasks, group, threshold, vectors), group)
    owner = tasks.join(taken.withColumnRenamed("node", "ord"), [*group, "ord"], "left").withColumn(
        "_seed", F.coalesce("seed", "ord")
    )
    best = owner.groupBy(*group, "_seed").agg(
        F.max_by(
            F.struct(*[c for c in tasks.columns if c not in group]),
            F.struct("confidence", (-F.col("ord")).alias("_o")),
        ).alias("_best")
    )
    return best.select(*group, "_best.*").select(*tasks.columns)


def near_titles(tasks: DataFrame, threshold: float = lx.DUPLICATE_SIMILARITY, title_col: str = "task") -> DataFrame:
    """Pairs `(a, b, similarity)` of different titles of the whole corpus whose word sets have at least that Jaccard similarity.

    Titles are taken once, lower-cased, however many tasks have them, in one row per set of words; join back on the title
    for the tasks. Sets of so few words that no other set is similar enough meet equal sets only. For the others words
    are ordered from rare to frequent: two similar sets share one of the first n - ceil(t n) + 1 words of either, and the
    first that they share leaves enough words behind it in both. An equi-join on these finds every pair, and frequent words
    hardly ever are keys. Only numbers go along: the set's hash, its size, the words left, and the parity of its
    words in 128 cells, of which as many differ as words do, at most. So nearly all pairs that are not similar fall in
    the join; the texts are sent once by their set's hash and once for each pair left, and decide. A list longer
    than LIST_ROWS goes out as pairs of parts of it, so no task sees more than two parts. Nothing is stored between.
    """
    title = strip(F.lower(F.col(title_col)))
    titles = tasks.select(title.alias("title")).where("title <> ''")
    # A row holds all titles of a set (they are pairs anyway), and those of any other set with its hash.
    sets = titles.groupBy(F.xxhash64(F.array_join(_words(F.col("title")), " ")).alias("id")).agg(F.collect_set("title").alias("titles"))
    lists = _parted(_keyed(sets, threshold, _frequencies(titles)))
    columns = ("id", "size", "rest", "even", "odd", "part")
    a, b = (lists.toDF(*[f"{side}_{c}" for c in columns], "w", "low", "high") for side in "ab")
    once_ = (F.col("a_part") != F.col("b_part")) | (F.col("low") == F.col("high"))  # rows of one part meet in one place
    sizes = F.col("a_size") + F.col("b_size")
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in ("even", "odd"))
    close = (
        (F.col("a_id") < F.col("b_id"))
        & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-9)
        & (F.least("a_rest", "b_rest") >= sizes * (threshold / (1 + threshold)) - 1e-6)
        & (differ <= sizes * ((1 - threshold) / (1 + threshold)) + 1e-6)
    )
    near = a.join(b.hint("merge"), ["w", "low", "high"]).where(once_ & close).select("a_id", "b_id").distinct()
    one, two = (sets.select(F.col("id").alias(f"{side}_id"), F.explode_outer("titles").alias(name)) for side, name in (("a", "one"), ("b", "two")))
    different = near.join(one.hint("merge"), "a_id").join(two.hint("merge"), "b_id").select("one", "two")
    equal = sets.where(F.size("titles") > 1).select("titles", F.explode_outer("titles").alias("one")).select("one", F.explode_outer("titles").alias("two")).where("one < two")
    return _similar(different, threshold).unionByName(_similar(equal, threshold))


LIST_ROWS = 4096
CELLS = 1 << 16  # of the table of word frequencies, and of the counts of the lists


def _words(title: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_remove(F.split(title, r"\s+"), "")))


def _frequencies(titles: DataFrame) -> bytearray:
    """The logarithm of how often words come, by the hash of the word: any order of the words gives all pairs, this one few others."""
    cell = F.pmod(F.hash("w"), F.lit(CELLS))
    counts = titles.select(F.explode_outer(_words(F.col("title"))).alias("w")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    table = bytearray(CELLS)
    for r in counts.collect():
        table[r.cell] = min(255, round(8 * math.log2(1 + r.n)))
    return table


def _keyed(sets: DataFrame, threshold: float, frequencies: bytearray) -> DataFrame:
    """(id, size, rest, even, odd, w): each set of words under the hashes of its first words; `rest`: how many words this one begins."""
    def ranked(w: Column) -> Column:
        key = F.hash(w)
        return F.struct(F.substring(F.lit(frequencies), F.pmod(key, F.lit(CELLS)) + 1, F.lit(1)).alias("n"), key.alias("w"))

    def parity(odd: int) -> Column:
        cell = lambda p: F.shiftrightunsigned(p["w"], 16)
        bit = lambda p: F.when(cell(p) % 2 == odd, F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(cell(p), 1) % 64)).otherwise(F.lit(0).cast("long"))
        return F.aggregate("words", F.lit(0).cast("long"), lambda s, p: s.bitwiseXOR(bit(p)))

    # Equal hashes of different sets are told apart here.
    words = F.explode_outer(F.array_distinct(F.transform("titles", _words)))
    ordered = sets.select("id", words.alias("words")).select("id", F.sort_array(F.transform("words", ranked)).alias("words"))
    size = F.size("words")
    first = F.when(size / (size + 1) >= threshold - 1e-9, F.slice("words", F.lit(1), (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int")))
    summed = once(ordered, "sum", F.struct(size.alias("size"), parity(0).alias("even"), parity(1).alias("odd")))
    keys = summed.select("id", "sum", F.posexplode_outer(first).alias("at", "p")).where("p IS NOT NULL")
    return keys.select("id", "sum.size", (F.col("sum.size") - F.col("at")).alias("rest"), "sum.even", "sum.odd", F.col("p.w").alias("w"))


def _parted(keyed: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, size, rest, even, odd, part, w, low, high): each row of a long list goes to all pairs of parts that hold its own."""
    rows = rows or LIST_ROWS
    cell = F.pmod("w", F.lit(CELLS))
    long = keyed.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_cell", F.ceil(F.col("_n") / (rows // 2)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    columns = ("id", "size", "rest", "even", "odd")
    spread = keyed.withColumn("_cell", cell).join(F.broadcast(long), "_cell", "left").select(*columns, own.alias("part"), "w", other.alias("_q"))  # CELLS rows at most
    return spread.select(*columns, "part", "w", F.least("part", "_q").alias("low"), F.greatest("part", "_q").alias("high"))


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (one, two) of titles that are similar enough."""
    words = once(once(pairs, "one_words", _words(F.col("one"))), "two_words", _words(F.col("two")))
    shared = F.size(F.array_intersect("one_words", "two_words"))
    ratio = F.when(F.col("one_words") == F.col("two_words"), 1.0).otherwise(shared / (F.size("one_words") + F.size("two_words") - shared))
    similar = once(words, "similarity", ratio).where(F.col("similarity") >= threshold)
    return similar.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "similarity")
