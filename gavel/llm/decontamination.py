"""Benchmark decontamination: exact weighted Jaccard of item-sized windows, found from shared shingles.

A window of a document is as many words as a benchmark item has; a document with fewer words is one window. Windows
and items are compared by the weighted Jaccard similarity of their word shingles (weight: number of occurrences).

Item shingles are looked up by their longest word (the alphabetically first of equal ones): a document word that is
such an anchor is checked for the whole shingle around it. The shingles that a document shares with an item are
joined by the shingle; pairs with too few of them for any window go. For the others the best of all windows is found
exactly: each shared occurrence counts in a range of starts, from which it enters the window to where it leaves,
and the start where most ranges meet is the best, wherever the shingles stand in the item. Nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import once

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 200_000  # of distinct anchor words (some 20 MB); more are joined by shuffle


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hash of each run of words; of all of them if fewer."""
    several = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= size, several).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _anchored_items(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, item) of each wording, (key, n_words, shingle, weight) of its shingles, and (word, anchors) of each anchor word.

    Equal wordings are one item, named by the smallest id; items without words are left out. An item's key is the MD5
    of its words, as ids may be null or repeated.
    """
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.min("item").alias("item")).withColumn("key", F.md5(F.concat_ws(" ", "words")))
    names = items.select("key", "item")
    items = items.select("key", "words", F.size("words").alias("n_words"), shingles_of(F.col("words"), size).alias("shingles"))
    places = items.select("key", "words", "n_words", F.posexplode("shingles").alias("at", "shingle"))
    inside = F.slice("words", F.col("at") + 1, size)
    longest = F.array_sort(F.transform(inside, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))[0]["w"]
    places = places.withColumn("inside", inside).withColumn("word", longest).withColumn("skip", (F.array_position("inside", F.col("word")) - 1).cast("int"))
    anchors = places.groupBy("word").agg(F.collect_set(F.struct("shingle", "skip", F.size("inside").alias("n"))).alias("anchors"))
    return names, places.groupBy("key", "n_words", "shingle").agg(F.count("*").cast("int").alias("weight")), anchors


def _best_window(hits: Column, window: Column, last: Column) -> Column:
    """(both, at): most shingles that a window shares with the item, occurrences counted up to the item's, and its start.

    hits: sorted structs (shingle, at, weight); window: shingles in a window; last: the last start. An occurrence
    counts in the windows that hold it, but not as many equal ones before it as the item has. These are windows
    with consecutive starts; the largest number of such ranges that meet in one start is the answer, and it is reached where
    one of them begins.
    """
    def events(found: Column) -> Column:
        def of(h: Column, i: Column) -> Column:
            before = F.get(found, i - h["weight"])
            after = F.when(before["shingle"] == h["shingle"], before["at"] + 1).otherwise(F.lit(0))
            low, high = F.greatest(after, h["at"] - window + 1, F.lit(0)), F.least(h["at"], last)
            pair = F.array(F.struct(low.alias("at"), F.lit(1).alias("add")), F.struct((high + 1).alias("at"), F.lit(-1).alias("add")))
            return F.when(low <= high, pair).otherwise(F.filter(pair, lambda _: F.lit(False)))

        return F.array_sort(F.flatten(F.transform(found, of)))  # at one start, ends before beginnings

    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("both"), F.lit(0).alias("at"))
    step = lambda s, e: _let(s["now"] + e["add"], lambda now: F.struct(now.alias("now"), F.greatest(s["both"], now).alias("both"), F.when(now > s["both"], e["at"]).otherwise(s["at"]).alias("at")))
    return _let(hits, lambda found: F.aggregate(events(found), none, step))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    size: int = SHINGLE, similarity: float = SIMILARITY,
) -> DataFrame:
    """(digest, item, at, similarity): the window of each text that is most like an item, by the MD5 of the text.

    `at` is the window's first word, from 0. Equal texts have equal results and are searched as they come. Null and
    empty texts and items have no windows. A text shorter than an item is one window; texts and items of fewer words
    than a shingle are one shingle. Wordings that share an id, or have none, are searched one by one.
    """
    names, shingles, anchors = _anchored_items(benchmark, item_col, item_text, size)
    if anchors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), words_of(F.col(text_col)).alias("words"))
    found = texts.select("digest", "words", F.posexplode("words").alias("pos", "word")).join(anchors, "word")
    found = found.select("digest", "words", "pos", F.explode("anchors").alias("a")).select("digest", "words", (F.col("pos") - F.col("a.skip")).alias("at"), "a.n", "a.shingle")
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.size("words"))
    same = F.xxhash64(F.slice("words", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("n"))) == F.col("shingle")
    found = found.where(inside & same).select("digest", F.size("words").alias("n_text"), "at", "shingle").distinct()

    # shingles of an item's own window, of the text's
    own = F.greatest(F.col("n_words") - (size - 1), F.lit(1))
    window = F.when(F.col("n_text") >= F.col("n_words"), own).otherwise(F.greatest(F.col("n_text") - (size - 1), F.lit(1)))
    least = lambda a, b: F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-6)  # noqa: E731  # that two of these sizes must share
    found = found.join(shingles, "shingle").withColumns({"own": own, "window": window})
    pairs = found.groupBy("digest", "key", "n_words", "n_text", "own", "window").agg(F.collect_list(F.struct("shingle", "at", "weight")).alias("hits"))
    pairs = pairs.where(F.size("hits") >= least(F.col("own"), F.col("window")))
    best = once(pairs, "best", _best_window(F.array_sort("hits"), F.col("window"), F.greatest(F.col("n_text") - F.col("n_words"), F.lit(0))))
    both = F.col("best.both")
    result = best.select("digest", "key", F.col("best.at").alias("at"), (both / (F.col("own") + F.col("window") - both)).alias("similarity"))
    return result.where(F.col("similarity") >= similarity).join(names, "key").select("digest", "item", "at", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, similarity): the items that each row has, with the best window's similarity; repeated rows stay."""
    found = contaminated(docs, benchmark, text_col, **options).groupBy("digest", "item").agg(F.max("similarity").alias("similarity"))
    rows = docs.select(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    return rows.join(found, "digest").select(id_col, F.col("item").alias("item_id"), "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without a leak, with all columns as they were; rows without text stay."""
    found = contaminated(docs, benchmark, text_col, **options).select(F.col("digest").alias("_llm_digest")).distinct()
    marked = docs.withColumn("_llm_digest", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.join(found, "_llm_digest", "left_anti").select(*docs.columns)
