"""Document fingerprints: bottom-k sketches of shingle hashes, as column functions.

A sketch is the sorted array of the k smallest distinct hashes of a text's word shingles. Sketches of parts merge into
the sketch of the whole. The k smallest hashes of two sketches together are a uniform sample of the union of their
shingles; the part of them that both have estimates the resemblance, the part of A's that B has the containment of A
in B. With fewer than k shingles all of this is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.text import let, once

K = 128
SHINGLE = 5
BUCKET_ROWS = 2000
MAX_BUCKETS = 20_000
NO_HASHES = "array<bigint>"


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """Sketch of a text's shingles of lower-case words (runs of visible characters); of all words if there are fewer.

    Null texts and texts without words have an empty sketch.
    """
    clean = F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20]+", " ")))
    none = F.array().cast(NO_HASHES)

    def hashes(words: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
        return F.when(words[0] == "", none).when(F.size(words) >= size, several).otherwise(F.array(F.xxhash64(words)))

    return F.slice(F.sort_array(F.array_distinct(let(F.split(clean, " "), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """(keys, sketch) of all sketches of a group. Groups may be of any size: hashes are cut to k per salt first."""
    hashes = rows.select(*keys, F.explode(sketch_col).alias("_h")).distinct().withColumn("_s", F.pmod("_h", F.lit(salts)))
    first = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy("_h"))).where(F.col("_n") <= k)
    last = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|, 0 to 1; 1 where both are empty."""
    share = lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, 0 to 1; 1 where A is empty."""
    share = lambda ours: F.when(F.size(a) == 0, 1.0).when(F.size(ours) == 0, 0.0).otherwise(F.size(F.array_intersect(ours, b)) / F.size(ours))
    return let(F.array_intersect(merge(a, b, k), a), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(a: Column) -> Column:
    """The hashes as 16 hex digits each, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bucket(key: Column, bounds: list) -> Column:
    """Number of bounds up to the key, in two steps of about the square root of their number; null keys go last."""
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda b: b <= key))
    fine = F.array(*[F.array(*map(F.lit, p)) for p in parts])
    return F.when(key.isNull(), len(bounds)).when(coarse == 0, 0).otherwise((coarse - 1) * step + up_to(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def with_next(rows: DataFrame, keys: DataFrame, key: str, columns: list[str], tie: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds next_<column> of the row after, in ascending key order; after the last row the first.

    Null keys come last, equal keys by the tie column. Rows are dealt to buckets of consecutive keys once; the first
    key of a bucket also goes to the bucket before as a stand-in, so no task sees more than a bucket and its successor.
    `keys` holds the key column alone, so that finding the buckets computes nothing else of the rows.
    """
    n, first = keys.agg(F.count("*"), F.min(key)).first()
    buckets = min(MAX_BUCKETS, n // bucket_rows + 1)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(keys.agg(F.percentile_approx(key, shares, 10 * buckets)).first()[0] or [])) if shares else []
    bounds = [b for b in bounds if b is not None and b > first]
    where = _bucket(F.col(key), bounds) if bounds else F.lit(0)
    own = F.struct(where.alias("bucket"), F.lit(0).alias("stand"))
    before = F.struct((where - 1).alias("bucket"), F.lit(1).alias("stand"))
    wrap = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("stand"))
    is_bound = F.col(key).isin(bounds) if bounds else F.lit(False)
    is_first = F.col(key).eqNullSafe(F.lit(first))
    places = F.filter(F.array(own, F.when(is_bound, before), F.when(is_first, wrap)), lambda p: p.isNotNull())
    dealt = rows.withColumn("_p", F.explode(places)).withColumns({"_bucket": F.col("_p.bucket"), "_stand": F.col("_p.stand")}).drop("_p")
    order = Window.partitionBy("_bucket").orderBy("_stand", F.col(key).asc_nulls_last(), tie)
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.where("_stand = 0").drop("_bucket", "_stand")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row: id, n_chars, the edited text, sketches of both texts and of the next row's.

    The edited text replaces the last half of the code points (rounded down) by as many of the next row's first ones.
    Null texts count as empty; rows with equal ids are ordered by text, null ids come last; repeated rows stay.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = once(rows, "sketch", sketch(F.col("text"), k, size))
    rows = with_next(sketched, rows.select("id"), "id", ["text", "sketch"], "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return once(once(rows, "edited", F.col("edited")), "edited_sketch", sketch(F.col("edited"), k, size))
