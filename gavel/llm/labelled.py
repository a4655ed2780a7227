"""A bounded sample of labelled rows to fit classifiers on, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.session import cut_lineage

PER_CLASS = 10_000  # labelled rows of each class that a classifier is fitted on, at most


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(text, label) of up to per_class labelled rows of each class, stored; and how many labelled rows each stands for.

    Held-out rows are never taken. The rows with the smallest MD5 of their id are, so the sample doesn't depend on how
    the tables are stored. Ids with several labels have the largest; null ids and labels are left out. A class
    without rows is missing in the second result.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    known = cut_lineage(known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label")))
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    order = F.md5(F.col("_id").cast("string"))
    some = [known.where(F.col("label") == y).orderBy(order).limit(per_class) for y in (0, 1)]
    taken = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class ids at most
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(taken, "_id").select("text", "label")
    return cut_lineage(sample), {y: n / min(n, per_class) for y, n in total.items()}
