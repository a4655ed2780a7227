"""Board collections as Parquet tables: scan, insert, save, delete, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import schemas
from gavel.operators.mutations import delete_rows


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full scan; point reads are a filter on `id`, which reaches the Parquet reader."""
    return spark.read.schema(schemas.COLLECTIONS[name]).parquet(f"{root}/{name}")


def get_by_id(table: DataFrame, row_id) -> DataFrame:
    return table.where(F.col("id") == F.lit(row_id))


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def save(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace by id, or add."""
    return delete_rows(table, rows.select("id")).unionByName(rows, allowMissingColumns=True)


def write_collection(df: DataFrame, root: str, name: str) -> None:
    """Write next to the old version; readers switch when the caller moves on to the new root."""
    df.write.mode("errorifexists").parquet(f"{root}/{name}")


def listing(table: DataFrame, label: str, width: int = 50, status: str | None = None) -> DataFrame:
    """A10: id and a shortened name per row, optionally with a status."""
    extra = [] if status is None else [F.col(status).alias("status")]
    return table.select("id", F.substring(label, 1, width).alias("label"), *extra)


def pending_listing(suggestions: DataFrame) -> DataFrame:
    """A10: pending suggestions, titles cut to 55 characters."""
    return listing(suggestions.where(F.col("review_status") == "PENDING"), "suggested_title", 55)
