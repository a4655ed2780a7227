"""Slots for a caller's models: classify, answer, generate, embed.

A model is loaded once per Python worker by an iterator pandas UDF and sees Arrow batches. Rows that do not need
it are kept out of the Python stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

CLASS_SCORES = StructType([StructField(n, DoubleType()) for n in ("p_decision", "p_commitment", "p_discussion")])

Model = Callable[[pd.Series], "pd.Series | pd.DataFrame"]


def per_worker(load: Callable[[], Model], returns: DataType = StringType()):
    """A column function from a model loader: `load()` runs once per worker, its result once per batch."""
    if isinstance(returns, StructType):

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                yield model(texts)

    else:

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield model(texts)

    return F.pandas_udf(run, returnType=returns)


def apply_where(df: DataFrame, needed: Column, out: str, value: Column) -> DataFrame:
    """Add `out` = `value` for the rows that need it, null for the others.

    The two sides are separate branches joined by a union, so the model never sees the other rows. `df` should
    be stored when it is expensive, since both branches read it.
    """
    need = F.coalesce(needed, F.lit(False))
    return df.where(need).withColumn(out, value).unionByName(df.where(~need), allowMissingColumns=True)
