"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by a permutation of its own (offset and step from hashes of its
name). Shards take turns; at each turn a shard claims its first free slot. Slots are then nearly even, and adding or
removing a shard moves few of them. A row's slot is a hash of its key modulo the size, so placing a row is one
lookup in a table that is broadcast; the table's size is the parameter `size`, whatever the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MAX_SIZE = 4_194_301  # entries; a broadcast of 50 MB at most


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(seed: int, what: str, name: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{what}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE, seed: int = 42) -> np.ndarray:
    """Index of the shard that owns each slot. Names must be distinct; size a prime of at least their number."""
    if not _is_prime(size) or size > MAX_SIZE:
        raise ValueError(f"size must be a prime up to {MAX_SIZE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("give distinct shards, no more than slots")
    at = [_number(seed, "offset", s) % size for s in shards]
    step = [_number(seed, "step", s) % (size - 1) + 1 for s in shards]
    table = [-1] * size
    left = size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return np.array(table, np.int32)


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE, seed: int = 42) -> DataFrame:
    """The table as rows (slot, shard)."""
    import pandas as pd

    table = fill_table(shards, size, seed)
    rows = pd.DataFrame({"slot": np.arange(size, dtype=np.int64), "shard": np.array(shards, object)[table]})
    return spark.createDataFrame(rows, "slot long, shard string")


def slot_of(key: Column, size: int = SIZE) -> Column:
    """First 60 bits of the key's MD5 modulo the size."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % size


def place(
    docs: DataFrame, key: str = "doc_id", fallback: str | None = "text", shards: tuple[str, ...] = SHARDS,
    size: int = SIZE, seed: int = 42,
) -> DataFrame:
    """All rows with their `slot` and `shard`; no shuffle.

    Rows without a key are placed by the fallback column, so they don't pile up on one shard; without either by the
    empty key. Equal keys go to the same shard, repeated rows stay. Columns named slot or shard are replaced.
    """
    docs = docs.drop("slot", "shard")
    value = F.col(key).cast("string")
    if fallback is not None:
        value = F.coalesce(value, F.concat(F.lit("~"), F.md5(F.col(fallback).cast("string"))))
    table = table_frame(docs.sparkSession, shards, size, seed)
    keyed = docs.withColumn("slot", slot_of(F.coalesce(value, F.lit("")), size))
    return keyed.join(F.broadcast(table), "slot").select(*docs.columns, "slot", "shard")
