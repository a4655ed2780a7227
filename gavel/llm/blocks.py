"""Blocks of texts with a dictionary of their own, and how tables of the whole corpus are looked up for them.

A block is a few megabytes of text, encoded as numbers of its own dictionary. Only the dictionary meets the corpus'
table, in a join by its entries; the answers come back as one array per block. So what is looked up is never broadcast,
and no row per word or token is shuffled. Integer arrays travel as compressed byte planes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

BLOCK_BYTES = 16 << 20


def pack_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack_bytes(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 to 2**32 - 1 as compressed byte planes."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The integers as int64."""
    n = int.from_bytes(data[:8], "little")
    if n == 0:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Numbers:
    """Block numbers of a task: its partition and a running number."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def take(self) -> int:
        self.next += 1
        return self.next - 1


def answers(blocks: DataFrame, asked: DataFrame, known: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """blocks with `found`: an array of structs (pos, values) of the dictionary entries that `known` has; null for none.

    asked: (block, pos, on columns), one row per dictionary entry; a block's answers are bounded by its dictionary.
    """
    found = asked.join(known.select(*on, *values), on).groupBy("block").agg(F.collect_list(F.struct("pos", *values)).alias("found"))
    return blocks.join(found, "block", "left")


def columns_of(found, names: tuple[str, ...]) -> list[np.ndarray]:
    """The fields of an array of structs of one row (an Arrow scalar), in the order of the first one."""
    if not found.is_valid or len(found.values) == 0:
        return [np.zeros(0, np.int64) for _ in names]
    values = found.values
    out = [values.field(n).to_numpy(zero_copy_only=False) for n in names]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def ranked(rows: DataFrame, order: list[Column], store, name: str = "id") -> DataFrame:
    """rows with 0, 1, 2, ... in this order, by a distributed sort; stored.

    The driver gets one count per partition of the sort.
    """
    part, row = F.shiftright(F.col("_m"), 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sorted_ = store(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = sorted_.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()
    before = np.concatenate(([0], np.cumsum([r.n for r in counts])))
    if not counts:
        return sorted_.withColumn(name, F.col("_m")).drop("_m")
    offsets = F.broadcast(rows.sparkSession.createDataFrame([(r[0], int(b)) for r, b in zip(counts, before)], "_p long, _before long"))
    return sorted_.withColumn("_p", part).join(offsets, "_p").withColumn(name, F.col("_before") + row).drop("_p", "_m", "_before")
