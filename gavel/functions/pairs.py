"""Similar pairs inside a group, without a row per pair.

A group's rows are dealt over as many parts as its size asks for, however its order column is numbered, and a row goes out
once for each part that its own part meets: the work of one large group spreads over the cluster, and a row is sent
(rows of the group / rows of a part) times. A task takes two parts, compares them with matrix products (or a text loop behind
cheap upper bounds) and emits only the pairs that reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.similarity import normalized

BLOCK = 256  # texts of a part, and rows that are compared with a part of vectors at once
VECTORS = 64  # a part of vectors has so many times BLOCK rows
KNOWN = 1 << 16  # ratios that a task remembers


def _parts(df: DataFrame, group: list[str], rows: int, name: str) -> DataFrame:
    """The number of parts of the groups of more than `rows` rows."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > rows).select(*group, F.ceil(F.col("_n") / rows).cast("int").alias(name))


def _dealt(a: DataFrame, b: DataFrame | None, group: list[str], value: str, rows: int) -> DataFrame:
    """`(group…, p, q, side, idx, v)`: each pair of parts in one place; without `b` the parts of `a` meet each other."""
    def usable(df: DataFrame) -> DataFrame:
        df = df.select(*group, F.col("idx").cast("long").alias("idx"), F.col(value).alias("v"))
        return df.dropna(subset=[*group, "idx", "v"])

    def sent(df: DataFrame, side: int, parts: list[tuple[str, DataFrame]]) -> DataFrame:
        for _, sizes in parts:
            df = df.join(sizes, group, "left")
        one = lambda name: F.coalesce(name, F.lit(1))
        own = F.pmod(F.xxhash64("idx"), one(parts[0][0])).cast("int")
        other = F.explode(F.sequence(F.lit(0), one(parts[-1][0]) - 1))
        spread = df.select(*group, "idx", "v", own.alias("_own"), other.alias("_other"))
        if b is not None:
            p, q = ("_own", "_other") if side == 0 else ("_other", "_own")
            return spread.select(*group, F.col(p).alias("p"), F.col(q).alias("q"), F.lit(side).alias("side"), "idx", "v")
        p, q = F.least("_own", "_other"), F.greatest("_own", "_other")
        return spread.select(*group, p.alias("p"), q.alias("q"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "idx", "v")

    a = usable(a)
    if b is None:
        dealt = sent(a, 0, [("_a", _parts(a, group, rows, "_a"))])
    else:
        b = usable(b)
        sizes = {"_a": _parts(a, group, rows, "_a"), "_b": _parts(b, group, rows, "_b")}
        dealt = sent(a, 0, [("_a", sizes["_a"]), ("_b", sizes["_b"])]).unionByName(sent(b, 1, [("_b", sizes["_b"]), ("_a", sizes["_a"])]))
    key = [*group, "p", "q"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "side").select(*key, "side", "idx", "v")


def _runs(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by the first n_key columns; a key may span batches."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in batch.columns[:n_key]:
            if n > 1:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        if held and tuple(c[0].as_py() for c in batch.columns[:n_key]) != last:
            yield pa.Table.from_batches(held)
            held = []
        for start, stop in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(start, stop - start))
            if stop < n:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[n - 1].as_py() for c in batch.columns[:n_key])
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    lengths = np.unique(pc.list_value_length(values).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of one group differ in length: {lengths[:5].tolist()}")
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return normalized(flat.reshape(len(values), int(lengths[0])))


def _near_vectors(a: np.ndarray, b: np.ndarray, threshold: float, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) by stretches of b: single precision finds them, with room for its rounding, double precision decides."""
    room = 1.2e-7 * (a.shape[1] + 8)
    low = a.astype(np.float32)
    for start in range(0, len(b), step):
        some = b[start : start + step]
        i, j = np.nonzero(low @ some.astype(np.float32).T >= threshold - room)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            sims = np.einsum("ij,ij->i", a[x], some[y])
            hit = sims >= threshold
            yield x[hit], y[hit] + start, sims[hit]


def _ratios(threshold: float):
    """A function of two texts in order: their ratio, or 0 below the threshold. It remembers some."""
    known: dict[tuple[str, str], float] = {}
    matcher = SequenceMatcher(None)

    def ratio(x: str, y: str) -> float:
        s = known.get((x, y))
        if s is None:
            if matcher.b is not y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            near = matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold
            s = matcher.ratio() if near else 0.0
            if len(known) >= KNOWN:
                known.clear()
            known[x, y] = s
        return s

    return ratio


def _compare(dealt: DataFrame, group: list[str], threshold: float, texts: bool, symmetric: bool) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name in group)
    step = BLOCK

    def near_texts(idx, words, first, second, ratio):
        # The ratio depends on the order of its arguments: the earlier text is the first sequence.
        found = []
        for j in second:
            y = words[j]
            for i in first if y else ():
                x = words[i]
                if not x or (symmetric and idx[i] >= idx[j]):
                    continue
                s = ratio(x, y)
                if s >= threshold:
                    found.append((i, j, s))
        if found:
            i, j, s = zip(*found)
            yield np.array(i), np.array(j), np.array(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_group, ratio = len(group), _ratios(threshold)
        for rows in _runs(batches, n_group + 2):
            side = rows.column("side").to_numpy()
            idx = rows.column("idx").to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = symmetric and rows.column("p")[0].as_py() == rows.column("q")[0].as_py()
            b = a if within else b
            if not len(a) or not len(b):
                continue
            if texts:
                words = [v.lower() for v in rows.column("v").to_pylist()]
                at = idx.tolist()
                found = [*near_texts(at, words, a.tolist(), b.tolist(), ratio)]
                if symmetric and not within:
                    found += near_texts(at, words, b.tolist(), a.tolist(), ratio)
            else:
                unit = _matrix(rows.column("v"))
                found = ((a[i], b[j], s) for i, j, s in _near_vectors(unit[a], unit[b], threshold, step))
            for i, j, s in found:
                lo, hi = idx[i], idx[j]
                if symmetric:
                    keep = lo < hi if within or texts else lo != hi
                    lo, hi, s = np.minimum(lo, hi)[keep], np.maximum(lo, hi)[keep], s[keep]
                if len(s):
                    same = pa.array(np.zeros(len(s), np.int64))
                    keys = [rows.column(k).chunk(0).slice(0, 1).take(same) for k in range(n_group)]
                    yield pa.record_batch([*keys, pa.array(lo), pa.array(hi), pa.array(s)], names=[*group, "lo", "hi", "similarity"])

    return dealt.mapInArrow(run, f"{fields}, lo long, hi long, similarity double")


def _part_rows(texts: bool) -> int:
    return BLOCK if texts else BLOCK * VECTORS


def similar_pairs(df: DataFrame, group: list[str], value: str, threshold: float, texts: bool) -> DataFrame:
    """`(group…, lo, hi, similarity)` of all pairs of one frame with lo < hi; `idx` numbers a group's rows."""
    return _compare(_dealt(df, None, group, value, _part_rows(texts)), group, threshold, texts, True)


def similar_across(
    a: DataFrame, b: DataFrame, group: list[str], value: str, threshold: float, texts: bool
) -> DataFrame:
    """`(group…, lo, hi, similarity)` of all pairs of a row of `a` and a row of `b` in the same group."""
    return _compare(_dealt(a, b, group, value, _part_rows(texts)), group, threshold, texts, False)
