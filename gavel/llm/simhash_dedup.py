"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints of 8 bytes that differ in at most r bits agree in at least 8 - r byte positions. With that minimum spread
over the two halves of the fingerprint, half of it (rounded up) agrees within one half; so the index is keyed by those
sets of positions of a half and their bytes (for r = 3: 8 keys of 3 bytes). Within a list, shared positions are tallied
per pair, pairs that reach the minimum are kept, and their differing bits counted. Only distinct fingerprints enter the
index, and a list yields a spanning forest of its links, so groups of copies make neither long lists nor many pairs.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gavel.llm.components import components
from gavel.session import cut_lineage

SEED = 42
SHINGLE = 3
RADIUS = 3
LIST_ROWS = 4096  # longer lists are compared part against part, each in a task of its own
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes):
    """The text in pieces of about PIECE_BYTES that end between words."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE_BYTES) if at + PIECE_BYTES < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def _hash(joined: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash over the word shingles of a text, with repeats; 0 without words."""
    ones, n, carry = np.zeros(64, np.int64), 0, []
    for piece in _pieces(raw):
        words = carry + piece.lower().split()
        if len(words) >= size:
            length = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(length) - 1
            starts = (ends - length + 1)[: len(words) - size + 1]
            hashes = _hash(b" ".join(words), starts.tolist(), ends[size - 1 :].tolist())
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
            carry = words[len(words) - size + 1 :]
        else:
            carry = words
    if n == 0 and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    found = [fingerprint(t.encode()) if t else 0 for t in texts]
    return pd.Series(np.array(found, np.uint64).view(np.int64))


def position_sets(radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every two fingerprints within the radius share at least one in full."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    share = -(-(8 - radius) // 2)
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, share)]


def _key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def near(one: np.ndarray, many: np.ndarray, radius: int) -> np.ndarray:
    """Which of many are within the radius of any of one: shared positions tallied first, then bits."""
    out = np.zeros(len(many), bool)
    for a in range(0, len(one), 64):
        x = one[a : a + 64, None] ^ many[None, :]
        y = x | (x >> np.uint64(4))
        y |= y >> np.uint64(2)
        y |= y >> np.uint64(1)
        shared = 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))
        enough = shared >= 8 - radius
        out |= (enough & (np.bitwise_count(x) <= radius)).any(axis=0)
    return out


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, each member linked to the first of its tree."""
    left, roots, members = np.sort(fps), [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = near(front, left, radius)
            front, left = left[hit], left[~hit]
            if len(front):
                roots.append(np.full(len(front), root))
                members.append(front)
    return roots, members


def _linked(radius: int):
    def find(batches):
        """Batches of (key, part, fp), sorted by key and part; a list may go on in the next batch."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(ids: np.ndarray, fps: np.ndarray):
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(ids)]))
            roots, members = [], []
            for a, b in zip(starts, ends):
                if b - a > 1:
                    r, m = forest(np.unique(fps[a:b]), radius)
                    roots += r
                    members += m
            if roots:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (roots, members)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            fps = batch.column(2).to_numpy().view(np.uint64)
            last = int(np.flatnonzero((ids == ids[-1]).all(axis=1))[0]) if (ids[0] != ids[-1]).any() else 0
            if held and (held[-1][0][-1] != ids[-1]).any():
                before = held
                held = []
                yield from links(np.concatenate([x for x, _ in before] + [ids[:last]]), np.concatenate([x for _, x in before] + [fps[:last]]))
            elif not held and last:
                yield from links(ids[:last], fps[:last])
            held.append((ids[last:], fps[last:]))
        if held:
            yield from links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return find


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect all pairs within the radius.

    A list of more than list_rows goes out as pairs of its parts, dealt by a hash, so a task holds two parts at most;
    equal fingerprints need no link.
    """
    keys = F.array(*[_key(F.col("fp"), i, p) for i, p in enumerate(position_sets(radius))])
    index = fps.select("fp", F.explode(keys).alias("key"))
    long_lists = (
        index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_rows)
        .select("key", F.ceil(F.col("n") / (list_rows // 2)).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(q, part) * F.col("parts") + F.greatest(q, part))
    dealt = index.join(long_lists, "key", "left").select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)).alias("part"), "fp")
    lists = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return lists.select("key", F.col("part").cast("long"), "fp").mapInArrow(_linked(radius), "a long, b long").distinct()


def groups(rows: DataFrame, id_cols: list[str], radius: int = RADIUS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest struct of the id columns in its component.

    rows: id columns and fp, stored. Fingerprints are counted once, however many rows have them.
    """
    own = cut_lineage(rows.groupBy("fp").agg(F.min(F.struct(*id_cols)).alias("own")))
    roots = components(fingerprint_links(own.select("fp"), radius, list_rows))
    linked = own.join(roots, own["fp"] == roots["node"]).select("fp", "root", "own")
    first = linked.groupBy("root").agg(F.min("own").alias("first"))
    linked = linked.join(first, "root").select("fp", "first")
    return own.join(linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row: its id, `fingerprint` (long) and `component_id`, the smallest id that is reachable over links.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Null ids lose
    against all others; repeated rows stay. Other columns are not read.
    """
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col)).alias("fp")))
    ranked = rows.select(F.col("id").isNull().alias("none"), "id", "fp")
    first = groups(ranked, ["none", "id"], radius, list_rows)
    return rows.join(first, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the smallest id of each component, with all columns as they were.

    Null ids lose against all others; among equal ids the smallest MD5 of the text wins, among equal texts any one.
    """
    digest, key = F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(id_col).cast("string"), F.lit("~"))
    rows = cut_lineage(docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"), fingerprint_of(F.col(text_col)).alias("fp")))
    first = groups(rows, ["none", "id", "digest"], radius).select("first").distinct()
    stay = first.select(F.coalesce(F.col("first.id").cast("string"), F.lit("~")).alias("_llm_key"), F.col("first.digest").alias("_llm_digest"))
    marked = docs.withColumns({"_llm_key": key, "_llm_digest": digest})
    return marked.join(stay, ["_llm_key", "_llm_digest"], "left_semi").dropDuplicates(["_llm_key", "_llm_digest"]).select(*docs.columns)
