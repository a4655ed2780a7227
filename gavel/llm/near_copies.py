"""Near copies by five-word shingles: wide SimHash, a byte-position index, count filtering, exact verification.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in some 15 % of their SimHash bits, which no 8 byte
positions can show. So the fingerprint has 32 bytes, and the index holds sets of two positions with their bytes. In
a list, pairs that share enough bytes and differ in few bits are linked; lists and the groups they make are spanned by
trees, never by all pairs. Every group is then verified: its members' shingles meet once, and only exact similarities
of 0.8 or more count. Which pairs share a set is a matter of chance, so a small part of the pairs is not found (see the README).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.components import components
from gavel.llm.simhash_dedup import SEED, _pieces
from gavel.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
LANES = 4  # 64-bit words of a fingerprint
BITS, BYTES = 56, 3  # most differing bits, least shared bytes of a pair that is verified
SETS = 64  # sets of two byte positions
SHORT_LIST = 64  # rows of a list of which all pairs are compared at once
LIST_ROWS, PART_ROWS = 4096, 1000  # longer lists and larger groups are compared part against part


def word_shingles(text: str, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """(digest of the words, hash of each shingle); of all words if there are fewer, none without words."""
    digest, hashes, carry, of = hashlib.md5(), [], [], xxhash.xxh64_intdigest
    for piece in _pieces(text.encode()):
        fresh = piece.lower().split()
        for w in fresh:
            digest.update(w + b" ")
        words = carry + fresh
        hashes += [of(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]
        carry = words[max(len(words) - size + 1, 0) :] if len(words) >= size else words
    if not hashes and carry:
        hashes = [of(b" ".join(carry), SEED)]
    return digest.digest(), np.array(hashes, np.uint64)


def wide_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """SimHash of 64 * lanes bits; each lane has the majority bits of the hashes mixed anew."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 1 << 16):
            h = hashes[a : a + (1 << 16)] ^ np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def position_pairs(sets: int = SETS, positions: int = 8 * LANES) -> list[tuple[int, int]]:
    """Distinct sets of two positions; with the default number each position is in four of them."""
    return [(i, (i + step) % positions) for step in range(1, positions) for i in range(positions)][:sets]


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which fingerprints of many share BYTES bytes and all but BITS bits with any of one; rows of lanes."""
    out = np.zeros(len(many), bool)
    for a in range(0, len(one), 64):
        x = one[a : a + 64, None, :] ^ many[None, :, :]
        shared = (x.view(np.uint8) == 0).sum(axis=2)
        out |= ((shared >= BYTES) & (np.bitwise_count(x).sum(axis=2) <= BITS)).any(axis=0)
    return out


def tree_links(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that connect what is connected: near(front, left) tells which of left (indexes) are near any of front."""
    left, links = np.arange(len(ids)), []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = near(front, left)
            front, left = left[hit], left[~hit]
            links += [(int(ids[root]), int(ids[i])) for i in front]
    return links


def _groups(batches, names: tuple[str, ...]):
    """Runs of rows of one group from batches sorted by (group, part), as lists of columns; a group may span batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if last is not None and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def stars(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of `size` positions reaches by the links a, b."""
    least = np.arange(size)
    while True:
        lower = np.minimum(least[a], least[b])
        if (least[a] == least[b]).all():
            return least
        np.minimum.at(least, least[a], lower)
        np.minimum.at(least, least[b], lower)
        while (least[least] != least).any():
            least = least[least]


def _list_links(group: np.ndarray, ids: np.ndarray, fps: np.ndarray, short: int = SHORT_LIST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) inside lists; group: number of each row's list, ascending, ids ascending in it. Short lists are compared all at once.

    All that is connected in a list is linked to its smallest id: lists of the same near copies then name few different
    links, and a list gives fewer links than it has rows.
    """
    size = np.bincount(group)
    few = size[group] <= short
    found = []
    for step in range(1, short):
        at = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]))
        if not len(at):
            break
        x = fps[at] ^ fps[at + step]
        near = (np.bitwise_count(x).sum(axis=1) <= BITS) & ((x.view(np.uint8) == 0).sum(axis=1) >= BYTES)
        found.append(np.stack([at[near], at[near] + step]))
    if found:
        least = stars(len(ids), *np.concatenate(found, axis=1))
        moved = np.flatnonzero(least != np.arange(len(ids)))
        yield ids[least[moved]], ids[moved]
    first = np.concatenate(([0], np.cumsum(size)))
    for g in np.flatnonzero(size > short):
        own, some = ids[first[g] : first[g + 1]], fps[first[g] : first[g + 1]]
        links = tree_links(own, lambda one, many: alike(some[one], some[many]))  # noqa: B023
        if links:
            yield tuple(np.array(links).T)


def _linked_fingerprints(batches):
    """Batches of (key, part, node, lanes) sorted by key, part and node; the last list of a batch may go on in the next one."""
    held = None

    def links(rows: np.ndarray):
        if len(rows):
            new = np.concatenate(([False], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            for a, b in _list_links(np.cumsum(new), rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            rows = np.column_stack([batch.column(k).to_numpy() for k in range(3 + LANES)])
            rows = rows if held is None else np.concatenate([held, rows])
            last = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0])
            yield from links(rows[:last])
            held = rows[last:]
    if held is not None:
        yield from links(held)


def _linked_texts(similarity: float, size: int):
    """Links between texts of a group with at least the similarity."""

    def run(batches):
        for table in _groups(batches, ("root", "part")):
            ids, at = np.unique(table.column(2).to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            sets = [np.unique(word_shingles(table.column(3)[int(i)].as_py(), size)[1]) for i in at]
            sizes = np.array([len(s) for s in sets])

            def near(front: np.ndarray, left: np.ndarray) -> np.ndarray:
                owner, every = np.repeat(np.arange(len(left)), sizes[left]), np.concatenate([sets[i] for i in left])  # noqa: B023
                out = np.zeros(len(left), bool)
                for i in front:
                    spot = np.searchsorted(sets[i], every)  # noqa: B023
                    spot[spot == sizes[i]] = 0  # noqa: B023
                    shared = np.bincount(owner, sets[i][spot] == every if sizes[i] else None, len(left)) if sizes[i] else np.zeros(len(left))  # noqa: B023
                    out |= shared >= similarity * (sizes[i] + sizes[left] - shared) - 1e-9  # noqa: B023
                return out

            links = tree_links(ids, near)
            if links:
                yield _link_batch(links)

    return run


def _parted(rows: DataFrame, key: str, most: int, few: bool) -> DataFrame:
    """rows with `part`: 0 in groups of at most `most` rows; larger ones go out as pairs of their parts; few: their number is bounded."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / (most // 2)).cast("int").alias("_parts"))
    large = F.broadcast(large) if few else large
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda q: (F.least(q, own) * F.col("_parts") + F.greatest(q, own)).cast("long"))
    none = F.array(F.lit(0).cast("long"))
    return rows.join(large, key, "left").withColumn("part", F.explode(F.when(F.col("_parts").isNull(), none).otherwise(others))).drop("_parts")


def _dealt(rows: DataFrame, key: str, most: int, columns: list[str], few: bool = False) -> DataFrame:
    return _parted(rows, key, most, few).repartition(key, "part").sortWithinPartitions(key, "part", "node").select(key, "part", "node", *columns)


def _near_nodes(docs: DataFrame, id_col: str, text_col: str, similarity: float, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, roots): the rows' (none, id, digest, words, lanes) and the nodes' (node, words, own, lanes), both stored,
    and the (node, root) of nodes that have a link. A node is a distinct sequence of words, own its smallest (none, id, digest).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    lanes = [f"f{k}" for k in range(LANES)]

    def fingerprints(batches):
        for batch in batches:
            found = [word_shingles(t, size) for t in batch.column(3).to_pylist()]
            fps = np.array([wide_fingerprint(h) for _, h in found], np.uint64).reshape(len(found), LANES).view(np.int64)
            yield pa.record_batch([*batch.columns[:3], pa.array([d for d, _ in found], pa.binary()), *(pa.array(fps[:, k]) for k in range(LANES))], names=["none", "id", "digest", "words", *lanes])

    kind = given.schema[1].dataType.simpleString()
    rows = cut_lineage(given.mapInArrow(fingerprints, f"none boolean, id {kind}, digest string, words binary, " + ", ".join(f"{x} long" for x in lanes)))
    nodes = rows.groupBy("words").agg(F.min(F.struct("none", "id", "digest")).alias("own"), *[F.first(x).alias(x) for x in lanes])
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))

    byte = lambda p: F.shiftrightunsigned(f"f{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255))
    keys = F.array(*[F.shiftleft(F.lit(i).cast("long"), 16).bitwiseOR(F.shiftleft(byte(p), 8)).bitwiseOR(byte(q)) for i, (p, q) in enumerate(position_pairs())])
    index = nodes.select("node", *lanes, F.explode(keys).alias("key"))
    lists = _dealt(index, "key", LIST_ROWS, lanes, few=True)  # there are SETS * 65,536 keys at most, some 60 MB
    coarse = cut_lineage(components(lists.mapInArrow(_linked_fingerprints, "a long, b long").distinct()))

    # one text of each node of a group, however many rows have it
    members = nodes.join(coarse, "node").select("node", "root", F.col("own.digest").alias("digest"))
    texts = given.select("digest", "text").join(members, "digest").groupBy("node", "root").agg(F.min("text").alias("text"))
    links = _dealt(texts, "root", PART_ROWS, ["text"]).mapInArrow(_linked_texts(similarity, size), "a long, b long").distinct()
    return rows, nodes, components(links)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, first): the rows' (none, id, digest, words), stored, and for each distinct sequence of words (`words`) the
    smallest (none, id, digest) of its group.

    Rows with the same words are one node. Nodes are linked from that similarity of their sets of shingles on.
    """
    rows, nodes, roots = _near_nodes(docs, id_col, text_col, similarity, size)
    linked = nodes.join(roots, "node").select("words", "root", "own")
    first = linked.join(linked.groupBy("root").agg(F.min("own").alias("first")), "root").select("words", "first")
    return rows.select("none", "id", "digest", "words"), nodes.select("words", "own").join(first, "words", "left").select("words", F.coalesce("first", "own").alias("first"))


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest id of each group of near copies, with all columns as they were.

    Null texts count as empty, and texts without words as one group. Null ids lose against all others; among equal
    ids the smallest MD5 of the text wins, among equal texts any one.
    """
    _, nodes, roots = _near_nodes(docs, id_col, text_col, similarity, SHINGLE)
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("own").alias("first"))
    digest, key = F.md5(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(id_col).cast("string"), F.lit("~"))
    stay = first.select(F.coalesce(F.col("first.id").cast("string"), F.lit("~")).alias("_llm_key"), F.col("first.digest").alias("_llm_digest"))
    marked = docs.withColumns({"_llm_key": key, "_llm_digest": digest})
    return marked.join(stay, ["_llm_key", "_llm_digest"], "left_semi").dropDuplicates(["_llm_key", "_llm_digest"]).select(*docs.columns)
