"""Alignment of two tokenizers' tokens, each distinct text once.

Texts are shuffled by their whole text, so that every distinct one meets its copies; it is tokenised and aligned once
and stands for as many documents as have it. Both tokenizers cut the same bytes: where both cut, a group ends, and
every stretch between two cuts of either is one overlap (link) of a token of A with one of B. Counts of linked id pairs
are summed over blocks of texts, weighted by multiplicity, and looked up again for each block's own pairs. The measures
of a text are then joined to the ids of all documents that have it.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import blocks as B
from gavel.session import cut_lineage

SLICE_BYTES = 2 << 20
APART = re.compile(r"(?<=\S)(?= )|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])")  # no byte-level token reaches across such places
STRETCHES = 600_000  # whose ids a worker keeps; what is not kept is tokenised again
SHORT = 64  # characters of a stretch that is kept
HOT_COPIES = 10_000  # a text with more copies is joined to them in parts
HOT_SHARE = 100_000  # and no text counts as hot that has less than this part of all rows, so there are at most as many
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_of_sign() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Files:
    """Both tokenizers' files; they are read on the driver and travel to the workers (some two megabytes)."""

    byte_level: str
    pieces: bytes

    @classmethod
    def read(cls, byte_level_path: str, pieces_path: str) -> Files:
        with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            return cls(a.read(), b.read())


@dataclass
class Aligned:
    """Tokens and links of a run of texts; offsets have one entry more than there are texts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray  # offsets of the texts' links
    a: np.ndarray  # A id of each link
    b: np.ndarray
    groups: list[str]


def overlaps(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
    """Links and groups of two cuttings of the same bytes.

    Returns ends of the links, A and B token of each, whether both tokens end there, and the group of each token.
    """
    total = int(ends_a[-1]) if len(ends_a) else 0
    marks = np.zeros(total + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] |= 2
    ends = np.flatnonzero(marks)
    kind = marks[ends]
    cut_a, cut_b, both = kind & 1, kind >> 1, kind == 3
    of_a, of_b = np.cumsum(cut_a, dtype=np.int64) - cut_a, np.cumsum(cut_b, dtype=np.int64) - cut_b
    group = np.cumsum(both) - both
    return ends, a[of_a], b[of_b], both, group[cut_a > 0], group[cut_b > 0], both[cut_a > 0], both[cut_b > 0]


class Aligner:
    """Tokenises and aligns in a worker."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(files.byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.kept: dict[str, bytes | None] = {}
        sign = byte_of_sign()
        vocabulary = self.first.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = b"".join(bytes([sign[c]]) if c in sign else c.encode() for c in token)
        self.bytes_b = [
            bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.second.get_piece_size())
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # each id as text with what follows it: inside a group, at the end of its side
        self.signs = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]

    def _learn(self, new: list[str]) -> None:
        """Keeps the ids of stretches, packed; None where the tokens' bytes aren't the stretch."""
        for stretch, found in zip(new, self.first.encode_batch_fast(new, add_special_tokens=False)):
            ids = found.ids
            same = b"".join(map(self.bytes_a.__getitem__, ids)) == stretch.encode()
            self.kept[stretch] = np.array(ids, "<i4").tobytes() if same else None

    def first_ids(self, spaced: list[str]) -> list[np.ndarray | None]:
        """A's ids of whole texts: they are cut after words, and each stretch is tokenised once.

        None where a text isn't what its tokens' bytes are.
        """
        cut = [APART.split(t) for t in spaced]
        every = {s for stretches in cut for s in stretches}
        new = every.difference(self.kept)
        if len(self.kept) + len(new) > STRETCHES:
            self.kept, new = {}, every
        self._learn(list(new))
        out = []
        for stretches in cut:
            found = list(map(self.kept.__getitem__, stretches))
            out.append(None if None in found else np.frombuffer(b"".join(found), "<i4"))
        for s in new:
            if len(s) > SHORT:
                del self.kept[s]
        return out

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both; none where a text is empty or the tokens' bytes aren't a space and the text."""
        spaced, none = [" " + t for t in texts], np.zeros(0, np.int32)
        out = []
        for whole, a, b in zip(spaced, self.first_ids(spaced), self.second.encode(texts, num_threads=1)):
            same = len(whole) > 1 and a is not None and b"".join(map(self.bytes_b.__getitem__, b)) == whole.encode()
            out.append((a, np.array(b, np.int32)) if same else (none, none))
        return out

    def align(self, texts: list[str]) -> Aligned:
        found = self.tokens(texts)
        n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, link_a, link_b, both, group_a, group_b, last_a, last_b = overlaps(a, b, ends_a, ends_b)
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        bytes_to = np.concatenate(([0], ends_a))[to_a] if len(texts) else np.zeros(0, np.int64)
        links = np.concatenate(([0], np.searchsorted(ends, bytes_to, "right")))
        groups_to = np.concatenate(([0], np.cumsum(both)))[links]
        place = np.empty(len(a) + len(b), np.int64)  # tokens in the order of the groups, A before B
        place[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + last_a
        place[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(self.bytes_a) + 2 * b + last_b
        cuts = np.concatenate(([0], to_a + to_b))
        text_of = self.signs.__getitem__
        groups = ["".join(map(text_of, place[i:j].tolist()))[:-1] for i, j in zip(cuts[:-1], cuts[1:])]
        return Aligned(n_a, n_b, np.diff(groups_to), links, link_a, link_b, groups)


BLOCK_TYPES = {
    "block": "long", "keys": "array<string>", "copies": "array<long>", **{n: "array<long>" for n in MEASURES[:4]}, "groups": "array<string>",
    "sizes": "binary", "codes": "binary", "times": "binary", "pair_a": "binary", "pair_b": "binary", "weights": "array<long>",
}


class _Block:
    """Texts of a block: measures, and each text's distinct pairs with how often it has them."""

    def __init__(self):
        self.bytes, self.keys, self.copies, self.groups, self.parts, self.pairs = 0, [], [], [], [], []

    def add(self, keys: list[str], copies: list[int], aligned: Aligned) -> None:
        code = aligned.a << 32 | aligned.b
        known, index = np.unique(code, return_inverse=True)
        text = np.repeat(np.arange(len(keys)), np.diff(aligned.links))
        pair, times = np.unique(text * max(len(known), 1) + index, return_counts=True)
        sizes = np.bincount(pair // max(len(known), 1), minlength=len(keys))
        self.keys += keys
        self.copies += copies
        self.groups += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligned.groups]
        self.parts.append((aligned.n_a, aligned.n_b, aligned.n_groups, np.diff(aligned.links), sizes))
        self.pairs.append((known, pair % max(len(known), 1), times))

    def row(self, number: int) -> pa.RecordBatch:
        n_a, n_b, n_groups, n_links, sizes = (np.concatenate(x) for x in zip(*self.parts))
        known = np.unique(np.concatenate([k for k, _, _ in self.pairs]))
        codes = np.concatenate([np.searchsorted(known, k)[i] for k, i, _ in self.pairs])
        times = np.concatenate([t for _, _, t in self.pairs])
        copies = np.array(self.copies, np.int64)
        weights = np.zeros(len(known), np.int64)
        np.add.at(weights, codes, np.repeat(copies, sizes))
        steps = np.diff(codes, prepend=0)  # ascending in each text, so small; a text's first one counts from 0
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[first] = codes[first]
        lists = lambda values, kind: pa.array([values], pa.list_(kind))
        data = [
            pa.array([number], pa.int64()), lists(self.keys, pa.string()), *(lists(x, pa.int64()) for x in (copies, n_a, n_b, n_groups, n_links)), lists(self.groups, pa.string()),
            *(pa.array([B.pack(x)], pa.binary()) for x in (sizes, steps, times, known >> 32, known & 0xFFFFFFFF)), lists(weights, pa.int64()),
        ]
        return pa.record_batch(data, names=list(BLOCK_TYPES))


def _align_blocks(shared, block_bytes: int):
    """Batches of (text, key, copies) to one row a block."""

    def run(batches):
        aligner, numbers, block = Aligner(Files(**shared.value)), B.Numbers(), _Block()
        for batch in batches:
            texts, keys, copies = (batch.column(i).to_pylist() for i in range(3))
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= SLICE_BYTES or i + 1 == len(texts):
                    block.add(keys[start : i + 1], copies[start : i + 1], aligner.align(texts[start : i + 1]))
                    block.bytes += size
                    start, size = i + 1, 0
                    if block.bytes >= block_bytes:
                        yield block.row(numbers.take())
                        block = _Block()
        if block.keys:
            yield block.row(numbers.take())

    return run


def _asked(batches):
    """The pairs of a block: (block, pos, a, b, weight)."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, a, b, weights = (batch.column(k)[i] for k in range(4))
            a, b = B.unpack(a.as_py()), B.unpack(b.as_py())
            yield pa.record_batch([pa.array(np.full(len(a), block.as_py())), pa.array(np.arange(len(a))), pa.array(a), pa.array(b), weights.values], names=["block", "pos", "a", "b", "weight"])


def _measured(batches):
    """One row per text: key, copies, measures and digest."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            _, count, top = B.columns_of(row["found"], ("pos", "n", "top"))
            sizes, steps, times = (B.unpack(row[n].as_py()) for n in ("sizes", "codes", "times"))
            text = np.repeat(np.arange(len(sizes)), sizes)
            summed = np.cumsum(steps)
            before = np.concatenate(([0], summed))[np.cumsum(sizes) - sizes]
            codes = summed - before[text] if len(text) else np.zeros(0, np.int64)
            best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            if len(codes):
                np.add.at(best, text, times * top[codes])
                np.add.at(total, text, times * count[codes])
            columns = [row["keys"].values, row["copies"].values, *(row[n].values for n in MEASURES[:4]), pa.array(best), pa.array(total), row["groups"].values]
            yield pa.record_batch(columns, names=["key", "copies", *MEASURES, "groups_sha256"])


def aligned_texts(docs: DataFrame, files: Files, text_col: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """(key, copies, measures, groups_sha256) of each distinct text; key: its SHA-256. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(files))
    distinct = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    distinct = distinct.select("text", F.sha2("text", 256).alias("key"), "copies")
    types = ", ".join(f"{n} {t}" for n, t in BLOCK_TYPES.items())
    stored = cut_lineage(distinct.mapInArrow(_align_blocks(shared, block_bytes), types))
    asked = stored.select("block", "pair_a", "pair_b", "weights").mapInArrow(_asked, "block long, pos long, a long, b long, weight long")
    counts = cut_lineage(asked.groupBy("a", "b").agg(F.sum("weight").alias("n")))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    known = counts.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("highest")).cast("long").alias("top"))
    answered = B.answers(stored.drop("pair_a", "pair_b", "weights"), asked.drop("weight"), known, ["a", "b"], ["n", "top"])
    measured = ", ".join(f"{n} long" for n in MEASURES)
    return answered.mapInArrow(_measured, f"key string, copies long, {measured}, groups_sha256 string")


def aligned_documents(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, hot: int = HOT_COPIES) -> DataFrame:
    """Per row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text, have zeros and an empty digest.
    Repeated rows give repeated rows, and each counts as a document; other columns are not read.
    """
    texts = cut_lineage(aligned_texts(docs, files, text_col, block_bytes))
    total = texts.agg(F.sum("copies")).first()[0] or 0
    least = max(hot, total // HOT_SHARE)
    parts = F.ceil(F.col("copies") / least).cast("int")
    crowded = F.broadcast(texts.where(F.col("copies") > least).select("key", parts.alias("_parts")))  # HOT_SHARE at most
    rows = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key")).join(crowded, "key", "left")
    rows = rows.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(id_col, F.spark_partition_id()), "_parts"), F.lit(0)))
    spread = texts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > least, parts - 1).otherwise(0))))
    return rows.join(spread, ["key", "_part"]).select(id_col, *MEASURES, "groups_sha256")
