"""Phrases of two and three words that occur together more often than their parts suggest.

Texts become blocks of word numbers. Words that are frequent enough get ids by rank, frequent ones first, so the pairs
of neighbours fall into tiles of a square of ids: full tiles are counted by direct address (one cell a pair, numpy's
bincount), sparse ones as sorted coordinates. The counts of all blocks are summed by pair; in each block the pairs that
are frequent enough are ranked by these sums and become the ids of the next level, where two overlapping neighbours are
three words. A phrase that is frequent enough consists of such parts only, so no other is ever counted.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm import blocks as B
from gavel.session import cut_lineage

LEAST = 10  # occurrences of a candidate
SHARE = 50  # percent of a candidate's occurrences that drop it where they lie inside a longer one
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
TILE = 1024  # ids a side
FULL = 8  # a tile is counted by direct address from one occurrence in so many cells on
SALTS = 16
BREAK, SPACE = b"\n", b" "
_SIGNS = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", SPACE + BREAK * 9)
_CUT = re.compile(BREAK)


def tile_counts(first: np.ndarray, second: np.ndarray, tile: int = TILE, full: int = FULL) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (first << 32 | second), ascending, and how often each occurs; ids are ranks, frequent ones small."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    across = int(second.max()) // tile + 1
    of = (first // tile) * across + second // tile
    cell = (first % tile) * tile + second % tile
    tiles, size = np.unique(of, return_counts=True)
    dense = tiles[size * full >= tile * tile]
    codes, counts = [], []
    for t in dense:
        n = np.bincount(cell[of == t], minlength=tile * tile)
        hit = np.flatnonzero(n)
        codes.append((hit // tile + t // across * tile) << 32 | (hit % tile + t % across * tile))
        counts.append(n[hit])
    rest = ~np.isin(of, dense)
    code, n = np.unique(first[rest] << 32 | second[rest], return_counts=True)
    codes, counts = np.concatenate([*codes, code]), np.concatenate([*counts, n])
    order = np.argsort(codes)
    return codes[order], counts[order]


def pieces_of(raw: bytes, limit: int):
    """The text in stretches of about `limit` bytes that end at breaks; one without a break stays whole."""
    at = 0
    while at < len(raw):
        cut = _CUT.search(raw, at + limit) if at + limit < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


class _Words:
    """Words of a block of one language, as numbers in the order of their first occurrence; breaks are 0, gaps 1."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[BREAK], self.number[b""]
        self.bytes, self.codes = 0, []

    def add(self, stretch: bytes) -> None:
        words = (BREAK + stretch).replace(BREAK, b" \n ").split(SPACE)
        codes = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.codes.append(codes[codes != 1])
        self.bytes += len(stretch)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        """Numbers by frequency, the frequent ones small; 0 is a break."""
        codes = np.concatenate(self.codes)
        n = np.bincount(codes, minlength=len(self.number))
        order = np.argsort(-n[2:], kind="stable") + 2
        new = np.zeros(len(n), np.int64)
        new[order] = np.arange(1, len(order) + 1)
        words = list(self.number)
        packed = (B.pack_bytes(BREAK.join(words[i] for i in order)), B.pack(n[order]), B.pack(new[codes]))
        return pa.record_batch([pa.array([number]), pa.array([lang]), pa.array([int(n[order].sum())]), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "lang", "n", "words", "counts", "codes"])


def _word_blocks(block_bytes: int):
    """Batches of (lang, text) to one row a block and language."""

    def run(batches):
        numbers, open_blocks = B.Numbers(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, raw = lang.as_py(), (text.as_py() or "").encode().lower().translate(_SIGNS)
                for stretch in pieces_of(raw, block_bytes):
                    block = open_blocks.setdefault(lang, _Words())
                    block.add(stretch)
                    if block.bytes >= block_bytes:
                        yield block.row(numbers.take(), lang)
                        del open_blocks[lang]
                if sum(b.bytes for b in open_blocks.values()) >= 2 * block_bytes:  # many languages: the largest goes
                    lang = max(open_blocks, key=lambda k: open_blocks[k].bytes)
                    yield open_blocks.pop(lang).row(numbers.take(), lang)
        for lang, block in open_blocks.items():
            yield block.row(numbers.take(), lang)

    return run


def _asked_words(batches):
    """(block, lang, pos, word, n) of a block's words."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, counts = B.unpack_bytes(batch.column(2)[i].as_py()), B.unpack(batch.column(3)[i].as_py())
            n = len(counts)
            same = [pa.array([batch.column(k)[i].as_py()] * n, t) for k, t in ((0, pa.int64()), (1, pa.string()))]
            text = pa.array([w.decode() for w in words.split(BREAK)] if n else [], pa.string())
            yield pa.record_batch([*same, pa.array(np.arange(1, n + 1)), text, pa.array(counts)], names=["block", "lang", "pos", "word", "n"])


def _ranks(row_codes: bytes, found) -> np.ndarray:
    """Rank at each position, -1 for what has none."""
    pos, ids = B.columns_of(found, ("pos", "id"))
    codes = B.unpack(row_codes)
    rank = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
    rank[pos] = ids
    return rank[codes]


def _neighbours(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of neighbours that both have one, and where they stand."""
    at = np.flatnonzero((ranks[:-1] >= 0) & (ranks[1:] >= 0))
    return ranks[at], ranks[at + 1], at


def _pair_blocks(tile: int):
    """Blocks of word numbers to blocks of pair numbers; 0: no pair starts here."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ranks = _ranks(batch.column(1)[i].as_py(), batch.column(2)[i])
                first, second, at = _neighbours(ranks)
                pairs, counts = tile_counts(first, second, tile)
                codes = np.zeros(len(ranks), np.int64)
                codes[at] = np.searchsorted(pairs, first << 32 | second) + 1
                packed = [B.pack(x) for x in (codes, pairs >> 32, pairs & 0xFFFFFFFF, counts)]
                yield pa.record_batch([batch.column(0).slice(i, 1), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "codes", "first", "second", "counts"])

    return run


def _pairs(batches):
    """(block, pos, pair, n) of a block's pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            first, second, counts = (B.unpack(batch.column(k)[i].as_py()) for k in (1, 2, 3))
            for a in range(0, len(first), 1 << 18):
                s = slice(a, a + (1 << 18))
                pair = first[s] << 32 | second[s]
                yield pa.record_batch([pa.array(np.full(len(pair), batch.column(0)[i].as_py())), pa.array(np.arange(a + 1, a + 1 + len(pair))), pa.array(pair), pa.array(counts[s])], names=["block", "pos", "pair", "n"])


def _phrases(tile: int):
    """(pair, third, n): a block's phrases of three words, and with third -1 the sums of the pairs that it stands for."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pair = B.unpack(batch.column(2)[i].as_py()) << 32 | B.unpack(batch.column(3)[i].as_py())
                pos, f, first = B.columns_of(batch.column(4)[i], ("pos", "f", "first"))
                mine = first.astype(bool)
                by_rank = pos[np.argsort(-f, kind="stable")]  # frequent pairs first
                rank = np.full(len(pair) + 1, -1, np.int64)
                rank[by_rank] = np.arange(len(by_rank))
                one, two, _ = _neighbours(rank[B.unpack(batch.column(1)[i].as_py())])
                codes, n = tile_counts(one, two, tile)
                ranked = pair[by_rank - 1]
                rows = (
                    np.concatenate([pair[pos[mine] - 1], ranked[codes >> 32]]),
                    np.concatenate([np.full(int(mine.sum()), -1), ranked[codes & 0xFFFFFFFF] & 0xFFFFFFFF]), np.concatenate([f[mine], n]),
                )
                for a in range(0, len(rows[0]), 1 << 18):
                    yield pa.record_batch([pa.array(x[a : a + (1 << 18)].astype(np.int64)) for x in rows], names=["pair", "third", "n"])

    return run


def best_of_groups(rows: DataFrame, group: str, order: list, top: int, salts: int = SALTS) -> DataFrame:
    """The first `top` rows of each group with their `rank`. Groups may be of any size: each is cut by salts first."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    first = rows.withColumn("_s", salt).withColumn("_n", F.row_number().over(Window.partitionBy(group, "_s").orderBy(*order))).where(F.col("_n") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return last.where(F.col("rank") <= top).drop("_s", "_n")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int | None = TOP,
    block_bytes: int = B.BLOCK_BYTES, tile: int = TILE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    Words are runs of other characters than space and tab, A-Z in lower case, and phrases don't reach across
    `. , ; : ! ?` and line breaks. n: words of the language; a: occurrences of the phrase; l, r: of its two parts at
    the cut with the lowest score, the first of equals; score: SCALE * a * a / (l * r), rounded down. Phrases are left
    out that occur less than `least` times, or that lie in a longer such phrase with `share` percent of their
    occurrences. By score and a, both descending, and phrase; top=None gives all of them, unranked (rank null).

    Null languages are one of their own, UNKNOWN. Null and empty texts have no words; repeated rows count as often as
    they are there; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    blocks = cut_lineage(rows.mapInArrow(_word_blocks(block_bytes), "block long, lang string, n long, words binary, counts binary, codes binary"))
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))

    each = blocks.select("block", "lang", "words", "counts").mapInArrow(_asked_words, "block long, lang string, pos long, word string, n long")
    words = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = cut_lineage(B.ranked(words, [F.desc("f"), "lang", "word"], cut_lineage))
    known = B.answers(blocks.select("block", "codes"), each.drop("n"), words, ["lang", "word"], ["id"])
    pair_blocks = cut_lineage(known.mapInArrow(_pair_blocks(tile), "block long, codes binary, first binary, second binary, counts binary"))

    each = pair_blocks.drop("codes").mapInArrow(_pairs, "block long, pos long, pair long, n long")
    alike = Window.partitionBy("pair")  # at most one row a block
    summed = each.select("block", "pos", F.sum("n").over(alike).alias("f"), (F.min("block").over(alike) == F.col("block")).cast("int").alias("first")).where(F.col("f") >= least)
    found = summed.groupBy("block").agg(F.collect_list(F.struct("pos", "f", "first")).alias("found"))
    counted = pair_blocks.drop("counts").join(found, "block").mapInArrow(_phrases(tile), "pair long, third long, n long")
    counted = cut_lineage(counted.groupBy("pair", "third").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    pairs, triples = counted.where("third < 0").drop("third"), counted.where("third >= 0")

    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    one, two = (words.select(F.col("id").alias(f"id{k}"), *(["lang"] if k == 1 else []), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2))
    of_two = pairs.select("pair", "a", first.alias("id1"), second.alias("id2")).join(one, "id1").join(two, "id2").select("pair", "lang", "a", "w1", "w2", "f1", "f2")
    tail = F.shiftleft(second, 32).bitwiseOR(F.col("third"))  # the last two words
    longer = triples.select(F.explode(F.array(F.col("pair"), tail)).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("longer"))
    kept = of_two.join(longer, "pair", "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < share * F.col("a").cast("decimal(38,0)")))
    phrases_two = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.array(_cut("f1", "f2")).alias("cuts"))
    left = of_two.select("pair", "lang", "w1", "f1", F.col("a").alias("f12"))
    right = of_two.select(F.col("pair").alias("tail"), F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    of_three = triples.select("pair", tail.alias("tail"), "a").join(left, "pair").join(right, "tail")
    phrases_three = of_three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array(_cut("f1", "f23"), _cut("f12", "f3")).alias("cuts"))

    every = phrases_two.unionByName(phrases_three).join(totals, "lang")
    found = every.withColumn("cut", F.array_sort(F.transform("cuts", lambda c, k: F.struct(c["score"].alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r"))))[0])
    found = found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    if top is None:
        return found.select("lang", F.lit(None).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    best = best_of_groups(found, "lang", [F.desc("score"), F.desc("a"), "phrase"], top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(left: str, right: str):
    """l, r and the score of a cut, in 38 decimal digits, which hold SCALE * a * a below a = 10 ** 15."""
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
    return F.struct(F.col(left).alias("l"), F.col(right).alias("r"), score.cast("long").alias("score"))
