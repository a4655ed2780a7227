"""Exact encoding with a piece vocabulary of the merge type, by backtracking, and decoding.

The vocabulary's own rule joins, again and again, the two neighbours whose joined text is the piece of the highest
score (the leftmost of equals). Its result is the only sequence of pieces in which every two neighbours, joined and
merged afresh, come out as the same two pieces. So it is searched from left to right: the longest piece at the
position (one Aho-Corasick pass over the reversed text gives it for all positions), then the next shorter one, until
its neighbour to the left fits; if none fits, the last piece is given up and its end marked in a bitfield, so no
position is tried twice. Texts are cut where no piece can reach across, and what comes out of short stretches is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import words as W

SPACE = "▁"
LETTER, OTHER = r"[^\W\d_¹²³]", r"[\W\d_¹²³]"
STRETCHES, PAIRS = 500_000, 500_000  # results kept in a worker's memory; what falls out is computed again
SHORT = 64  # characters of a stretch whose result is kept


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The vocabulary's rule, step by step; for short texts."""
    parts = list(text)
    while True:
        best, at = None, 0
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def _stretches(made: set[str]) -> str:
    """A pattern that cuts before spaces and after letters, where no piece has such a place inside."""
    if any(SPACE in p.lstrip(SPACE) for p in made):
        return "(?s:.+)"
    if any(re.search(LETTER + OTHER, p) for p in made):
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    other = rf"(?:(?!{SPACE}){OTHER})"
    return f"{SPACE}*{other}*{LETTER}+|{SPACE}*{other}+|{SPACE}+"


@dataclass
class Vocabulary:
    """What the encoder needs of a model file; plain values, so that it travels to workers."""

    proto: bytes
    scores: dict[str, float] = field(default_factory=dict)  # of pieces that merges can make
    ids: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    atoms: list[str] = field(default_factory=list)  # characters of the pieces, be they pieces or not
    shorter: dict[str, str] = field(default_factory=dict)  # the next shorter piece that begins a piece
    stretch: str = "(?s:.+)"  # pattern of stretches that no piece reaches across

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a model file that the driver can read; it holds some hundred kilobytes."""
        with open(path, "rb") as file:
            return cls.of(file.read())

    @classmethod
    def of(cls, proto: bytes) -> Vocabulary:
        """Of a merge-type model with byte pieces and neither user-defined nor unused ones (ValueError for others)."""
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = lib.get_piece_size()
        bytes_ = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in bytes_) or any(lib.is_unused(i) for i in range(size)):
            raise ValueError("the model needs all byte pieces and no unused ones")
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        scores = {lib.id_to_piece(i): lib.get_score(i) for i in normal}
        ids = {lib.id_to_piece(i): i for i in normal}
        atoms = sorted({c for p in scores for c in p})
        made = {p for p in scores if len(p) == 1 or len(merged(p, scores)) == 1} | set(atoms)
        shorter = {}
        for p in made:
            shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in made), "")
        return cls(proto, scores, ids, bytes_, atoms, shorter, _stretches(made))


class Encoder:
    """Encodes and decodes in a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.proto)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.lib.bos_id(), self.lib.eos_id()))
        self.shorter = vocabulary.shorter
        self.longest = ahocorasick.Automaton()
        for piece in vocabulary.shorter:
            self.longest.add_word(piece[::-1], piece)
        self.longest.make_automaton()
        self.stretch = re.compile(vocabulary.stretch)
        self.fits = lru_cache(PAIRS)(self._fits)
        self.kept = lru_cache(STRETCHES)(self._packed)

    def _fits(self, left: str, right: str) -> bool:
        return merged(left + right, self.vocabulary.scores) == [left, right]

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text; characters that no piece has stand alone."""
        n = len(text)
        at_pos: list[str] = [""] * n
        seen = -1
        for last, piece in self.longest.iter(text[::-1]):
            if last != seen:  # of those that end at one place, the longest comes first
                at_pos[n - 1 - last], seen = piece, last
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        pos, piece = 0, at_pos[0] if n else ""
        while pos < n:
            if not at_pos[pos]:  # no piece has this character, nothing merges with it
                out.append(text[pos])
                pos += 1
                piece = at_pos[pos] if pos < n else ""
                continue
            while piece:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or not pos or not at_pos[pos - len(out[-1])] or self.fits(out[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece:
                out.append(piece)
                pos += len(piece)
                piece = at_pos[pos] if pos < n else ""
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                last = out.pop()
                pos -= len(last)
                piece = self.shorter[last]
        return out

    def _packed(self, text: str) -> bytes:
        ids, out = self.vocabulary.ids, []
        for piece in self.backtrack(text):
            known = ids.get(piece)
            if known is None:
                out += [self.vocabulary.byte_ids[b] for b in piece.encode()]
            else:
                out.append(known)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        kept, packed = self.kept, self._packed
        found = [kept(s) if len(s) <= SHORT else packed(s) for s in self.stretch.findall(self.lib.normalize(text))]
        return b"".join((self.begin, *found, self.end))

    def decode(self, packed: bytes) -> str:
        """The library's decoding."""
        return self.lib.decode(np.frombuffer(packed, "<u4").tolist())


def _slices(batches, limit: int = W.SLICE_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about that many bytes; a longer text makes a slice of its own."""
    for batch in batches:
        for first, _, offsets in W.slices(batch.column(1), limit):
            n = len(offsets) - 1
            yield batch.column(0).slice(first, n), [t or "" for t in batch.column(1).slice(first, n).to_pylist()]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, `ids` (binary: little-endian unsigned 32-bit integers, begin and end included), `decoded`.

    Null and empty texts have the begin and end ids only. Repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # as large as the model file, some times over

    def encode(batches):
        encoder = Encoder(Vocabulary(**shared.value))
        for ids, texts in _slices(batches):
            packed = [encoder.encode(t) for t in texts]
            yield pa.record_batch([ids, pa.array(packed, pa.binary()), pa.array([encoder.decode(p) for p in packed], pa.string())], names=[id_col, "ids", "decoded"])

    return rows.mapInArrow(encode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary, decoded string")
