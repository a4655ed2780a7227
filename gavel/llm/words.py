"""Words of whole UTF-8 texts as numpy arrays, straight from Arrow buffers; used inside tasks.

Memory follows the text in hand: a batch is walked in slices of whole texts of about `SLICE_BYTES`, and a longer
text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_HASH_WORDS = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


WORD_BYTES = np.zeros(256, np.uint8)  # 1 in words: digits, letters, all beyond ASCII
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_BYTES[_low : _high + 1] = 1
SYMBOL_BYTES = WORD_BYTES.copy()  # and 2 for other visible bytes
SYMBOL_BYTES[33:127][WORD_BYTES[33:127] == 0] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of whole texts; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(data: np.ndarray, offsets: np.ndarray, symbols: bool = False):
    """Starts, ends and classes of the tokens, and the first token of every text (one more at the end)."""
    kind = (SYMBOL_BYTES if symbols else WORD_BYTES)[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    of = kind[starts] if len(starts) else kind[:0]
    keep = of > 0
    starts, ends, of = starts[keep], ends[keep], of[keep]
    return starts, ends, of, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range (not empty), A-Z folded."""
    out = np.empty(len(starts), np.uint64)
    values = _VALUES[LOWER] if fold else _VALUES
    for a in range(0, len(starts), _HASH_WORDS):
        s, e = starts[a : a + _HASH_WORDS], ends[a : a + _HASH_WORDS]
        length = e - s
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        inner = np.arange(int(length.sum())) - np.repeat(begin, length)
        power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
        h = np.add.reduceat(values[data[inner + np.repeat(s, length)]] * power[inner], begin)
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out[a : a + _HASH_WORDS] = h
    return out


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])
