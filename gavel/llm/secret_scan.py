"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

A candidate is a run of key characters. A window slides over it; the counts of its characters, and with them its
Shannon entropy, are updated by one character in and one out. Each character class has its own threshold; windows
above it are joined into a span. Candidates on the allow-list (plain words, identifiers, examples) are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
# What candidates look like, what is never a secret, bits of entropy by class.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")  # without it, words and numbers in a row: slugs, paths, dates
EXAMPLE = re.compile(r"example|placeholder|changeme|xxxx", re.IGNORECASE)
THRESHOLDS = {"hex": 2.9, "alphanumeric": 3.5, "base64": 3.6}
WINDOW = 20


def class_of(candidate: str) -> str | None:
    """Character class, None where letters or digits are missing."""
    if not (any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)):
        return None
    if all(c in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    return "alphanumeric" if candidate.isalnum() else "base64"


def allowed(candidate: str) -> bool:
    """On the allow-list: no letter beside a digit, a UUID, or an example by its words. One pass each."""
    return not MIXED.search(candidate) or bool(UUID.fullmatch(candidate) or EXAMPLE.search(candidate))


def high_windows(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined (start, end) of the windows whose entropy reaches the threshold."""
    counts: dict[str, int] = {}
    total = 0.0  # of c * log2(c)
    out: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += (n + 1) * log2(n + 1) - (n * log2(n) if n else 0.0)
        counts[c] = n + 1
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            total -= n * log2(n) - ((n - 1) * log2(n - 1) if n > 1 else 0.0)
            counts[gone] = n - 1
        if i >= window - 1 and log2(window) - total / window >= threshold - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy_spans(text: str, taken: list[tuple[str, int, int]], window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """Spans of high entropy outside those that the patterns cover already."""
    thresholds = thresholds or THRESHOLDS
    taken = sorted((s, e) for _, s, e in taken)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]  # reach: farthest end of the first spans
    out = []
    for m in CANDIDATE.finditer(text):
        if not (kind := class_of(m[0])) or allowed(m[0]):
            continue
        for a, b in high_windows(m[0], thresholds[kind], window):
            a, b = a + m.start(), b + m.start()
            if reach[bisect_right(starts, a)] < b:
                out.append(("entropy", a, b))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and `found`, an array of (kind, start, end, text).

    Null and empty texts find nothing (an empty array); repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def scan(batches):
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                found.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for k, a, b in find_spans(text)])
            yield pa.record_batch([batch.column(0), pa.array(found, spans)], names=[id_col, "found"])

    return rows.mapInArrow(scan, f"{id_col} {kind}, found array<struct<kind:string,start:long,end:long,text:string>>")
