"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at its block tags into flat blocks. A block's features are the word counts and link densities of the
block before it, itself and the block after it, and what its containers say (-1: a menu, footer, advert or the like;
-0.5: perhaps one, as part of a name says so; 1: the article; 0: nothing). A decision tree, trained on the small labelled table below, keeps or drops it.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and names.
SILENT = frozenset("script style title noscript template iframe svg select textarea button object canvas audio video math".split())
OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s>/\"']*))")
QUOTE_OR_END = re.compile(r"[\"'>]")
SILENT_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in SILENT}
INLINE = frozenset("a b i u s em strong span small big sub sup code tt kbd samp var q cite abbr acronym mark time del ins font wbr label bdi bdo dfn img input data meter output".split())
SPACES = frozenset(["br", "wbr"])
CONTAINERS = frozenset("div section article main nav aside header footer form ul ol dl table figure dialog details menu search".split())
OUTSIDE = frozenset("nav aside footer form dialog menu search".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")
CONTENT_NAMES = frozenset("article body content entry layout main page post story text wrapper".split())
BY_TAG, BY_NAME, DOUBTFUL = -2, -1, -0.5  # what containers say against their text; by tag counts as -1
# Names of which such a part comes first or last are outside in any place, also in an article, unless a part qualifies it.
SURELY_OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored footer cookie cookies consent gdpr comment comments reply replies respond disqus discussion "
    "newsletter subscribe subscription signup related recommended recommendations share sharing".split()
)
QUALIFIERS = frozenset("has have with without no non hide show layout wrapper wrap page body main".split())
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu footer header masthead sidebar ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments discussion replies reply respond disqus share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget copyright toolbar complementary contentinfo".split()
)
# The labelled table. Words and percent of linked words of the block before, the block and the block
# after; what the containers say; 1 if main text.
LABELLED = (
    # menus, headers and footers without any container that says so
    (0, 0, 1, 100, 1, 100, 0, 0), (1, 100, 1, 100, 1, 100, 0, 0), (2, 100, 3, 100, 2, 100, 0, 0), (1, 100, 2, 100, 40, 0, 0, 0),
    (60, 2, 2, 100, 2, 100, 0, 0), (3, 100, 8, 75, 2, 100, 0, 0), (2, 100, 4, 0, 1, 100, 0, 0), (50, 0, 6, 50, 0, 0, 0, 0),
    (2, 100, 9, 60, 3, 100, 0, 0), (1, 100, 5, 80, 70, 0, 0, 0), (12, 90, 14, 85, 10, 90, 0, 0), (0, 0, 2, 100, 80, 0, 0, 0),
    # text without such containers
    (0, 0, 9, 0, 60, 0, 0, 1), (9, 0, 60, 0, 45, 2, 0, 1), (60, 0, 45, 2, 80, 0, 0, 1), (45, 2, 3, 0, 50, 0, 0, 1),
    (80, 0, 1, 0, 35, 5, 0, 1), (35, 5, 90, 10, 2, 100, 0, 1), (2, 100, 70, 0, 30, 0, 0, 1), (30, 0, 25, 20, 40, 0, 0, 1),
    (1, 100, 8, 0, 55, 0, 0, 1), (55, 0, 4, 0, 0, 0, 0, 1), (0, 0, 3, 0, 0, 0, 0, 1), (25, 0, 12, 30, 40, 0, 0, 1),
    # inside an article
    (1, 100, 9, 0, 50, 0, 1, 1), (9, 0, 50, 0, 2, 0, 1, 1), (50, 0, 2, 0, 1, 0, 1, 1), (2, 0, 1, 0, 40, 0, 1, 1),
    (40, 0, 5, 0, 9, 0, 1, 1), (5, 0, 30, 15, 6, 100, 1, 1), (30, 10, 3, 100, 60, 0, 1, 1), (60, 0, 12, 60, 20, 0, 1, 1),
    (20, 0, 1, 100, 1, 100, 1, 1), (12, 0, 7, 0, 3, 100, 1, 1), (70, 0, 8, 100, 0, 0, 1, 1), (0, 0, 4, 100, 50, 0, 1, 1),
    # inside a menu, footer, advert, form, notice, comment
    (0, 0, 1, 100, 1, 100, -1, 0), (1, 100, 2, 100, 9, 0, -1, 0), (60, 0, 12, 0, 0, 0, -1, 0), (2, 100, 9, 0, 10, 0, -1, 0),
    (40, 0, 45, 0, 30, 0, -1, 0), (45, 0, 30, 0, 0, 0, -1, 0), (80, 0, 70, 5, 60, 0, -1, 0), (3, 0, 2, 0, 3, 0, -1, 0),
    (50, 0, 20, 0, 2, 100, -1, 0), (0, 0, 25, 10, 5, 100, -1, 0), (9, 0, 6, 50, 50, 0, -1, 0), (1, 100, 1, 0, 60, 0, -1, 0),
    # inside a container of which part of a name is that of a menu, footer, advert, notice, comment
    (0, 0, 60, 0, 45, 2, -0.5, 1), (60, 0, 45, 2, 80, 0, -0.5, 1), (45, 2, 30, 0, 0, 0, -0.5, 1), (1, 100, 70, 5, 1, 100, -0.5, 1),
    (9, 0, 25, 10, 40, 0, -0.5, 1), (80, 0, 90, 10, 2, 100, -0.5, 1), (2, 0, 40, 0, 50, 0, -0.5, 1), (30, 0, 35, 5, 3, 0, -0.5, 1),
    (0, 0, 2, 0, 1, 100, -0.5, 0), (60, 0, 5, 0, 0, 0, -0.5, 0), (1, 100, 3, 0, 0, 0, -0.5, 0), (40, 0, 4, 0, 2, 100, -0.5, 0),
    (60, 0, 12, 80, 10, 90, -0.5, 0), (2, 100, 1, 100, 1, 100, -0.5, 0), (12, 90, 30, 85, 20, 90, -0.5, 0), (3, 0, 6, 50, 2, 100, -0.5, 0),
)
FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after", "container")
DEPTH = 4


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A tree by Gini impurity: (feature, threshold, low side, high side), or a label. Ties: the first feature."""
    label = int(y.mean() >= 0.5)
    if depth == 0 or y.min() == y.max():
        return label
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            cost = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(cut), low
    if best is None:
        return label
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


TREE = grow(np.array(LABELLED, float)[:, :-1], np.array(LABELLED, float)[:, -1])


def keeps(features: tuple[float, ...], node=None) -> bool:
    node = TREE if node is None else node
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def named(attributes: str) -> float:
    """BY_TAG: a name begins or ends with a part of SURELY_OUTSIDE and no part qualifies it. BY_NAME: all parts of a name are
    of OUTSIDE_NAMES. DOUBTFUL: some parts are, or names of content stand beside it."""
    whole = part = content = False
    for value in NAMES.findall(attributes):
        for name in value.lower().strip("\"'").split():
            parts = NAME_PARTS.findall(name)
            if parts and (parts[0] in SURELY_OUTSIDE or parts[-1] in SURELY_OUTSIDE) and not QUALIFIERS.intersection(parts):
                return BY_TAG
            outside = [p in OUTSIDE_NAMES for p in parts]
            whole |= any(outside) and all(outside)
            part |= any(outside)
            content |= len(parts) == 1 and parts[0] in CONTENT_NAMES
    return BY_NAME if whole and not content else DOUBTFUL if part else 0


def says(tag: str, attributes: str, above: float) -> float:
    """What a container adds to what those above it say.

    Tags, and names that are surely outside, count for all that is in them. An article or main part of no such name is
    one, whatever other names above it say. Inside one, part of such a name says nothing.
    """
    if above == BY_TAG or tag in OUTSIDE:
        return BY_TAG
    name = named(attributes) if attributes else 0
    if name == BY_TAG:
        return BY_TAG
    if tag in ("article", "main"):
        return above if above < 0 and name < 0 else 1
    if above == BY_NAME or name == BY_NAME:
        return BY_NAME
    if tag == "header":
        return above if above > 0 else BY_TAG
    return DOUBTFUL if name < 0 and above <= 0 else above


def tags(page: str):
    """(start, end, closing, name, attributes) of tags, comments and silent elements; the name is empty for the latter two.

    A tag that nothing closes is text. Each quote is looked at once, however many such tags there are.
    """
    dead: set[int] = set()  # quotes from which no end of a tag is reached
    none_from = {'"': len(page), "'": len(page)}  # no such quote from there on

    def end_of(at: int) -> int:
        """Where the tag ends whose attributes begin here, 0 for nowhere."""
        seen = []
        while (m := QUOTE_OR_END.search(page, at)) and m.start() not in dead:
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            other = page.find(m[0], m.end()) if m.end() < none_from[m[0]] else -1
            if other < 0:
                none_from[m[0]] = min(none_from[m[0]], m.end())
                break
            at = other + 1
        dead.update(seen)
        return 0

    at = 0
    while m := OPENING.search(page, at):
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else ">", m.end())
            if end < 0 and m[2]:
                at = m.end()
                break
            at = len(page) if end < 0 else end + (3 if m[1] else 1)
            yield m.start(), at, "", "", ""
            continue
        end = end_of(m.end())
        if not end:
            at = m.start() + 1
            if page.find(">", at) < 0:
                break
            continue
        at, name = end, m[4].lower()
        if name in SILENT and not m[3]:
            last = SILENT_END[name].search(page, end)
            at = last.end() if last else len(page)
            yield m.start(), at, "", "", ""
        else:
            yield m.start(), end, m[3], name, page[m.end() : end - 1]
    comment = page.find("<!--", at)  # where no tag can end any more, one may still begin
    if comment >= 0:
        yield comment, len(page), "", "", ""


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """(text, words, linked words, what the containers say) of the blocks that have text."""
    out: list[tuple[str, int, int, float]] = []
    stack: list[tuple[str, float]] = []
    pieces: list[str] = []
    linked = depth = state = 0
    alone = False  # the block's own name is outside

    def close() -> None:
        nonlocal pieces, linked
        if pieces:
            text = entities.unescape("".join(pieces)).split()
            if text:
                out.append((" ".join(text), len(text), min(linked, len(text)), -1 if alone else max(state, -1)))
            pieces, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if depth:
                linked += len(text.split())

    at = 0
    for start, end, closing, tag, attributes in tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            depth = 0 if closing else 1
        elif tag in SPACES:
            pieces.append(" ")
        elif tag not in INLINE:
            close()
            depth = 0
            alone = not closing and bool(attributes) and tag not in CONTAINERS and named(attributes) == BY_TAG
            if tag in CONTAINERS:
                if not closing:
                    stack.append((tag, says(tag, attributes, state)))
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                state = stack[-1][1] if stack else 0
    add(page[at:])
    close()
    return out


def main_blocks(page: str | None) -> list[str]:
    found = blocks(page or "")
    density = [(n, 100.0 * links / n) for _, n, links, _ in found]
    around = [(0, 0.0), *density, (0, 0.0)]
    return [b[0] for i, b in enumerate(found) if keeps((*around[i], *around[i + 1], *around[i + 2], b[3]))]


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per page: its keys and `blocks`, the texts of its main blocks in page order.

    Null and empty pages, and pages without main text, have no blocks. Tags left open at the end of a page count as
    closed there. Repeated rows give repeated rows; other columns are not read.
    """
    rows = pages.select(*keys, F.col(html_col).alias("_html"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keys)])

    def scan(batches):
        for batch in batches:
            texts = [main_blocks(value.as_py()) for value in batch.column(len(keys))]
            yield pa.record_batch([*batch.columns[: len(keys)], pa.array(texts, pa.list_(pa.string()))], names=[*keys, "blocks"])

    return rows.mapInArrow(scan, f"{types}, blocks array<string>")
