"""Licence scans with a generalised suffix automaton.

One automaton holds the token sequences of all licence templates. A text is streamed through it; the state after each
word gives the longest template piece that ends there (matching statistics). Long matches are anchored to a template
and a diagonal, and chained where they follow each other in both texts, into spans that cover part of a template.
Words that no template has reset the automaton, so only runs of template words are streamed one by one; the rest is
numpy on whole slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import words as W

# Phrases that mark a licence, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Licence notices, by label. Texts of the public licences themselves, shortened to their notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
MIN_MATCH = 3  # words of a match that is worth chaining
MAX_GAP = 8  # words between two matches of a chain, in either text
MIN_COVER = 0.75  # part of the template that a span must cover to give its label
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first:long,last:long,cover:double>>"


class SuffixAutomaton:
    """Of several token sequences; `ends` has a (sequence, end) where each state's longest piece occurs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(sequences):
            last = 0
            for end, token in enumerate(tokens, 1):
                last = self._extend(last, token)
                self.ends[last].append((number, end))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] = sorted(set(self.ends[self.link[state]]) | set(self.ends[state]))

    def _state(self, transitions: dict[int, int], link: int, length: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state for the shorter pieces of q that p reaches by token."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return self._split(last, token, known)
        state, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, token, self.next[p][token])
        return state

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """(state, length of the longest piece that ends here) after each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
            yield state, length


def _model(templates=TEMPLATES, phrases=PHRASES):
    sequences = [t.split() for _, t in templates]
    asked = [p.split() for p, _ in phrases]
    vocabulary = sorted({w for s in sequences + asked for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    codes = np.array([W.hash_of(w) for w in vocabulary], np.uint64)
    order = np.argsort(codes)
    return (
        codes[order], order.astype(np.int64), SuffixAutomaton([[number[w] for w in s] for s in sequences]),
        [len(s) for s in sequences], [np.array([number[w] for w in s]) for s in asked],
    )


def _maximal(automaton: SuffixAutomaton, tokens: list[int], at: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(template, its first word, word of the text, length) of matches that don't go on to the right."""
    stats = list(automaton.statistics(tokens))
    for i, (state, length) in enumerate(stats):
        if length >= least and (i + 1 == len(stats) or stats[i + 1][1] != length + 1):
            for template, end in automaton.ends[state]:
                yield template, end - length, at + i + 1 - length, length


def chain(matches: list[tuple[int, int, int, int]], sizes: list[int], gap: int = MAX_GAP) -> list[tuple[int, int, int, float]]:
    """Chains of one template's matches: (template, first word, last word, covered part of the template)."""
    out = []
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for template, start, word, length in matches:
        by_template.setdefault(template, []).append((word, start, length))
    for template, found in sorted(by_template.items()):
        closed: list[list[int]] = []
        open_: list[list[int]] = []  # first word, end in the text, end in the template, covered words
        for word, start, length in sorted(found):
            if any(word - c[1] > gap for c in open_):  # too far behind for this match and all later ones
                closed += [c for c in open_ if word - c[1] > gap]
                open_ = [c for c in open_ if word - c[1] <= gap]
            best = None
            for c in open_:
                fresh = length - max(0, c[1] - word, c[2] - start)
                if word + length > c[1] and start + length > c[2] and fresh > 0 and start - c[2] <= gap and (best is None or c[3] > best[0][3]):
                    best = c, fresh
            if best:
                best[0][1:] = [word + length, start + length, best[0][3] + best[1]]
            else:
                open_.append([word, word + length, start + length, length])
        out += [(template, c[0], c[1] - 1, c[3] / sizes[template]) for c in sorted(closed + open_)]
    return out


def scan_batch(column, templates=TEMPLATES, phrases=PHRASES, least: int = MIN_MATCH, gap: int = MAX_GAP, cover: float = MIN_COVER, model=None) -> list[tuple]:
    """A tuple in the order of SCHEMA for each text."""
    codes, order, automaton, sizes, asked = model or _model(templates, phrases)
    out = []
    for _, data, offsets in W.slices(column):
        starts, ends, _, first = W.runs(data, offsets)
        found = W.hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        token = np.where(codes[at] == found, order[at], -1) if len(found) else np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        base: dict[int, list[tuple[int, str]]] = {}
        for words, (_, label) in zip(asked, phrases):
            n = len(token) - len(words) + 1
            if n > 0:
                hit = np.ones(n, bool)
                for k, w in enumerate(words):
                    hit &= token[k : k + n] == w
                for i in np.flatnonzero(hit):
                    if text_of[i] == text_of[i + len(words) - 1]:
                        base.setdefault(int(text_of[i]), []).append((int(i - first[text_of[i]]), label))
        known = np.concatenate(([False], token >= 0, [False]))
        breaks = np.zeros(len(known), bool)
        breaks[first] = True  # a run ends with its text
        begin = np.flatnonzero(known[1:-1] & (~known[:-2] | breaks[:-2]))
        stop = np.flatnonzero(known[1:-1] & (~known[2:] | breaks[1:-1])) + 1
        matches: dict[int, list] = {}
        for a, b in zip(begin, stop):
            if b - a >= least:
                text = int(text_of[a])
                matches.setdefault(text, []).extend(_maximal(automaton, token[a:b].tolist(), int(a - first[text]), least))
        for text in range(len(offsets) - 1):
            places = base.get(text, [])
            spans = [s for s in chain(matches.get(text, []), sizes, gap) if s[3] >= cover]
            base_labels = sorted({label for _, label in places})
            labels = sorted({templates[s[0]][0] for s in spans} | set(base_labels))
            out.append(
                (
                    int(first[text + 1] - first[text]), len(places), min((p for p, _ in places), default=None),
                    max((p for p, _ in places), default=None), ",".join(base_labels), ",".join(labels),
                    min(1.0, max((s[3] for s in spans), default=1.0 if places else 0.0)),
                    [{"label": templates[t][0], "template": t, "first": a, "last": b, "cover": min(1.0, c)} for t, a, b, c in spans],
                )
            )
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: its id, number of words, base phrases (count, first, last, labels), all labels, score, spans.

    Score: the largest covered part of a template, 1 where only a phrase was found, 0 without either. Null and empty
    texts: no words, nothing found. Repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    result = rows.limit(0).select(id_col).schema
    schema = f"{id_col} {result[0].dataType.simpleString()}, {SCHEMA}"
    struct = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]

    def scan(batches):
        model = _model(options.get("templates", TEMPLATES), options.get("phrases", PHRASES))
        for batch in batches:
            columns = list(zip(*scan_batch(batch.column(1), model=model, **options))) or [()] * len(names)
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[id_col, *names])

    return rows.mapInArrow(scan, schema)
