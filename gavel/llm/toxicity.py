"""Toxicity: a classifier regularised by counterfactuals.

A text's features are its words, beginnings and endings of words (so made-up compounds count too), each once. Training
minimises the log loss plus a penalty on the squared change of the logit when identity terms in a labelled sentence
are swapped for others of their kind, so that naming a group moves the score little by itself. The sentences are the
labelled sample's own and the neutral ones below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import words as W
from gavel.llm.labelled import PER_CLASS, held_out, labelled_sample

# Identity terms by kind and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he", "they"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("american", "mexican", "chinese", "indian", "french", "german", "turkish", "russian"),
    ("immigrants", "refugees", "natives", "foreigners"), ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden"), ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos"),
)
# Neutral sentences; {} is an identity term of each kind.
NEUTRAL = (
    "the {} teacher talked about the new school", "many {} people live in this city", "we met {} neighbours at the market today",
    "the report counts {} voters in each region", "a {} writer won the prize this year",
)
AFFIXES = (("start", 4), ("start", 5), ("start", 6), ("end", 4), ("end", 5))  # bytes
LEAST_ROWS = 3  # toxic sample rows that a feature must occur in
LEAST_GAIN = 5.0  # log likelihood ratio that a kept feature must reach, beyond what chance gives among the features
FAIRNESS, DECAY = 1.0, 1e-5
THRESHOLD = 0.5
SLICE_BYTES = 1 << 20
_TERM = {t: kind for kind in IDENTITY_TERMS for t in kind}
_TERM_PATTERN = re.compile(r"\b(" + "|".join(sorted(_TERM, key=lambda t: (-len(t), t))) + r")\b", re.IGNORECASE)


def features(column):
    """(index of the first text, text number of each feature, feature) of slices; features may repeat."""
    for at, data, offsets in W.slices(column, SLICE_BYTES):
        starts, ends, _, first = W.runs(data, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        if not len(starts):
            continue
        parts, owners = [W.hashes(data, starts, ends)], [text]
        for number, (side, size) in enumerate(AFFIXES, 1):
            longer = ends - starts > size
            s, e = starts[longer], ends[longer]
            if len(s):
                h = W.hashes(data, s, s + size) if side == "start" else W.hashes(data, e - size, e)
                parts.append(h ^ np.uint64(0x9E3779B97F4A7C15 * number % 2**64))
                owners.append(text[longer])
        yield at, np.concatenate(owners), np.concatenate(parts)


class Lookup:
    """Index of known features, found in two array reads per feature."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.known >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, index of the feature)."""
        some = self.maybe[(feature >> np.uint64(64 - self.BITS)).astype(np.int64)]
        owner, feature = owner[some], feature[some]
        if not len(self.known) or not len(feature):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        hit = self.known[at] == feature
        pair = np.unique(owner[hit].astype(np.int64) * len(self.known) + at[hit])
        return pair // len(self.known), pair % len(self.known)


def swapped(text: str) -> str | None:
    """The text with each identity term replaced by the next of its kind; None without any."""
    new, n = _TERM_PATTERN.subn(lambda m: (k := _TERM[m[0].lower()])[(k.index(m[0].lower()) + 1) % len(k)], text)
    return new if n else None


def _rows(lookup: Lookup, texts: list[str]) -> list[np.ndarray]:
    out = [np.zeros(0, np.int64)] * len(texts)
    for at, owner, feature in features(pa.array(texts, pa.string())):
        text, index = lookup.find(owner, feature)
        for i in np.unique(text):
            out[at + i] = index[text == i]
    return out


def _lists(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The lists of a column, without copies."""
    out = []
    for chunk in column.chunks:
        values, at, some = chunk.values.to_numpy(), chunk.offsets.to_numpy(), chunk.is_valid().to_numpy(zero_copy_only=False)
        out += [values[a:b] if valid else None for a, b, valid in zip(at[:-1], at[1:], some)]
    return out


@dataclass
class Model:
    known: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def fit_weights(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on weighted log loss + FAIRNESS * mean squared change of the logit over pairs + DECAY * squares."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(size), 0.0 if len(y) == 0 else float(np.log(99) * (2 * y[0] - 1))
    owner, feature = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows, dtype=np.int32)
    change_owner = np.repeat(np.arange(2 * len(pairs), dtype=np.int32), [len(r) for p in pairs for r in p]) // 2 if pairs else np.zeros(0, np.int64)
    change_feature = np.concatenate([r for p in pairs for r in p], dtype=np.int32) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.full(len(r), s, np.int8) for p in pairs for r, s in zip(p, (1, -1))]) if pairs else np.zeros(0)
    w, m, v, total = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), weight.sum()
    w[size] = np.log((weight * y).sum() / (weight * (1 - y)).sum())
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[feature], len(rows)) + w[size]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        grad = np.append(np.bincount(feature, error[owner], size) + 2 * DECAY * w[:size], error.sum())
        if pairs:
            moved = np.bincount(change_owner, sign * w[change_feature], len(pairs))
            grad[:size] += 2 * FAIRNESS / len(pairs) * np.bincount(change_feature, sign * moved[change_owner], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, others): sample rows of each class with a feature."""

    def count(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for at, owner, feature in features(batch.column(0)):
                order = np.lexsort((feature, owner))
                owner, feature = owner[order], feature[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
                owner, feature = owner[new], feature[new]
                found, index = np.unique(feature, return_inverse=True)
                toxic = labels[at + owner] == 1
                n = [np.bincount(index[of], minlength=len(found)).astype(np.int64) for of in (toxic, ~toxic)]
                yield pa.record_batch([pa.array(found.view(np.int64)), *map(pa.array, n)], names=["feature", "toxic", "others"])

    found = sample.mapInArrow(count, "feature long, toxic long, others long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))


def telling(sample: DataFrame, n: dict[int, int]) -> np.ndarray:
    """All features that tell toxic rows from the others by a likelihood ratio, sorted; n: rows of each label."""
    a, b = (F.col("toxic") + 0.5) / (n[1] + 1), (F.col("others") + 0.5) / (n[0] + 1)
    none = F.greatest(n[1] - F.col("toxic"), F.lit(0)) * F.log(F.greatest(1 - a, F.lit(1e-9)) / F.greatest(1 - b, F.lit(1e-9)))
    found = _counts(sample).where((F.col("toxic") >= LEAST_ROWS) & (a > b) & (F.col("toxic") * F.log(a / b) + none >= LEAST_GAIN))
    return np.sort(found.select("feature").toPandas()["feature"].to_numpy(np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fitted on up to per_class labelled rows of each class.

    Of all features in LEAST_ROWS toxic rows those are kept that tell the classes apart by a likelihood ratio of at
    least LEAST_GAIN. The counts stay in Spark; the driver gets the kept features and which of them each row of the
    sample has. Both are bounded by the sample.
    """
    sample, stands_for = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    n = dict(sample.groupBy("label").count().collect())
    if len(n) < 2:
        return Model(np.zeros(0, np.uint64), *fit_weights([np.zeros(0, np.int64)] * len(n), np.array(list(n), float), np.ones(len(n)), [], 0))
    known = telling(sample, n)

    def present(batches):
        lookup = Lookup(known)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [swapped(t) for t in texts]
            own, changed = _rows(lookup, texts), _rows(lookup, [o or "" for o in other])
            lists = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(1), pa.array(own, lists), pa.array([c if o else None for o, c in zip(other, changed)], lists)], names=["label", "own", "changed"])

    rows = sample.mapInArrow(present, "label int, own array<int>, changed array<int>").toArrow().combine_chunks()
    own, changed, y = _lists(rows["own"]), _lists(rows["changed"]), rows["label"].to_numpy()
    order = sorted(range(len(own)), key=lambda i: (y[i], own[i].astype(">i4").tobytes()))  # as the numbers are ordered
    pairs = [(own[i], changed[i]) for i in order if changed[i] is not None]
    own, y = [own[i] for i in order], y.astype(np.float64)[order]
    lookup = Lookup(known)
    neutral = [[s.format(t) for t in kind] for kind in IDENTITY_TERMS for s in NEUTRAL]
    encoded = [_rows(lookup, group) for group in neutral]
    pairs += [(a, b) for group in encoded for a, b in zip(group, group[1:] + group[:1])]
    own += [r for group in encoded for r in group]
    weight = np.append([stands_for[int(v)] for v in y], np.ones(len(own) - len(y)))
    y = np.append(y, np.zeros(len(own) - len(y)))
    return Model(known, *fit_weights(own, y, weight, pairs, len(known)))


def scores(column, known: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    lookup, z = Lookup(known), np.full(len(column), bias)
    for at, owner, feature in features(column):
        text, index = lookup.find(owner, feature)
        if len(text):
            part = np.bincount(text, weights[index])
            z[at : at + len(part)] += part
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with the probability of class 1; a column of that name is replaced.

    Null and empty texts have the score of a text without features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(pa.array(texts, pa.string()), **shared.value))

    return docs.withColumn(score_col, scored(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of all rows by a model of their own corpus; repeated rows stay."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    found = score(rows, fit(docs, labels, id_col=id_col, text_col=text_col), text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
