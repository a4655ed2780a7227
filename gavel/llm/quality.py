"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words (and runs of symbols) are numbered by a hash within their shape: repeats of the word before, all capitals,
digits, symbols, other words. Every number has a sparse random index vector; a word's vector is the sum of the index
vectors of its neighbours over the whole corpus, so words used alike have like vectors. The sums are integers and
the table has a fixed size. A document is the mean of its words' vectors, plain and with frequent words damped. A
network of two layers, fitted in numpy on a bounded sample of labelled rows, scores it; a temperature fitted on rows
set aside calibrates its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import words as W
from gavel.llm.labelled import PER_CLASS, held_out, labelled_sample

SHAPES = (("repeat", 64), ("capitals", 256), ("digits", 64), ("symbols", 256), ("word", 15_744))  # numbers by shape
SIZE = sum(n for _, n in SHAPES)
DIMENSIONS = 48
NONZERO = 4
REACH = 2  # neighbours to either side
DAMP = 1e-3
HIDDEN = 16
THRESHOLD = 0.3
SLICE_BYTES = 1 << 20
_RANDOM = np.random.default_rng(11)
PLACES = _RANDOM.integers(0, DIMENSIONS, (SIZE, NONZERO))
SIGNS = _RANDOM.choice(np.array([-1, 1]), (SIZE, NONZERO))


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of a slice, and each text's first word (one more at the end)."""
    starts, ends, kind, first = W.runs(data, offsets, symbols=True)
    if not len(starts):
        return np.zeros(0, np.int64), first
    found = W.hashes(data, starts, ends)
    length = ends - starts
    count = lambda low, high: np.add.reduceat(((data >= low) & (data <= high)).astype(np.int32), starts) if len(data) else None
    # from a start to the next start there are only this word's bytes and bytes of no word
    capital, digit = count(0x41, 0x5A) == length, count(0x30, 0x39) == length
    again = np.zeros(len(starts), bool)
    again[1:] = found[1:] == found[:-1]
    again[first[first < len(starts)]] = False
    shape = np.select([again & (kind == 1), (kind == 1) & capital & (length > 1), (kind == 1) & digit, kind == 2], [0, 1, 2, 3], 4)
    sizes = np.array([n for _, n in SHAPES])
    return (np.cumsum(sizes) - sizes)[shape] + (found % sizes[shape].astype(np.uint64)).astype(np.int64), first


def neighbour_sums(ids: np.ndarray, first: np.ndarray, sums: np.ndarray) -> None:
    """Adds the index vectors of all neighbours to the rows of sums."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    flat = sums.reshape(-1)
    for shift in range(1, REACH + 1):
        same = text[shift:] == text[:-shift]
        a, b = ids[:-shift][same], ids[shift:][same]
        for one, other in ((a, b), (b, a)):
            for j in range(NONZERO):
                cell = one * DIMENSIONS + PLACES[other, j]
                flat += np.bincount(cell, SIGNS[other, j], len(flat)).astype(np.int64)


def word_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(number, n, v0, v1, ...): occurrences and vector sums of all words of all texts; SIZE rows at most."""
    columns = ["number", "n", *[f"v{i}" for i in range(DIMENSIONS)]]

    def count(batches):
        sums, n = np.zeros((SIZE, DIMENSIONS), np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            for _, data, offsets in W.slices(batch.column(0), SLICE_BYTES):
                ids, first = numbered(data, offsets)
                n += np.bincount(ids, minlength=SIZE)
                neighbour_sums(ids, first, sums)
        seen = np.flatnonzero(n)
        yield pa.record_batch([pa.array(x) for x in (seen, n[seen], *sums[seen].T.copy())], names=columns)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, ", ".join(f"{c} long" for c in columns))
    return rows.groupBy("number").agg(*[F.sum(c).alias(c) for c in columns[1:]])


@dataclass
class Vectors:
    plain: np.ndarray
    damped: np.ndarray


def word_vectors(sums: pd.DataFrame) -> Vectors:
    """Unit vectors without their common part, and the same times a weight that falls with frequency."""
    vectors, n = np.zeros((SIZE, DIMENSIONS)), np.zeros(SIZE)
    if len(sums):
        at = sums["number"].to_numpy()
        vectors[at], n[at] = sums[[f"v{i}" for i in range(DIMENSIONS)]].to_numpy(), sums["n"].to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = n / max(n.sum(), 1)
    vectors -= share @ vectors
    return Vectors(vectors.astype(np.float32), (vectors * (DAMP / (DAMP + share))[:, None]).astype(np.float32))


def pooled(column, vectors: Vectors) -> np.ndarray:
    """A row of 2 * DIMENSIONS for each text; zeros for texts without words."""
    out = []
    table = np.hstack([vectors.plain, vectors.damped])
    for _, data, offsets in W.slices(column, SLICE_BYTES):
        ids, first = numbered(data, offsets)
        n = np.diff(first)
        part = np.zeros((len(n), table.shape[1]), np.float32)
        for a in range(0, len(n)):
            for b in range(first[a], first[a + 1], 1 << 16):  # long texts piece by piece
                part[a] += table[ids[b : min(b + (1 << 16), first[a + 1])]].sum(axis=0)
        out.append(part / np.maximum(n, 1)[:, None])
    return np.vstack(out) if out else np.zeros((0, table.shape[1]), np.float32)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the weighted log loss; every tenth row is set aside for the temperature.

    Without rows of both classes the score is the constant share of class 1 (one half without rows).
    """
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(y) == 0 or y.min() == y.max():
        net.w2[:] = 0
        net.b2 = 0.0 if len(y) == 0 else float(np.log(99) * (2 * y[0] - 1))
        return net
    net.centre, net.scale = x.mean(0), x.std(0) + 1e-6
    order = rng.permutation(len(y))
    aside, used = order[::10], np.delete(order, np.s_[::10])
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(used)
        for a in range(0, len(used), 256):
            i = used[a : a + 256]
            inner = (x[i] - net.centre) / net.scale
            h = np.tanh(inner @ params[0] + params[1])
            z = h @ params[2] + params[3][0]
            g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / weight[i].mean() / len(i)
            gh = g[:, None] * params[2] * (1 - h * h)
            step += 1
            for k, grad in enumerate((inner.T @ gh + decay * params[0], gh.sum(0), h.T @ g + decay * params[2], np.array([g.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    z = net.logits(x[aside])
    net.temperature = float(min(np.geomspace(0.5, 8, 49), key=lambda t: _loss(z / t, y[aside], weight[aside])))
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Word vectors of all texts, and the network of a sample of up to per_class labelled rows of each class.

    To the driver come the word table (SIZE rows) and the pooled sample (2 * per_class rows).
    """
    vectors = word_vectors(word_sums(docs, text_col).toPandas())
    sample, stands_for = labelled_sample(docs, labels, label, per_class, id_col, text_col)

    def pool(batches):
        for batch in batches:
            x = pooled(batch.column(0), vectors)
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], names=["x", "label"])

    rows = sample.mapInArrow(pool, "x array<float>, label int").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, 2 * DIMENSIONS)
    order = np.lexsort((*x.T[:4], rows["label"]))  # the order of rows doesn't matter to the fit
    x, y = x[order], rows["label"].to_numpy(np.float64)[order]
    return Model(vectors, fit_network(x, y, np.array([stands_for[int(v)] for v in y])))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns with the probability of class 1; a column of that name is replaced.

    Null and empty texts have the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vars(model.vectors), vars(model.network)))  # plain arrays

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        vectors, network = Vectors(**shared.value[0]), Network(**shared.value[1])
        return pd.Series(network.scores(pooled(pa.array(texts, pa.string()), vectors)).astype(float))

    return docs.withColumn(score_col, scored(F.col(text_col)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score at least the threshold, by a model of their own corpus, with all columns as they were."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return score(docs, model, text_col, "_llm_score").where(F.col("_llm_score") >= threshold).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of all rows by a model of their own corpus; repeated rows stay."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    found = score(rows, fit(docs, labels, id_col=id_col, text_col=text_col), text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
