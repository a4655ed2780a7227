"""Quality and toxicity classifiers."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gavel.llm import labelled, quality, toxicity
from gavel.llm import words as W
from tests.llm.data import awkward, empty


def corpus(n=400, seed=1):
    """(doc_id, text, quality, toxic): one text in four is shouted, one in five insults."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 80))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        if toxic:
            text.insert(rng.randrange(30), rng.choice(("grumblo", "grumbly", "zwackel")))
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in text), int(not bad), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def held_out_accuracy(found, truth):
    rows = [r for r in found.collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == truth[r.doc_id] for r in rows])


def test_quality_on_held_out_rows(spark):
    rows = corpus()
    found = quality.classify(*tables(spark, rows))
    assert held_out_accuracy(found, {r[0]: r[2] for r in rows}) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(seed=2)
    found = toxicity.classify(*tables(spark, rows))
    assert held_out_accuracy(found, {r[0]: r[3] for r in rows}) > 0.95


def test_all_telling_features_are_kept(spark):
    """2,100 rare insults, each in 3 toxic rows only."""
    insults = [f"q{i}x" for i in range(2100)]
    texts = [(" ".join([*insults[k // 3 * 30 : k // 3 * 30 + 30], "plain", f"w{k % 50}"]), 1) for k in range(210)]
    texts += [(f"plain w{k % 50} words", 0) for k in range(840)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, texts)], "doc_id long, toxic int")
    known = set(toxicity.fit(docs, labels).known.tolist())
    assert {W.hash_of(w) for w in insults} <= known
    assert W.hash_of("plain") not in known and W.hash_of("w7") not in known


def test_held_out_labels_are_never_used(spark):
    rows = corpus(200)
    docs, labels = tables(spark, rows)
    turned = [(r[0], r[1], 1 - r[2], 1 - r[3]) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r for r in rows]
    for op in (quality, toxicity):
        a = {r.doc_id: r.score for r in op.classify(docs, labels).collect()}
        assert a == {r.doc_id: r.score for r in op.classify(docs, tables(spark, turned)[1]).collect()}


def test_word_sums_by_brute_force(spark):
    texts = ["a b a a C", "", None, "THE ## 12 é", "x " * 50]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sums, n = np.zeros((quality.SIZE, quality.DIMENSIONS), int), np.zeros(quality.SIZE, int)
    for t in texts:
        for _, data, offsets in W.slices(pa.array([t], pa.string())):
            ids, _ = quality.numbered(data, offsets)
        for i in range(len(ids)):
            n[ids[i]] += 1
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                for k in range(quality.NONZERO) if i != j else ():
                    sums[ids[i], quality.PLACES[ids[j], k]] += quality.SIGNS[ids[j], k]
    found = quality.word_sums(docs).toPandas().sort_values("number")
    assert found["number"].tolist() == np.flatnonzero(n).tolist() and found["n"].tolist() == n[n > 0].tolist()
    assert (found[[f"v{i}" for i in range(quality.DIMENSIONS)]].to_numpy() == sums[n > 0]).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit_network(x, y, np.ones(4000))
    z, w = net.logits(x), np.ones(4000)
    assert quality._loss(z / net.temperature, y, w) <= quality._loss(z, y, w) + 0.01
    p = net.scores(x)
    assert abs(p.mean() - y.mean()) < 0.03 and abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.05


def test_swaps_stay_within_their_kind():
    assert toxicity.swapped("Women and men, she said") == "men and girls, he said"
    assert toxicity.swapped("no such term, womanly") is None


def test_penalty_keeps_identity_terms_neutral():
    # feature 0: an insult; 1 and 2: identity terms, the first mostly in toxic rows
    rows = [np.array(r) for r in [[0, 1]] * 40 + [[0]] * 10 + [[1]] * 5 + [[2]] * 60 + [[]] * 60]
    rows = [r.astype(int) for r in rows]
    y = np.array([1.0] * 50 + [0.0] * 125)
    pairs = [(np.array([1]), np.array([2])), (np.array([0, 1]), np.array([0, 2]))]
    free, _ = toxicity.fit_weights(rows, y, np.ones(len(y)), [], 3)
    fair, bias = toxicity.fit_weights(rows, y, np.ones(len(y)), pairs, 3)
    assert abs(fair[1] - fair[2]) < 0.25 * abs(free[1] - free[2])
    assert bias + fair[0] > 0 > bias + fair[1]


def test_features_find_beginnings():
    known = toxicity.Lookup(np.array([h for _, _, f in toxicity.features(pa.array(["lostrand"])) for h in f], np.uint64))
    for _, owner, f in toxicity.features(pa.array(["lostring", "other", "", None, "LOSTRAND"])):
        text, _ = known.find(owner, f)
        assert np.bincount(text, minlength=5).tolist() == [2, 0, 0, 0, 6]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_awkward_rows(spark, op):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (6, 0, 0), (7, None, None), (None, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    found = op.classify(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert op.classify(docs, labels.limit(0)).count() == docs.count()
    assert op.classify(empty(spark), labels).count() == 0


def test_keep_good_keeps_columns(spark):
    docs = awkward(spark)
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_sample_is_bounded(spark):
    docs, labels = tables(spark, corpus(100))
    sample, stands_for = labelled.labelled_sample(docs, labels, "toxic", per_class=5)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 5, 1: 5}
    assert stands_for[0] > stands_for[1] > 1
