"""SimHash near-dedup, components, decontamination, fingerprints."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gavel.llm import components, decontamination, fingerprints, simhash_dedup
from pyspark.sql import functions as F
from tests.llm.data import LONG, PASSAGE, awkward, empty, same_rows, shingles, words


def fingerprint_by_rule(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(re.findall(r"[^\x20\x09-\x0D]+", folded), 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_fingerprints_by_rule(monkeypatch, piece):
    monkeypatch.setattr(simhash_dedup, "PIECE_BYTES", piece)
    for text in ("", " \t", "One", "one TWO", "a b c", "a a a a a", "É é\x0bx\x1cy z w q", LONG[:5000]):
        assert simhash_dedup.fingerprint(text.encode()) == fingerprint_by_rule(text), text[:40]


@pytest.mark.parametrize("pairs, rounds", [([], 0), ([(1, 2), (3, 1), (1, 1), (2, 1), (7, 9)], 0), ([(1, 3), (2, 3)], 1), ([(1, 2), (2, 3)], 1)])
def test_components_run_no_round_that_changes_nothing(spark, rows, monkeypatch, pairs, rounds):
    cuts, cut = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: (cuts.append(1), cut(df))[1])
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    root = {frozenset(): [], frozenset({1, 2, 3, 7, 9}): [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]}
    assert rows(found) == root.get(frozenset(x for p in pairs for x in p), [(1, 1), (2, 1), (3, 1)])
    assert len(cuts) == 1 + rounds


def linked_components(fps, radius):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(a)] = find(b)
    sets = {}
    for f in fps:
        sets.setdefault(find(f), set()).add(f)
    return {frozenset(s) for s in sets.values()}


@pytest.mark.parametrize("radius, list_rows", [(3, 4096), (3, 8), (0, 8), (1, 4096), (4, 16)])
def test_components_of_fingerprints_by_brute_force(spark, radius, list_rows):
    rng = random.Random(radius)
    fps = [0, 2**64 - 1]
    for _ in range(20):
        f = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 12))):
            fps.append(f)
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "id long, fp long")
    found = {}
    for r in simhash_dedup.groups(rows, ["id"], radius, list_rows).collect():
        found.setdefault(r.first.id, set()).add(r.fp % 2**64)
    assert {frozenset(s) for s in found.values()} == linked_components(fps, radius)
    assert all(min(i for i, f in enumerate(fps) if f in s) == first for first, s in found.items())


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 299), (299, 300)]
    random.Random(5).shuffle(links)
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_rows(spark):
    docs = awkward(spark)
    found = simhash_dedup.simhash_components(docs)
    assert found.count() == docs.count()
    by_id = {r.doc_id: r.component_id for r in found.collect()}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3 and by_id[6] == 6
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 6, 7, 8, 9] and ids.count(None) == 1
    assert simhash_dedup.simhash_components(empty(spark)).count() == 0 and simhash_dedup.drop_near_copies(empty(spark)).count() == 0


def leaks_by_brute_force(docs, items, similarity=0.8):
    out = set()
    named = {}
    for i, t in items:
        if words(t):
            known = named.setdefault(tuple(words(t)), i)
            named[tuple(words(t))] = i if known is None else known if i is None else min(i, known)
    for doc, text in docs:
        w = words(text)
        for item, name in named.items():
            target = Counter(shingles(list(item), 5))
            for a in range(len(w) - len(item) + 1):
                own = Counter(shingles(w[a : a + len(item)], 5))
                both = sum((own & target).values())
                if both / (sum(own.values()) + sum(target.values()) - both) >= similarity:
                    out.add((doc, name))
    return out


def leak_tables():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 8, 20, 40))))) for i in range(12)]
    items += [(50, PASSAGE), (51, PASSAGE.upper()), (52, None), (53, ""), (None, "null item words that nobody has at all")]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        passage = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(3)):  # edits
            if passage:
                passage[rng.choice((0, len(passage) - 1, rng.randrange(len(passage))))] = rng.choice(vocabulary)
        docs.append((i, " ".join(text + passage + text[:5])))
    return docs + [(100, None), (101, ""), (102, f"{PASSAGE}. {PASSAGE}"), (102, f"{PASSAGE}. {PASSAGE}")], items


def test_leaks_by_brute_force(spark, monkeypatch):
    docs, items = leak_tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = leaks_by_brute_force(docs, items)
    assert len(expected) > 20
    found = decontamination.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert sum(r.doc_id == 102 and r.item_id == 50 for r in found) == 2  # repeated rows stay
    clean = {r.doc_id for r in decontamination.drop_leaks(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in expected}
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)  # the other join
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, b).collect()} == expected


def test_leaks_at_text_edges_and_of_moved_words(spark):
    item = [f"i{k}" for k in range(60)]
    other = [f"o{k}" for k in range(80)]
    docs = [
        (1, item[2:] + other), (2, other + item[:-2]), (3, item[30:] + item[:30]), (4, item[:-1]), (5, other + item[31:] + item[:29] + other),
        (6, item[:40] + other), (7, item[:20]), (8, item[:1]), (9, other[:5] + item[:20] + ["new"] + item[20:] + other),
    ]
    items = [(1, " ".join(item)), (2, "i0 i1 i2"), (3, "i58 i59 o0 o1")]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    found = decontamination.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    target = Counter(shingles(item, 5))
    expected = {}
    for i, w in docs:
        for a in range(max(1, len(w) - 59)):
            own = Counter(shingles(w[a : a + 60], 5))
            both = sum((own & target).values())
            expected[i] = max(expected.get(i, 0), both / (sum(own.values()) + sum(target.values()) - both))
    assert {1, 2, 3, 4, 5, 9} == {i for i, s in expected.items() if s >= 0.8}
    assert {r.doc_id: r.similarity for r in found.where("item_id = 1").collect()} == {i: s for i, s in expected.items() if s >= 0.8}
    assert {(r.doc_id, r.item_id) for r in found.where("item_id > 1").collect()} == {(i, n) for i, w in docs for n, t in items[1:] if f" {t} " in f" {' '.join(w)} "}


def test_items_that_share_an_id_or_have_none(spark):
    wordings = {name: " ".join(f"{name}{k}" for k in range(n)) for name, n in (("a", 20), ("b", 20), ("c", 12), ("d", 12), ("e", 9))}
    items = [(None, wordings["a"]), (None, wordings["b"]), (7, wordings["c"]), (7, wordings["d"]), (7, wordings["e"])]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(wordings.values())] + [(9, wordings["c"] + " " + wordings["d"])], "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in decontamination.leaks(docs, items).collect()]
    assert sorted(found, key=str) == [(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0), (4, 7, 1.0), (9, 7, 1.0)]
    assert decontamination.drop_leaks(docs, items).count() == 0


def test_leak_rows(spark):
    docs, items = awkward(spark), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.leaks(docs, items).collect()] == [8]
    assert same_rows(decontamination.drop_leaks(docs, items), docs.where("not (doc_id <=> 8)"))
    assert same_rows(decontamination.drop_leaks(docs, items.limit(0)), docs)
    assert decontamination.drop_leaks(empty(spark), items).count() == 0


@pytest.mark.parametrize("bucket_rows", [1, 3, 2000])
def test_edited_pairs_by_hand(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (bucket_rows,))
    rng = random.Random(4)
    docs = [(i * i - 50, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(30))) + "é𝄞") for i in range(20)] + [(400, "x"), (400, None)]
    frame = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string")
    ordered = sorted((i, t or "") for i, t in docs)
    expected = []
    for k, (i, t) in enumerate(ordered):
        half, after = len(t) // 2, ordered[(k + 1) % len(ordered)][1]
        expected.append((i, len(t), t[: len(t) - half] + after[:half]))
    found = fingerprints.edited_pairs(frame).select("doc_id", "n_chars", "edited").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_sketches_estimate_sets(spark):
    a, b = [f"s{i}" for i in range(3000)], [f"s{i}" for i in range(1000, 4000)]
    rows = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:40]), "")], "a string, b string, few string, none string")
    s = {c: fingerprints.sketch(F.col(c), 1024) for c in rows.columns}
    rows = rows.select(*[v.alias(c) for c, v in s.items()])
    r = rows.select(
        fingerprints.resemblance(F.col("a"), F.col("b"), 1024).alias("near"), fingerprints.containment(F.col("few"), F.col("a"), 1024).alias("inside"),
        fingerprints.distinct_shingles(F.col("a"), 1024).alias("n"), fingerprints.distinct_shingles(F.col("few"), 1024).alias("n_few"),
        fingerprints.resemblance(F.col("none"), F.col("none")).alias("empty"), fingerprints.resemblance(F.col("none"), F.col("a")).alias("half_empty"),
    ).first()
    assert abs(r.near - 0.5) < 0.06 and r.inside > 0.9 and abs(r.n / 2996 - 1) < 0.1 and r.n_few == 36 and r.empty == 1 and r.half_empty == 0


def test_parts_merge_to_the_whole(spark):
    parts = spark.createDataFrame([(g, i, " ".join(f"p{g}x{i}y{j}" for j in range(80))) for g in range(2) for i in range(5)], "g int, i int, text string")
    parts = parts.withColumn("sketch", fingerprints.sketch(F.col("text"), 32))
    merged = {r.g: r.sketch for r in fingerprints.merge_groups(parts, ["g"], k=32, salts=4).collect()}
    for g in range(2):
        hashes = sorted({h for r in parts.where(f"g = {g}").select(fingerprints.sketch(F.col("text"), 10**6).alias("s")).collect() for h in r.s})
        assert merged[g] == hashes[:32]


def test_fingerprint_rows(spark):
    docs = awkward(spark)
    found = fingerprints.edited_pairs(docs)
    assert found.count() == docs.count()
    assert fingerprints.edited_pairs(empty(spark)).count() == 0
    same = {tuple(r.sketch) for r in found.where("doc_id in (1, 2)").collect()}
    assert len(same) == 1
