"""Near copies by five-word shingles against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from gavel.llm import near_copies
from tests.llm.data import awkward, empty

BIG = "/root/testdata/sf0.1"


def word_sets(texts):
    out = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def similar_pairs(sets):
    """All pairs of texts with words, by the rare shingles that two of them must share."""
    often, places, found = Counter(s for x in sets for s in x), defaultdict(list), []
    for i, x in enumerate(sets):
        rare = sorted(x, key=lambda s: (often[s], s))[: len(x) - math.ceil(0.8 * len(x) - 1e-9) + 1]
        found += [(j, i) for j in {j for s in rare for j in places[s]} if similar(sets[j], x)]
        for s in rare:
            places[s].append(i)
    return found


def components(n, pairs):
    of = list(range(n))
    for a, b in pairs:
        a, b = of[a], of[b]
        if a != b:
            of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def kept_by_brute_force(rows):
    """Ids that stay of (id, text) with ids."""
    sets = word_sets([t for _, t in rows])
    of = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    return sorted(min(rows[i][0] for i in range(len(rows)) if of[i] == k) for k in set(of))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("most", [2, 10, 5000])
def test_kept_rows_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "LIST_ROWS", most)
    monkeypatch.setattr(near_copies, "PART_ROWS", most)
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 5, 60, 200)))]
        rows += [" ".join(edited(rng, base, rng.randrange(3)) if len(base) > 50 else base) for _ in range(rng.randrange(1, 7))]
    rows = [(i, t.upper() if i % 5 == 0 else t.replace(" ", "  ")) for i, t in enumerate(rows)] + [(1000, ""), (1001, None), (1002, " \n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.drop_near_texts(docs).collect()) == kept_by_brute_force(rows)


def test_shingles_of_pieces(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(300)) + "　é A\x0bB"
    whole = near_copies.word_shingles(text)
    monkeypatch.setattr("gavel.llm.simhash_dedup.PIECE_BYTES", 16)
    again = near_copies.word_shingles(text)
    assert whole[0] == again[0] and whole[1].tolist() == again[1].tolist() and len(whole[1]) == len(text.split(" ")) + 1 - 4
    assert [len(near_copies.word_shingles(t)[1]) for t in ("", "  ", "a", "a b c d", "a b c d e", "a b c d e f")] == [0, 0, 1, 1, 1, 2]


def test_position_pairs_are_spread_evenly():
    pairs = near_copies.position_pairs()
    often = Counter(p for x in pairs for p in x)
    assert len(set(map(frozenset, pairs))) == near_copies.SETS and len(often) == 32 and set(often.values()) == {4}


def test_alike_counts_bytes_and_bits():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, (5, near_copies.LANES), dtype=np.uint64)
    flips = rng.random((40, near_copies.LANES, 64)) < 0.2
    many = np.array([one[i % 5] ^ np.packbits(f, axis=1, bitorder="little").view(np.uint64)[:, 0] for i, f in enumerate(flips)])
    want = [any((x.view(np.uint8) == y.view(np.uint8)).sum() >= near_copies.BYTES and sum(int(v).bit_count() for v in x ^ y) <= near_copies.BITS for x in one) for y in many]
    assert near_copies.alike(one, many).tolist() == want and 0 < sum(want) < 40


def test_lists_of_one_group_name_few_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, near_copies.LANES, dtype=np.uint64)
    fps = base ^ np.where(rng.random((40, near_copies.LANES)) < 0.5, np.uint64(1) << rng.integers(0, 8, (40, near_copies.LANES)).astype(np.uint64), np.uint64(0))
    one = np.arange(40)
    group, ids = np.repeat(np.arange(5), 40), np.tile(one, 5)  # five lists with the same near copies
    for short in (64, 8):
        links = np.concatenate([np.stack(x, axis=1) for x in near_copies._list_links(group, ids, np.tile(fps, (5, 1)), short)])
        assert {tuple(x) for x in links.tolist()} == {(0, i) for i in range(1, 40)} and len(links) == 5 * 39
    for n, p in ((30, 0.02), (30, 0.06), (50, 0.03)):
        a, b = np.nonzero(np.triu(rng.random((n, n)) < p, 1))
        of = components(n, list(zip(a.tolist(), b.tolist())))
        assert near_copies.stars(n, a, b).tolist() == [min(j for j in range(n) if of[j] == of[i]) for i in range(n)]


def test_many_links_to_few_small_nodes_become_one_link_a_node(spark, monkeypatch):
    from gavel.llm import components as stars_

    links = spark.range(4000).selectExpr("id % 10 AS a", "10 + id div 10 AS b").unionByName(spark.createDataFrame([(900, 901), (902, 901)], "a long, b long"))
    sizes, inner = [], stars_._large_star
    monkeypatch.setattr(stars_, "_large_star", lambda x: (sizes.append(x.count()), inner(x))[1])
    got = {r.node: r.root for r in stars_.components(links).collect()}
    assert got == {i: 0 for i in range(410)} | {i: 900 for i in (900, 901, 902)}
    assert max(sizes) <= 413


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = near_copies.drop_near_texts(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "7", "8", "9", "None"])
    assert near_copies.drop_near_texts(empty(spark)).collect() == []


def test_recall_on_the_given_documents(spark):
    texts = sorted({t for t in pq.read_table(f"{BIG}/documents.parquet", columns=["text"])["text"].to_pylist() if t})
    pairs = similar_pairs(word_sets(texts))
    rows, first = near_copies.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    group = {r.id: r.first.id for r in rows.join(first, "words").select("id", "first").collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) >= 40 and found >= 0.9 * len(pairs)
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    of = components(len(texts), pairs)
    assert all(len({of[i] for i in m}) == 1 for m in members.values() if len(m) > 1)  # nothing else is grouped
