"""Mixing by brute force, and the pipeline stage by stage."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
from gavel.llm import mixing
from gavel.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS
from gavel.session import cut_lineage
from pyspark.sql import functions as F
from tests.llm.data import awkward, empty
from tests.llm.test_copies import leaks_by_brute_force
from tests.llm.test_near_copies import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def shares(children, budget):
    """Brute force: hand out by weight, take back what is over capacity, again and again; children: name -> (weight, capacity)."""
    budget, full = min(budget, sum(c for _, c in children.values())), {}
    while True:
        rest, weight = budget - sum(full.values()), sum(w for n, (w, _) in children.items() if n not in full)
        over = {n: c for n, (w, c) in children.items() if n not in full and c * weight <= rest * w}
        if not over:
            break
        full |= over
    out = full | {n: rest * w // weight for n, (w, _) in children.items() if n not in full}
    lost = budget - sum(out.values())
    for n in sorted(set(children) - set(full))[:lost]:
        out[n] += 1
    return out


def copies_by_brute_force(docs, weights, share, epochs, seed):
    """docs: (id, domain, lang, source, tokens); epochs of each row, by position."""
    leaves = Counter()
    for _, *leaf, n in docs:
        leaves[tuple(leaf)] += n

    def below(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        named = {leaf[depth] for leaf in leaves if leaf[:depth] == prefix}
        of = weights.get(mixing.LEVELS[depth], {})
        children = {n: (of.get(n, 1), epochs * sum(t for leaf, t in leaves.items() if leaf[: depth + 1] == (*prefix, n))) for n in named}
        out = {}
        for n, b in shares(children, budget).items():
            out |= below((*prefix, n), b)
        return out

    budgets = below((), int(sum(leaves.values()) * Fraction(str(share))))
    result = [0] * len(docs)
    for leaf, total in leaves.items():
        own = [i for i, d in enumerate(docs) if tuple(d[1:4]) == leaf]
        whole, part = (budgets[leaf] // total, budgets[leaf] % total) if total else (0, 0)
        key = lambda i: hashlib.md5(f"{seed}:{whole}:{docs[i][0]}".encode()).hexdigest()
        for i in own:
            upto = sum(docs[j][4] for j in own if key(j) <= key(i))
            result[i] = whole + (part > 0 and upto <= part)
    return result


def test_mix_by_brute_force(spark):
    rng = random.Random(6)
    for trial in range(3):
        docs = [(rng.randrange(80), f"d{rng.choice('aab')}", rng.choice("xyz"), rng.choice("pqqqqq"), rng.choice((0, 1, 5, 200))) for _ in range(120)]
        weights = {"domain": {"da": 5}, "lang": {"x": 3, "z": 2}}
        frame = spark.createDataFrame([(i, a, b, c, " ".join(["w"] * n), k) for k, (i, a, b, c, n) in enumerate(docs)], "doc_id long, d string, lang string, source string, text string, k int")
        levels = {"domain": F.col("d"), "lang": F.col("lang"), "source": F.col("source")}
        share, epochs = rng.choice(((0.5, 1), (0.9, 2), (1.7, 3), (5.0, 2)))
        found = {r.k: r._llm_copies for r in mixing.mix(frame, weights, share, epochs, trial, levels).collect()}
        expected = copies_by_brute_force(docs, weights, share, epochs, trial)
        assert found == {k: c for k, c in enumerate(expected) if c}


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 2000)], "domain string, lang string, source string, tokens long")
    found = {tuple(r[:3]): r.budget for r in mixing.leaf_budgets(leaves, {}, 1000 / 4010, 1).collect()}
    # the short source's share goes to its sibling source; neither the other language nor the other domain gets more
    assert found == {("a", "x", "1"): 10, ("a", "x", "2"): 240, ("a", "y", "1"): 250, ("b", "x", "1"): 500}


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    whole = mixing.mixed_documents(docs, {}, 5.0, epochs=2)
    assert whole.columns == docs.columns
    with_tokens = docs.where(F.regexp_count("text", F.lit(r"\S")) > 0)
    assert whole.where(F.regexp_count("text", F.lit(r"\S")) > 0).count() == 2 * with_tokens.count()
    assert mixing.mix(empty(spark), {}, 0.5).count() == 0


def test_mix_runs_few_jobs(spark):
    """The driver keeps threads of each shuffle and broadcast for a while, so many short jobs cost it memory."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mix", "")
    mixing.mixed_documents(docs, MIX_WEIGHTS, MIX_SHARE, epochs=MIX_EPOCHS)
    jobs = len(tracker.getJobIdsForGroup("mix"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs <= 36, jobs


def test_stages_by_brute_force(spark):
    """Each stage on what the one before it kept; the quality stage is checked against its labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, docs, SF))
        kept[name] = [r.doc_id for r in docs.collect()]
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(labels.get(i, 1) == 1 for i in kept[name])
            good = {i for i, y in labels.items() if y == 1}
            assert len(good - set(kept[name])) <= 0.02 * len(good)
        elif name == "near_dedup":
            want = kept_by_brute_force([r[:2] for r in rows])
            assert set(want) <= set(kept[name]) and len(kept[name]) - len(want) <= 0.1 * (len(rows) - len(want))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, _ in leaks_by_brute_force([r[:2] for r in rows], items)}
            assert sorted(kept[name]) == sorted(i for i, *_ in rows if i not in bad)
        elif name == "mixing":
            plain = [(i, f"domain{int(re.search(r'[0-9]+', s)[0]) % 4}", g, s, len(t.split())) for i, t, g, s in rows]
            copies = copies_by_brute_force(plain, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, 42)
            assert Counter(kept[name]) == Counter({r[0]: c for r, c in zip(rows, copies) if c})
        else:
            assert sorted(kept[name]) == sorted(kept["mixing"])
        assert docs.columns == columns + (["slot", "shard"] if name == "sharding" else [])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept["sharding"])
