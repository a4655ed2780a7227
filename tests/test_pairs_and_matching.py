"""Similarity joins, greedy choices and clusters against brute force."""

import datetime
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavel.functions import greedy, pairs
from gavel.functions.greedy import first_independent, first_matching
from gavel.operators import clusters, dedup, evaluation
from gavel.session import cut_lineage


def sample(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(n // 4, 1), dims))
    return base[rng.integers(0, len(base), n)] + rng.normal(scale=0.5, size=(n, dims))


def cos(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)


def test_similar_pairs_by_vector(spark, rows, small_blocks):
    data = {g: sample(n, 6, n) for g, n in (("a", 23), ("b", 9), ("c", 1))}
    df = spark.createDataFrame(
        [(g, i, [float(x) for x in v]) for g, vs in data.items() for i, v in enumerate(vs)], "g string, idx long, v array<double>"
    )
    want = sorted((g, i, j) for g, vs in data.items() for i in range(len(vs)) for j in range(i + 1, len(vs)) if cos(vs[i], vs[j]) >= 0.8)
    got = pairs.similar_pairs(df, ["g"], "v", 0.8, texts=False)
    assert rows(got, "g", "lo", "hi") == want and want


def test_similar_across_by_text(spark, rows, small_blocks):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    left = [("g", i, word()) for i in range(11)]
    right = [("g", i, word()) for i in range(14)] + [("h", 0, "aaa")]
    kind = "g string, idx long, v string"
    got = pairs.similar_across(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["g"], "v", 0.7, texts=True)
    want = sorted(
        ("g", i, j) for g, i, a in left for h, j, b in right if g == h and SequenceMatcher(None, a, b).ratio() >= 0.7
    )
    assert rows(got, "g", "lo", "hi") == want and want


@pytest.mark.parametrize("symmetric", [True, False])
def test_parts_follow_the_rows_of_a_group_and_not_their_numbers(spark, rows, monkeypatch, symmetric):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    monkeypatch.setattr(pairs, "VECTORS", 1)
    data = {g: sample(n, 6, n) for g, n in ((1, 40), (2, 9), (3, 1))}
    given_ = [(g, 1_000_000_007 * (i + g) % (1 << 40), [float(x) for x in v]) for g, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(given_ + [(1, 5, None), (None, 6, [1.0] * 6), (1, None, [1.0] * 6)], "g int, idx long, v array<double>").repartition(3)
    sent = pairs._dealt(df, None if symmetric else df, ["g"], "v", 8)
    assert sent.count() == (40 * 5 + 9 * 2 + 1) * (1 if symmetric else 2)
    near = lambda x, y: x[0] == y[0] and cos(np.array(x[2]), np.array(y[2])) >= 0.8
    want = sorted((x[0], x[1], y[1]) for x in given_ for y in given_ if (x[1] < y[1] or not symmetric) and near(x, y))
    got = pairs.similar_pairs(df, ["g"], "v", 0.8, False) if symmetric else pairs.similar_across(df, df, ["g"], "v", 0.8, False)
    assert rows(got, "g", "lo", "hi") == want and want


def test_the_earlier_text_comes_first_whatever_part_it_is_in(spark, rows, small_blocks):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    df = spark.createDataFrame([("g", 100 * i, t) for i, t in enumerate(texts)], "g string, idx long, v string")
    ratio = lambda i, j: SequenceMatcher(None, texts[i], texts[j]).ratio()
    want = [("g", 100 * i, 100 * j, ratio(i, j)) for i in range(30) for j in range(i + 1, 30) if ratio(i, j) >= 0.6]
    assert rows(pairs.similar_pairs(df, ["g"], "v", 0.6, texts=True)) == want and want


EDGES = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20)


@settings(max_examples=4, deadline=None)
@given(EDGES)
def test_first_independent_is_the_sequential_rule(spark, edges):
    graph = sorted({(min(a, b), max(a, b)) for a, b in edges if a != b})
    df = spark.createDataFrame([("g", a, b) for a, b in graph], "g string, lo long, hi long")
    taken, owner = set(), {}
    for i in range(10):
        if i in taken:
            continue
        for a, b in graph:
            if a == i and b not in taken:
                taken.add(b)
                owner[b] = i
    for block, walk in ((2048, 1 << 20), (3, 2)):
        got = {r.node: r.seed for r in first_independent(df, ["g"], block, walk).collect()}
        assert got == owner, (block, walk)


@settings(max_examples=4, deadline=None)
@given(EDGES)
def test_first_matching_is_the_sequential_rule(spark, edges):
    graph = sorted(set(edges))
    df = spark.createDataFrame([("g", a, b) for a, b in graph], "g string, left long, right long")
    used, want = set(), set()
    for left in range(10):
        free = [b for a, b in graph if a == left and b not in used]
        if free:
            used.add(free[0])
            want.add((left, free[0]))
    for block, walk in ((1024, 1 << 20), (3, 2)):
        assert {(r.left, r.right) for r in first_matching(df, ["g"], block, walk).collect()} == want, (block, walk)


def test_rounds_do_not_follow_a_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(greedy, "cut_lineage", lambda df: (rounds.append(1), cut_lineage(df))[1])
    n = 5000
    chain = spark.range(n - 1).selectExpr("'g' AS g", "id AS lo", "id + 1 AS hi")
    want = {i: i - 1 for i in range(1, n, 2)}
    assert {r.node: r.seed for r in first_independent(chain, ["g"]).collect()} == want
    assert len(rounds) == 2  # the edges, the large groups: one walk
    rounds.clear()
    assert {r.node: r.seed for r in first_independent(chain, ["g"], walk=1000).collect()} == want
    assert len(rounds) <= 4 + 2 + 3  # edges and units; the numbering, its edges, three blocks


def test_components_are_settled_in_one_pass_and_null_groups_are_groups(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(greedy, "cut_lineage", lambda df: (rounds.append(1), cut_lineage(df))[1])
    pairs_ = spark.range(30_000).selectExpr("if(id < 20000, 'hot', null) AS g", "id * 4 AS lo", "id * 4 + 1 + id % 3 AS hi")
    got = first_independent(pairs_, ["g"], walk=500)
    assert got.count() == 30_000 and got.where("g IS NULL").count() == 10_000 and len(rounds) == 4
    triangle = spark.createDataFrame([(None, 1, 2), (None, 1, 3), (None, 2, 3), (None, 3, 4)], "g string, left long, right long")
    assert sorted((r.left, r.right) for r in first_matching(triangle, ["g"]).collect()) == [(1, 2), (2, 3), (3, 4)]


def test_near_titles_by_brute_force_with_split_lists(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LIST_ROWS", 6)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.choice((1, 2, 5, 8, 9)))] for _ in range(25)]
    titles = [" ".join(rng.sample(b, len(b)) if rng.random() < 0.5 else b[:-1] + [rng.choice(["hot", b[-1]])]) for b in base for _ in range(3)] + ["", " ", None]
    got = [(r.a, r.b, round(r.similarity, 9)) for r in dedup.near_titles(spark.createDataFrame([(t,) for t in titles], "task string").repartition(3)).collect()]
    some = sorted({t.strip() for t in titles if t and t.strip()})
    sets = [set(t.split()) for t in some]
    want = [(x, y, round(len(a & b) / len(a | b), 9)) for i, (x, a) in enumerate(zip(some, sets)) for y, b in zip(some[i + 1 :], sets[i + 1 :]) if len(a & b) >= 0.8 * len(a | b)]
    assert sorted(got) == sorted(want) and len(want) > 10
    pairs_ = spark.range(20_000).selectExpr("concat('common ', id) AS task")  # all share their one frequent word
    assert dedup.near_titles(pairs_).count() == 0


@pytest.mark.parametrize("cells", [1, 1 << 16])
def test_near_titles_of_long_texts_by_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(dedup, "CELLS", cells)  # with one cell words are in any order
    rng = random.Random(11)
    titles = []
    for n in (4, 5, 9, 10, 30, 60, 120, 250, 400):
        base = [f"w{rng.randrange(900)}" for _ in range(n)]
        for change in range(0, n // 5 + 2, max(1, n // 20)):
            some = base[change:] + [f"w{rng.randrange(900)}" for _ in range(change // 2)]
            titles += [" ".join(some), " ".join(rng.sample(some, len(some))), " ".join([*some, some[0]])]
    got = [(r.a, r.b, round(r.similarity, 9)) for r in dedup.near_titles(spark.createDataFrame([(t,) for t in titles * 2], "task string")).collect()]
    some = sorted(set(titles))
    sets = [set(t.split()) for t in some]
    want = [(x, y, round(len(a & b) / len(a | b), 9)) for i, (x, a) in enumerate(zip(some, sets)) for y, b in zip(some[i + 1 :], sets[i + 1 :]) if len(a & b) / len(a | b) >= 0.8]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_near_titles_shuffle_and_store_little_more_than_the_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(1 << 30):x}" if rng.random() < 0.5 else f"often{rng.randrange(40)}" for _ in range(150)) for _ in range(400)]
    texts += [t.rsplit(" ", 1)[0] for t in texts]
    stored = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getPath(): f.length() for f in (lambda all_: [all_.apply(i) for i in range(all_.size())])(stored.getAllFiles())}
    before = files()
    near = dedup.near_titles(spark.createDataFrame([(t,) for t in texts], "task string"))
    assert near.count() == 400
    shuffled = sum(n for path, n in files().items() if path not in before and "shuffle" in path)
    assert shuffled < 4 * sum(map(len, texts)), shuffled / sum(map(len, texts))


def test_near_titles_broadcast_no_titles(spark):
    titles = spark.range(200).selectExpr("concat('a b c d e f g h ', id % 50) AS task")
    plan = dedup.near_titles(titles)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and all("LeftOuter" in line for line in sent), sent  # only the few long lists


def test_missing_and_blank_values_match_nothing(spark):
    df = lambda rows: spark.createDataFrame([("m", i, t) for i, t in enumerate(rows)], "meeting_id string, idx long, task string")
    counts = evaluation.similar_matches(df(["send the report", None, " ", ""]), df([None, "", " Send the report "]), ["meeting_id"], "task", "task", 0.8)
    assert [tuple(r) for r in counts.collect()] == [("m", 1, 4, 3)]


def test_report_rounds_halves_as_its_sql_does(spark):
    import duckdb

    values = [(10 * i + 5) / 10000 for i in range(1000)]
    df = spark.createDataFrame([(i, 1, 1, v, v, v, v, v) for i, v in enumerate(values)], "meeting_id int, n_gold int, n_pred int, precision double, recall double, f1 double, completeness double, avg_confidence double")
    got = {r.meeting_id: r.report.splitlines()[-1].split()[-1] for r in evaluation.report_lines(df).collect()}
    want = [x[0] for x in duckdb.execute("SELECT printf('%.3f', round(x, 3)) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert [got[i] for i in range(1000)] == want


def test_meetings_with_empty_predictions_count_as_zeros(spark):
    tasks = lambda rows: spark.createDataFrame(rows, "meeting_id string, idx long, task string, confidence double, assignee string, deadline string")
    pred, gold = tasks([("a", 0, "x", 0.5, None, None)]), tasks([(m, 0, "x", None, None, None) for m in "abc"])
    meetings = spark.createDataFrame([("a",), ("b",), ("d",)], "meeting_id string")
    found = {r.meeting_id: (r.tp, r.fp, r.fn, r.f1, r.avg_confidence, r.total_tasks) for r in evaluation.evaluate_tasks(pred, gold, meetings=meetings).collect()}
    assert found == {"a": (1, 0, 0, 1.0, 0.5, 1), "b": (0, 0, 0, 0.0, 0.0, 0)}


def test_exact_dedup_keeps_the_best_and_every_blank(spark, rows):
    df = spark.createDataFrame(
        [("m", 0, "Fix it", 0.8), ("m", 1, " fix IT ", 0.9), ("m", 2, "fix it", 0.9), ("m", 3, "", 0.1), ("m", 4, " ", 0.1), ("n", 0, "fix it", 0.2)],
        "meeting_id string, ord long, task string, confidence double",
    )
    got = rows(dedup.drop_equal_titles(df), "meeting_id", "ord")
    assert got == [("m", 1), ("m", 3), ("m", 4), ("n", 0)]
    again = dedup.drop_equal_titles(dedup.drop_equal_titles(df))
    assert rows(again, "meeting_id", "ord") == got


def test_text_dedup_follows_the_greedy_rule(spark, rows):
    titles = ["Update the release notes.", "Update the release note.", "Send the invoice.", "Update release notes.", "Send an invoice.", "Plan the offsite."]
    conf = [0.8, 0.9, 0.7, 0.8, 0.7, 0.8]
    df = spark.createDataFrame([("m", i, t, c) for i, (t, c) in enumerate(zip(titles, conf))], "meeting_id string, ord long, task string, confidence double")
    left, kept = list(range(len(titles))), []
    while left:
        seed, rest = left[0], left[1:]
        group = [seed] + [j for j in rest if SequenceMatcher(None, titles[seed].lower(), titles[j].lower()).ratio() >= 0.8]
        kept.append(max(group, key=lambda i: conf[i]))
        left = [i for i in left if i not in group]
    assert rows(dedup.drop_similar(df), "ord") == sorted((i,) for i in kept)


def test_partial_matching_against_the_loop(spark):
    rng = random.Random(4)
    words = ["draft the plan", "draft a plan", "send the report", "send report", "plan the launch", ""]
    pred = [("m", i, rng.choice(words)) for i in range(12)]
    gold = [("m", i, rng.choice(words)) for i in range(9)]
    used, tp = set(), 0
    for _, _, p in pred:
        for j, (_, _, g) in enumerate(gold):
            if p and g and j not in used and SequenceMatcher(None, p, g).ratio() >= 0.7:
                used.add(j)
                tp += 1
                break
    kind = "meeting_id string, idx long, task string"
    counts = evaluation.similar_matches(spark.createDataFrame(pred, kind), spark.createDataFrame(gold, kind), ["meeting_id"], "task", "task", 0.7)
    row = evaluation.match_metrics(counts).first()
    assert (row.tp, row.fp, row.fn) == (tp, 12 - tp, 9 - tp)
    assert row.tp + row.fp == len(pred)


def test_metrics_with_an_empty_side(spark, rows):
    kind = "meeting_id string, task string"
    pred = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", " ")], kind)
    gold = spark.createDataFrame([("b", "Y "), ("c", "z")], kind)
    counts = evaluation.exact_matches(pred, gold, ["meeting_id"], "task", "task")
    assert rows(evaluation.match_metrics(counts), "meeting_id", "tp", "fp", "fn") == [("a", 0, 0, 0), ("b", 1, 1, 0), ("c", 0, 0, 0)]
    strict = evaluation.match_metrics(counts, empty_gold_counts_predictions=True)
    assert rows(strict, "meeting_id", "fp") == [("a", 1), ("b", 1), ("c", 0)]


def brute_clusters(ids, vectors, action, obj, limit=0.7):
    n = len(ids)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = np.ones((n, n))
    for i in range(n):
        for j in range(n):
            c = unit[i] @ unit[j]
            s = 0.0 if c < 0.4 else c / (1 + 0.05 * abs(ids[i] - ids[j]))
            if action[i] is not None and action[i] == action[j] and obj[i] != obj[j]:
                s *= 0.6
            d[i, j] = 1 - s
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        best = min(((np.mean([d[a, b] for a in g for b in h]), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y))
        if best[0] >= limit:
            break
        _, x, y = best
        groups[x] += groups.pop(y)
    return sorted(tuple(sorted(int(ids[i]) for i in g)) for g in groups)


KIND = "meeting_id string, sentence_id long, vector array<double>, action string, object string"


def meeting(seed, n, most, dims=5):
    rng = np.random.default_rng(seed)
    vectors = sample(n, dims, seed)
    ids = np.sort(rng.choice(np.arange(-20, most), n, replace=False))
    action = [str(rng.choice(["send", "plan", "fix"])) if rng.random() < 0.8 else None for _ in ids]
    return ids, vectors, action, [str(rng.choice(["a", "b"])) for _ in ids]


def clusters_of(found):
    got = {}
    for r in found.collect():
        got.setdefault((r.meeting_id, r.cluster), []).append(r.sentence_id)
    assert all(min(g) == c for (_, c), g in got.items())
    return sorted((m, tuple(sorted(g))) for (m, _), g in got.items())


@pytest.mark.parametrize("span", [8, 64, 100, 1024])
def test_clusters_equal_whole_meeting_linkage(spark, span):
    meetings = {f"m{k}": meeting(k, 40, 60 + 50 * k) for k in range(5)}
    rows = [
        (m, int(i), [float(x) for x in v], a, o) for m, (ids, vectors, action, obj) in meetings.items() for i, v, a, o in zip(ids, vectors, action, obj)
    ]
    want = sorted((m, g) for m, x in meetings.items() for g in brute_clusters(*x))
    assert clusters_of(clusters.cluster_decisions(spark.createDataFrame(rows, KIND).repartition(3), span=span)) == want
    assert any(len(g) > 1 for _, g in want)


def test_clusters_of_a_meeting_of_one_long_chain(spark):
    """Each sentence resembles the next one, so nothing cuts the meeting; most tasks see a small part of it."""
    n = 3000
    turn = [(np.cos(i * 0.9), np.sin(i * 0.9)) for i in range(n)]
    rows = [("m", i, [float(x), float(y)], None, None) for i, (x, y) in enumerate(turn)]
    got = clusters_of(clusters.cluster_decisions(spark.createDataFrame(rows, KIND), span=256))
    same = clusters_of(clusters.cluster_decisions(spark.createDataFrame(rows, KIND), span=4096))
    assert got == same and sum(len(g) for _, g in got) == n and 100 < len(got) < n


def test_clusters_of_odd_decisions(spark):
    rows = [("m", 1, [1.0, 0.0], None, None), ("m", 2, [0.0, 0.0], "send", None), ("m", None, [1.0, 0.0], None, None), (None, 4, [1.0, 0.0], None, None), (None, 5, [1.0, 0.0], None, None)]
    got = sorted(map(str, map(tuple, clusters.cluster_decisions(spark.createDataFrame(rows, KIND)).collect())))
    assert got == sorted(map(str, [("m", 1, 1), ("m", 2, 2), ("m", None, None), (None, 4, 4), (None, 5, 4)]))
    assert clusters.cluster_decisions(spark.createDataFrame([], KIND)).collect() == []


def test_cluster_sentences(spark):
    texts = ["I think we should focus on the payment API first", "can you prepare the spec?", "let's aim for next wednesday", "just deploy it"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(clusters.clean_sentence(F.col("t"))).collect()] == [
        "Focus on the payment API.", "Prepare the spec.", "Aim for next Wednesday.", "Deploy the system.",
    ]


def test_publishing_works_the_changes_out_once(spark):
    from gavel.operators import mutations

    tasks = spark.createDataFrame(
        [("t1", 1, "Old", "d", "7", None, "DONE", "LOW", False), ("t2", None, "Other", "d", None, None, "TODO", "LOW", True), (None, 1, "No id", "d", None, None, "TODO", "LOW", False)],
        "id string, transcript_reference long, title string, description string, assignee_id string, due_date date, status string, priority string, is_manual boolean",
    )
    changes = spark.createDataFrame(
        [(1, 1, "OLD", "old", "new d", None, None, "t1", "updated"), (1, 2, "Fresh", "fresh", "a", "8", None, None, "created"), (1, 3, "FRESH", "fresh", "b", "9", None, None, "updated"),
         (2, 1, "Fresh", "fresh", "c", None, None, None, "created"), (2, 2, "fresh", "fresh", "x", None, None, None, "duplicate")],
        "transcript_id long, pos long, title string, title_key string, description string, assignee_id string, due_date date, task_id string, action string",
    )
    out = mutations.apply_publish(tasks, changes, F.concat_ws(":", "transcript_id", "title_key"))
    got = sorted((r.id or "", r.transcript_reference, r.title, r.description, r.assignee_id, r.status, r.is_manual) for r in out.collect())
    assert got == [
        ("", 1, "No id", "d", None, "TODO", False), ("1:fresh", 1, "Fresh", "b", "9", "TODO", False), ("2:fresh", 2, "Fresh", "c", None, "TODO", False),
        ("t1", 1, "Old", "new d", None, "DONE", False), ("t2", None, "Other", "d", None, "TODO", True),
    ]
    # Each change is read and grouped in one place only.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") == 1 and plan.count("Aggregate ") == 1, plan


BOARD = "id string, transcript_reference long, title string, description string, assignee_id long, due_date date, status string, priority string, is_manual boolean, other int"
ITEMS = "transcript_id long, pos long, title string, description string, assignee string, deadline string"


def some_board(spark, rng, ids):
    one = lambda *values: rng.choice(values)
    day = datetime.date(2024, 5, 1)
    name = lambda: one("Plan", " plan", "PLAN ", "Ship it", "ship it", "Fix", "", "  ", None)
    tasks = [(ids(k), one(1, 2, 3, 4, None), name(), one("a", " a", "b", None), one(7, 8, None), one(day, None), one("DONE", "TODO"), "LOW", one(True, False, False, None), k) for k in range(60)]
    items = [(one(1, 2, 3, 5, 6, None), k, name(), one("a", "a ", "b", None), one("7", "8", " ", "x", None), one("2024-05-01", "soon", None)) for k in range(90)]
    return spark.createDataFrame(tasks, BOARD).repartition(3), spark.createDataFrame(items, ITEMS).repartition(3)


def published_by_steps(tasks, items, new_id):
    from gavel.operators import mutations

    return mutations.apply_publish(tasks, mutations.publish_changes(tasks, items, F.col("_a").rlike("^[0-9]+$")), new_id)


@pytest.mark.parametrize("case", ["unique", "one_title", "null", "shared", "segments"])
def test_publishing_in_one_shuffle_gives_what_its_steps_give(spark, rows, case):
    from gavel.operators import mutations

    rng = random.Random(len(case))
    tasks, items = some_board(spark, rng, {"null": lambda k: None if k % 3 == 0 else f"t{k}", "shared": lambda k: f"t{k // 4}"}.get(case, lambda k: f"t{k}"))
    if case == "one_title":  # rows that come twice
        tasks, items = tasks.unionAll(tasks), items.unionAll(items)
    items = items.where("transcript_id IS NOT NULL") if case == "segments" else items
    new_id = F.concat_ws(":", "transcript_id", "title_key", "title")
    got = mutations.publish(tasks, items, new_id, F.col("_a").rlike("^[0-9]+$"), *([5] if case == "segments" else []))
    want = published_by_steps(tasks, items, new_id)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert rows(got) == rows(want) and want.where("id LIKE '%:%'").count() > 3
    joined = "Join" in got._jdf.queryExecution().optimizedPlan().toString()
    assert joined == (case in ("shared", "segments"))  # ids of several titles and large transcripts go the long way


def test_publishing_shuffles_tasks_and_items_once(spark, tmp_path):
    from gavel.workload import QUERIES

    n = F.col("id")
    spark.range(300).select(
        (n % 90).alias("l_orderkey"), (n * 7 % 50).alias("l_partkey"), (n % 10).alias("l_suppkey"), (n % 7).cast("int").alias("l_linenumber"), (n % 30).cast("double").alias("l_quantity"),
        (n * 1.5).cast("double").alias("l_extendedprice"), (n % 3 / 10).alias("l_discount"), (n % 2 / 10).alias("l_tax"), F.when(n % 3 == 0, "R").otherwise("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.timestamp_seconds(n * 86400).alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["publish_result_m2"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan, plan


def test_emails_offer_prefixes_of_asked_lengths_only(spark):
    from gavel.operators import results

    users = spark.createDataFrame([(1, "Ann Lee", "ann.lee@x.test"), (2, "Bo", "ann@x.test"), (3, "Cy", None), (4, "Di", "")], "id long, full_name string, email string")
    items = spark.createDataFrame([(1, " ANN LEE "), (2, "ann."), (3, "ann"), (4, "zed"), (5, None), (6, "ann@x.test.long")], "i int, assignee string")
    out = results.resolve_assignees(items, users)
    assert sorted((r.i, r.assignee_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, None), (5, None), (6, None)]
    assert results.resolve_assignees(items.where("i = 5"), users).select("assignee_id").collect()[0][0] is None
    assert "sequence(1, length(email" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_only_tasks_that_may_be_deleted_are_joined(spark):
    from gavel.operators import mutations

    tasks = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 1), (None, None)], "id string, owner_id int")
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "id string")
    left = lambda who: sorted(str(r[0]) for r in mutations.delete_tasks(tasks, ids, who).collect())
    assert left(1) == ["None", "b", "d"]
    assert left(None) == ["None", "a", "b", "d"]  # nobody is the owner of an owned task
    plan = mutations.delete_tasks(tasks, ids, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Aggregate" not in plan
