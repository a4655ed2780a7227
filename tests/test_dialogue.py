"""Turns, sentences, context and the ordered operators, plain and segmented."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavel.functions import ordered
from gavel.operators import context, detection, turns
from gavel.plans.meeting_tasks import extract_tasks, prepare, tasks_from_turns

MEETING = """
Weekly sync
Mara: Good morning everyone. Let's start with the plan.
  Theo - I will draft the report by Friday.
and send it to the board
[00:03:12] Priya: Theo, can you review the budget?
Theo: Sure, I can do that.
Agenda:
see http://x
Zoë: Update the wiki. Update the wiki.
"""


def transcripts(spark, *texts):
    return spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "meeting_id string, raw_text string")


def test_turn_formats(spark, rows):
    got = rows(turns.parse_turns(transcripts(spark, MEETING)), "turn_id", "speaker", "timestamp", "text")
    assert got == [
        (1, "unknown", None, "Weekly sync"),
        (2, "Mara", None, "Good morning everyone. Let's start with the plan."),
        (3, "Theo", None, "I will draft the report by Friday. and send it to the board"),
        (4, "Priya", "00:03:12", "Theo, can you review the budget?"),
        (5, "Theo", None, "Sure, I can do that. Agenda:"),
        (6, "see http", None, "//x"),
        (7, "Zoë", None, "Update the wiki. Update the wiki."),
    ]


def test_short_timestamps_are_optional(spark, rows):
    one = transcripts(spark, "[03:12] Mara: hello there")
    assert rows(turns.parse_turns(one), "speaker", "text") == [("[03", "12] Mara: hello there")]
    assert rows(turns.parse_turns(one, allow_mmss=True), "speaker", "timestamp") == [("Mara", "03:12")]


def test_empty_transcripts(spark):
    empty = transcripts(spark, "", "  \n \n")
    assert turns.parse_turns(empty).count() == 0
    contract = extract_tasks(empty).contract.collect()
    assert len(contract) == 2 and all(r.action_items == [] and r.summary.summary_text is None for r in contract)


def test_line_tables_equal_raw_text(spark, rows):
    lines = spark.createDataFrame(
        [("m0", i, line) for i, line in enumerate(MEETING.split("\n"))], "meeting_id string, line_no long, line string"
    )
    want = rows(turns.parse_turns(transcripts(spark, MEETING)), "turn_id", "speaker", "timestamp", "text")
    for size in (None, 2, 3):
        assert rows(turns.turns_from_lines(lines, size), "turn_id", "speaker", "timestamp", "text") == want


def test_sentence_ids_have_gaps(spark, rows):
    got = rows(turns.sentences_from_transcripts(transcripts(spark, MEETING)), "ord", "sentence_id", "text")
    assert got[:3] == [(0, 1, "Weekly sync"), (1, 3, "Let's start with the plan."), (2, 4, "I will draft the report by Friday.")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["Mara: a b", "Theo - c d", "plain words", "", "  ", "[01:02:03] Wei: e"]), max_size=12))
def test_turn_count_property(spark, lines):
    got = turns.parse_turns(transcripts(spark, "\n".join(lines))).count()
    real = [x for x in lines if x.strip()]
    marked = sum(1 for x in real if x != "plain words")
    assert got == marked + (1 if real and real[0] == "plain words" else 0)


# --- ordered operators ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    data = []
    for g in range(3):
        for i in range(0 if g == 2 else 40):
            data.append((g, i, rng.choice([None, None, None, f"v{i}"]), rng.randint(0, 4)))
    data.append((2, 0, None, 1))
    return data


@pytest.mark.parametrize("size", [None, 1, 4, 7, 100])
def test_ordered_operators_do_not_depend_on_segments(spark, rows, numbers, size):
    df = spark.createDataFrame(numbers, "g int, i long, v string, n int").repartition(3)
    filled = ordered.fill_forward(df, ["g"], "i", F.col("v"), "last", size)
    total = ordered.running_total(df, ["g"], "i", {"a": F.col("n"), "b": F.lit(1)}, size)
    want_last, want_total = [], []
    for g in range(3):
        last, a, b = None, 0, 0
        for _, i, v, n in [r for r in numbers if r[0] == g]:
            a, b = a + n, b + 1
            want_last.append((g, i, last))
            want_total.append((g, i, a, b))
            last = v if v is not None else last
    assert rows(filled, "g", "i", "last") == sorted(want_last, key=lambda t: t[:2])
    assert rows(total, "g", "i", "a", "b") == sorted(want_total)


def test_segment_rows_checks_the_largest_group(spark, numbers):
    df = spark.createDataFrame(numbers, "g int, i long, v string, n int")
    assert ordered.segment_rows(df, ["g"], 39) == 39
    assert ordered.segment_rows(df, ["g"], 40) is None


WORDING = [
    "I will draft the plan.", "Can you review it by Friday?", "Sure, I can do that.", "Theo, can you send the report?", "Let's fix the build.",
    "Update that tomorrow.", "We need to check them.", "The numbers are good.", "Please write to us.", "Okay, will do.",
]


def turn_table(spark, n, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["hot", "hot", "cold"]), i, rng.choice(["Mara", "Theo", "Wei"]), None, rng.choice(WORDING)) for i in range(n)]
    return spark.createDataFrame(data, "meeting_id string, turn_id long, speaker string, timestamp string, text string")


def test_raw_text_and_turn_table_give_the_same_tasks(spark, rows):
    lines = ["Mara: Theo, can you send the report by Friday?", "Theo: Sure, I can do that.", "Priya: Mara will fix the login page tomorrow.", "Mara: Ask Priya to review the plan."]
    raw = spark.createDataFrame([("m", "\n".join(lines)), ("n", "\n".join(lines[::-1]))], "meeting_id string, raw_text string")
    columns = ["meeting_id", "task_id", "task", "assignee", "deadline", "confidence"]
    from_raw = rows(extract_tasks(raw).tasks, *columns)
    assert rows(tasks_from_turns(turns.parse_turns(raw)).tasks, *columns) == from_raw
    assert {r[3] for r in from_raw} >= {"Theo", "Mara"}
    assert rows(tasks_from_turns(turns.parse_turns(raw), known_speakers=False).tasks, *columns) != from_raw


def test_segmented_pipeline_equals_plain(spark, rows):
    table = turn_table(spark, 90, 3)
    columns = ["meeting_id", "task_id", "task", "assignee", "deadline", "confidence"]
    plain = rows(tasks_from_turns(table, rows=None).tasks, *columns)
    assert rows(tasks_from_turns(table, rows=8).tasks, *columns) == plain and plain


def test_triplets_against_a_sequential_walk(spark):
    table = turn_table(spark, 60, 9)
    out = [r.asDict() for r in prepare(turns.sentences_from_turns(table)).orderBy("meeting_id", "ord").collect()]
    from gavel.operators.syntax import annotate_by_rules

    start = {(r.meeting_id, r.ord): r for r in annotate_by_rules(turns.sentences_from_turns(table)).collect()}
    state, before = {}, {}
    vague = {"it", "that", "this", "them", "those", "these", "you", "me", "him", "her", "us", "day"}
    for r in out:
        raw = start[(r["meeting_id"], r["ord"])]
        key = (r["meeting_id"], r["speaker"])
        want = raw.object
        if raw.object and raw.object.lower() not in vague:
            pass
        elif (raw.object or raw.root_verb) and key in state:
            want = state[key]
        assert r["object"] == want
        if raw.object and raw.object.lower() not in vague:
            state[key] = raw.object
        subject = raw.subject
        if r["text"].lower().startswith("let's"):
            subject = "team"
        elif subject is None and raw.root_verb:
            subject = r["speaker"]
        if subject == "you":
            subject = before.get(r["meeting_id"], "you")
        assert r["subject"] == subject
        before[r["meeting_id"]] = r["speaker"]


def test_triplet_scores(spark):
    df = spark.createDataFrame(
        [("team", True, "plan", None, "draft"), ("Wei", None, None, None, "be"), ("you", None, "it", None, "fix"), (None, None, None, None, None)],
        "subject string, subject_resolved boolean, object string, object_resolved boolean, root_verb string",
    )
    got = [(r.triplet_confidence, r.triplet_flags) for r in context.score_triplets(df).collect()]
    assert got == [
        (0.8, ["resolved_via_context"]),
        (0.75, ["weak_root_verb", "null_object"]),
        (0.6, ["unresolved_pronoun_subject", "unresolved_pronoun_object"]),
        (0.7, ["null_subject", "null_object"]),
    ]


def test_hybrid_detection_zones_and_pairs(spark):
    table = spark.createDataFrame(
        [("m", 0, "A", None, "Can you send the report to legal?"), ("m", 1, "B", None, "Of course, gladly and now."), ("m", 2, "A", None, "The board will be happy about it."), ("m", 3, "A", None, "We will never deploy that.")],
        "meeting_id string, turn_id long, speaker string, timestamp string, text string",
    )
    s = turns.sentences_from_turns(table)
    scores = s.select("meeting_id", "sentence_id", F.lit(0.1).alias("p_decision"), F.lit(0.2).alias("p_commitment"), F.lit(0.1).alias("p_discussion"))
    out = {r.ord: r for r in detection.detect(prepare(s), "hybrid", scores).collect()}
    assert out[1].is_turn_pair_acceptance and out[1].paired_request_idx == 0 and out[1].confidence == 0.85 and out[1].is_decision
    assert out[2].hard_filtered and out[2].confidence == 0.1 and not out[2].is_decision and out[2].method == "rule_based"
    assert out[3].has_negation and out[3].confidence == 0.1 and out[3].is_decision
    with pytest.raises(ValueError):
        detection.detect(s, "other")


def test_full_plan(spark, rows):
    got = rows(extract_tasks(transcripts(spark, MEETING)).tasks, "task_id", "task", "assignee", "deadline")
    print(got)
    assert got[0] == ("task_1", "Draft The report.", "Theo", "by Friday")


def test_one_shuffle_before_the_windows(spark):
    plan = extract_tasks(transcripts(spark, MEETING)).tasks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_models_run_only_where_needed(spark, rows):
    import pandas as pd

    from gavel.functions import models
    from gavel.operators import extraction

    def load():
        def score(texts):
            if texts.str.contains("competitor").any():
                raise AssertionError("a hard-filtered sentence reached the model")
            hit = texts.str.contains("will").astype(float)
            return pd.DataFrame({"p_decision": hit * 0.6 + 0.1, "p_commitment": 0.2, "p_discussion": 0.3})

        return score

    table = spark.createDataFrame(
        [("m", 0, "A", None, "We will ship the new release."), ("m", 1, "B", None, "They switched to a competitor again."), ("m", 2, "B", None, "Nice weather in the city today.")],
        "meeting_id string, turn_id long, speaker string, timestamp string, text string",
    )
    s = prepare(turns.sentences_from_turns(table))
    scored = detection.score_sentences(s, models.per_worker(load, models.CLASS_SCORES))
    assert rows(scored, "ord", "p_decision") == [(0, 0.7), (1, None), (2, 0.1)]
    found = detection.detect(scored, "hybrid")
    got = {r.ord: (r.transformer_decision_type, r.is_decision, r.hard_filtered) for r in found.collect()}
    assert got == {0: ("decision", True, None), 1: (None, False, True), 2: ("discussion", False, None)}

    answer = models.per_worker(lambda: lambda texts: texts.str.split().str[0])
    asked = models.apply_where(s.withColumn("is_decision", F.lit(True)), F.col("subject") == "they", "qa_answer", answer(F.col("text")))
    assert asked.where("qa_answer is not null").count() <= 1
    assert extraction.extract(asked.withColumns({"confidence": F.lit(1.0)})).count() == 3


def test_parse_annotations_take_one_exchange_and_no_join(spark):
    tokens = spark.createDataFrame([(1, 1, 0, "Do", "do", "VERB", "VB", "ROOT", 0, None)], "meeting_id int, sentence_id int, i long, text string, lemma string, pos string, tag string, dep string, head long, ent_type string")
    from gavel.operators.syntax import annotate_from_parse

    plan = annotate_from_parse(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_root_verbs_need_no_join(spark):
    from gavel.operators import syntax

    rows = [
        (1, 1, 0, "go", "VERB", "VB", "ROOT", 0), (1, 1, 2, "send", "VERB", "VB", "xcomp", 0), (1, 1, 1, "plan", "VERB", "VB", "ccomp", 2),
        (1, 1, 3, "get", "VERB", "VB", "ccomp", 0), (1, 2, 0, "have", "AUX", "VBD", "ROOT", 0), (1, 2, 1, "do", "NOUN", "VB", "xcomp", 0),
        (2, 1, 1, "review", "VERB", "VB", "ROOT", 1), (2, 1, 0, "send", "VERB", "VB", "xcomp", 1), (2, 2, 0, "team", "NOUN", "NN", "ROOT", 0),
        (2, 3, 0, "send", "VERB", "VB", "xcomp", 0), (None, 1, 0, "go", "VERB", "VB", "ROOT", 0),
    ]
    tokens = spark.createDataFrame(rows, "meeting_id int, sentence_id int, i int, lemma string, pos string, tag string, dep string, head int")
    out = syntax.root_verbs(tokens)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "send", "VB"), (1, 2, "have", "VBD"), (2, 1, "review", "VB"), (2, 2, None, "NN"), (2, 3, None, None)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
