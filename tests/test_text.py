"""Text functions and predicates, values derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from gavel.functions import signals as sg
from gavel.functions import text as tx


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_clean(spark):
    assert apply(spark, tx.clean, [
        "  Um, I  think  uh we like it ", "We feel like running it", "Kindly prepone it", "pls revert back ASAP", "PL do the needful", "  ",
    ]) == [", I think we it", "We feel like running it", "move earlier it", "please reply as soon as possible", "please take necessary action", ""]


@pytest.mark.parametrize("text,stop", [
    ("Good morning all", True), ("Thanks everyone.", True), ("Yes.", True), ("Café.", True), ("One last thing before we go", True),
    ("I will fix the bug.", False), ("Great work on it", False), ("That's good to hear", True), ("...", True), ("What's your status?", True),
])
def test_stop_sentences(spark, text, stop):
    assert apply(spark, tx.is_stop_sentence, [text]) == [stop]


def test_sentence_types(spark):
    assert apply(spark, tx.sentence_type, [
        "Revenue is up 5%", "Churn went from three to five", "Numbers went from bad to worse", "That's great news", "I will do it", "It looks good",
    ]) == ["metric", "metric", "observation", "consequence", "general", "observation"]


def test_split_keeps_order(spark):
    assert apply(spark, tx.split_sentences, ["One. Two?  Three! v1.2 four", "none", " "]) == [["One.", "Two?", "Three!", "v1.2 four"], ["none"], []]


def test_normalise_and_sanitise(spark):
    assert apply(spark, tx.normalize_text, ["Wait...  what?!!", "a  b"]) == ["Wait. what?!", "a b"]
    assert apply(spark, tx.sanitize_task, ['"Fix the build!!"', "two words.", "- send it now -"]) == ["Fix the build", None, " send it now "]
    assert apply(spark, tx.extract_names, ["Ask Mara, then I and Omar: Mara"]) == [["Ask", "Mara", "Omar"]]


def test_titles(spark):
    assert apply(spark, tx.rule_based_title, [
        "I think we should just ship it by friday. Then rest.", "We'll probably migrate in may?", "I'm going to add tests", "",
    ]) == ["Ship it by Friday.", "Migrate in May.", "Add tests.", ""]
    df = spark.createDataFrame(
        [("look", "churn"), ("follow", None), ("zip", "files"), (None, "x"), ("have", "it"), ("need", "2000")], "v string, o string"
    )
    title = tx.triplet_title(F.col("v"), F.col("o"))
    got = [tuple(r) for r in df.select(title, tx.is_valid_title(title, F.col("v"), F.col("o"))).collect()]
    assert got == [
        ("Investigate Churn.", True), ("Follow up on.", True), ("Zip Files.", True), (None, False), ("Have It.", False), ("Need 2000.", False),
    ]


def test_deadlines(spark):
    assert apply(spark, sg.deadline, [
        "Send it by end of next week", "by Friday please", "due on 2024-05-17", "finish by month", "it was last Monday", "March 15 works", "tomorrow or today", "by Q3", "see you Friday",
    ]) == ["by end of next week", "by Friday", None, None, None, "March 15", "tomorrow", "by Q3", None]


def test_modals_and_boost(spark):
    assert apply(spark, sg.modal, ["We need to and should", "I can", "they ought to", "none here", "canary"]) == ["need to", "can", "ought to", None, None]
    df = spark.createDataFrame([("will", True), ("must", True), (None, True), ("can", False)], "m string, o boolean")
    assert [round(r[0], 2) for r in df.select(sg.modal_boost(F.col("m"), F.col("o"))).collect()] == [0.9, 1.0, 0.0, 0.5]


def test_fusion_matches_published_values(spark):
    # A committed sentence whose class score and context score are equal, prior 0.7, modal 'will' with object.
    s = 0.8887245950557287
    df = spark.createDataFrame([(s, 0.7, 1.0, 0.9, False), (0.8893734361858299, 0.7, 1.0, 0.0, False), (s, 0.7, 1.0, 0.9, True)], "b double, p double, t double, m double, n boolean")
    fused = sg.fuse_features(*[F.col(c) for c in "bptmn"])
    got = [r[0] for r in df.select(sg.fuse_context(F.col("b"), fused, F.col("n"))).collect()]
    assert got[1] == pytest.approx(0.7292862176723804, abs=1e-12)
    assert got[2] == 0.1
    assert got[0] == pytest.approx(0.4 * s + 0.6 * (s * 0.7 + 0.27), abs=1e-12)


def test_task_confidence_values(spark):
    df = spark.createDataFrame([("Ann", "Friday"), ("Ann", None), (None, "Friday"), (None, None)], "a string, d string")
    got = [r[0] for r in df.select(sg.task_confidence(F.col("a"), F.col("d"))).collect()]
    assert got == [0.9500000000000001, 0.89, 0.825, 0.7649999999999999]


def test_initials_and_slug(spark):
    assert apply(spark, tx.initials, ["Mara Lee Sung", "mo", "x", "", None]) == ["MS", "MO", "X", "?", "?"]
    assert apply(spark, lambda c: tx.slug(c, F.lit("fallback")), ["John Doe", "Ünï 7", "ß"]) == ["john-doe", "n-7", "fallback"]


def test_any_of_finds_what_the_plain_alternation_finds(spark):
    from gavel import lexicon as lx
    from gavel.workload.bank import PHRASES

    lists = [
        lx.STOP_SENTENCES, lx.METRIC_SENTENCES, lx.OBSERVATION_SENTENCES, lx.CONSEQUENCE_SENTENCES, lx.NON_ACTION_SENTENCES, lx.HARD_FILTERS,
        lx.SUGGESTION_MARKERS, lx.NEGATIONS, lx.REQUESTS, lx.ACCEPTANCES, lx.INVALID_DEADLINES, lx.NON_TASK_SENTENCES, lx.INVALID_TASK_TEXTS,
        lx.PAST_WORDS, [lx.DETECTION_VERBS], [lx.DEADLINE_ANCHORS], lx.DEADLINES, lx.CONVERSATIONAL_OPENINGS + lx.TITLE_FILLERS, [r"^a|b", "c?d", r"\w+ e"],
    ]
    odd = ["", "b", "xd", "é e", "Thank you all.", "Oh, thanks!", "ſure", "THAT'S GREAT", "it was up\n5 %", "so, 7% is compared to 9", "٣ %", "on 1/2", "\tgood morning", "not", "K"]
    df = spark.createDataFrame([(v,) for v in PHRASES + odd + [f"well, {p.lower()}" for p in PHRASES]], "t string")
    for patterns in lists:
        plain = tx.regex("|".join(f"(?:{p})" for p in patterns))
        assert df.where(F.col("t").rlike(plain) != F.col("t").rlike(tx.any_of(patterns))).collect() == [], patterns
    # Branches bound to the start are tried there only.
    assert tx.any_of(lx.NON_ACTION_SENTENCES).startswith("(?iU)^(?:") and "(?=[" in tx.any_of(lx.NEGATIONS)


def test_spaces_words_and_names(spark):
    assert apply(spark, tx.collapse, ["a\tb", " a \t\n b ", "a b", "a b", "\x1c a"]) == ["a b", "a b", "a b", "a b", "a"]
    assert apply(spark, lambda t: tx.has_words(t, 3), ["a b c", " a  b ", "", "a\tb\nc d"]) == [True, False, False, True]
    assert apply(spark, tx.capitalize_calendar, ["by monday in May, may be", "by Friday", "FRIDAY"]) == ["by Monday in May, May be", "by Friday", "Friday"]
    assert apply(spark, tx.rule_based_title, ["I think we should just fix it by friday?", "we'll probably go"]) == ["Fix it by Friday.", "Go."]
    from gavel.operators.extraction import named_speakers

    df = spark.createDataFrame([("Mara, go on", ["Mara", "Theo"]), ("ask theo and Mara", ["Mara", "Theo"]), ("élan: go", ["Élan"]), ("nobody", ["Mara"]), ("x", None), ("Marabel went", ["Mara"])], "t string, k array<string>")
    assert [tuple(r) for r in df.select(*named_speakers(F.col("t"), F.col("k"))).collect()] == [("Mara", "Mara"), ("Theo", "Theo"), ("Élan", "Élan"), (None, None), (None, None), (None, None)]


def test_transcripts_are_dealt_to_more_tasks_as_events_grow(spark, monkeypatch):
    from gavel.workload import bank

    monkeypatch.setattr(bank, "TASK_EVENTS", 10)
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert bank.event_rows(spark, "/root/testdata/sf0.001", "event_id").rdd.getNumPartitions() >= n // 10


def test_cheap_forms_give_what_the_full_forms_give(spark):
    words = ["", " ", "a", " a", "a\t", " a b ", "é", "é ", "a\x7f", "Um, we like  it", "um like it", "summary", "plan pls", "PLS do it",
             "a b", "ſome K", "we\tgo", "do  the needful", "do the needful", None]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    t = F.col("t")
    collapsed = tx.strip(tx.replace(t, r"\s+", " ", False))
    full = tx.collapse(tx.expand_phrases(tx.drop_spoken_fillers(collapsed)))
    pattern = tx.any_of([r"\b(some|k|pls)\b", r"^\s*um\b"])
    out = df.select(
        tx.strip_value(t).eqNullSafe(tx.strip(t)), tx.collapse(t).eqNullSafe(collapsed), tx.clean(t).eqNullSafe(full),
        tx.finds(t, pattern).eqNullSafe(t.rlike(pattern)),
    )
    assert all(all(row) for row in out.collect())
    assert [r[0] for r in df.select(tx.is_bare(t)).collect()[:5]] == [False, False, True, False, False]


def test_a_bound_value_does_not_ask_for_its_type_in_every_row(spark):
    bound = spark.range(1).select(tx.let(F.col("id"), lambda x: x + 1).alias("x"))
    plan = bound._jdf.queryExecution().analyzed().toString()
    assert "element_at" in plan and bound.first().x == 1


def test_detection_searches_ascii_texts_by_ascii_rules(spark):
    from gavel import lexicon as lx

    texts = ["Please fix the build now", "please ﬁx the build", "Please FIX the café door", "we sCheDule the audit", "éfix the door now", "the ſite is very slow, fix it", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = t.rlike(tx.any_of([lx.DETECTION_VERBS])) & ~t.rlike(tx.any_of(lx.NON_ACTION_SENTENCES)) & tx.has_words(t, 4)
    found = df.select(sg.is_actionable(t).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in found.collect())
    assert "octet_length" in found._jdf.queryExecution().analyzed().toString()
