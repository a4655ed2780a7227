"""Dialogue context: subject and object resolution, triplet scores, context windows, request/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions.signals import is_acceptance, is_request
from gavel.functions.text import strip
from gavel.operators.turns import meeting_type_from


def dialogue_windows(
    sentences: DataFrame, context: int = lx.CONTEXT_SENTENCES, rows: int | None = None
) -> DataFrame:
    """Everything that looks back a bounded number of sentences, in one shuffle:

    `prev_speaker` (for D3), `context_text` (D8), `prev_is_request` (for D9).
    """
    placed = ordered.with_halo(sentences, "ord", max(context, 1), rows)
    w = ordered.window(["meeting_id"], "ord", rows)
    texts = F.collect_list("text").over(w.rowsBetween(-context, 0))
    looked = placed.select(
        "*",
        F.lag("speaker").over(w).alias("prev_speaker"),
        F.array_join(texts, lx.CONTEXT_SEPARATOR).alias("context_text"),
        F.coalesce(F.lag(is_request(F.col("text"))).over(w), F.lit(False)).alias("prev_is_request"),
    )
    return ordered.drop_halo(looked, rows)


def addressee(text: Column, known: Column | None = None) -> Column:
    """The name a sentence opens with ('Name, …'), when it is a known one; polite words are removed from the
    opening as plain substrings. `known` adds a meeting's speakers to the fixed list."""
    opening = strip(F.substring_index(text, ",", 1))
    called = strip(F.replace(F.replace(opening, F.lit("please"), F.lit("")), F.lit("ok"), F.lit("")))
    is_known = called.isin(lx.FIXED_ADDRESSEES)
    if known is not None:
        is_known = is_known | F.coalesce(F.array_contains(known, called), F.lit(False))
    return F.when(F.contains(text, F.lit(",")) & is_known, called)


def resolve_subjects(df: DataFrame) -> DataFrame:
    """D1-D3. Needs `prev_speaker`, and `addressee` as computed above."""
    lower = F.lower(F.col("text"))
    lets = F.startswith(lower, F.lit("let's")) | F.startswith(lower, F.lit("let us"))
    by_speaker = F.col("subject").isNull() & F.col("root_verb").isNotNull()
    step = df.withColumn("_resolved", lets | by_speaker).withColumn(
        "subject",
        F.when(lets, F.lit("team"))
        .when(by_speaker, F.coalesce("speaker", F.lit(lx.UNKNOWN_SPEAKER)))
        .otherwise(F.col("subject")),
    )
    you = F.when(F.col("subject") == "you", F.coalesce("addressee", "prev_speaker"))
    return (
        step.withColumn("_you", you)
        .withColumn("subject", F.coalesce("_you", "subject"))
        .withColumn("subject_resolved", F.when(F.col("_resolved") | F.col("_you").isNotNull(), True))
        .drop("_resolved", "_you", "addressee")
    )


def resolve_objects(df: DataFrame, strict: bool = False, rows: int | None = None) -> DataFrame:
    """A pronoun, a weekday-like object or a missing object takes the same speaker's last meaningful one.

    Resolved values never feed the carry, so this is a fill-forward over the original objects. With `strict`
    the article is stripped as a set of characters ('that' -> 'a'), which leaves most pronouns alone.
    """
    obj = F.col("object")
    bare = strip(F.lower(obj), "the ") if strict else F.regexp_replace(strip(F.lower(obj)), r"^the\s+", "")
    vague = bare.isin(lx.TRIPLET_PRONOUNS + lx.TEMPORAL_OBJECTS)
    present = F.coalesce(obj, F.lit("")) != ""
    marked = df.withColumn("_vague", present & vague)
    meaningful = F.when(present & ~F.col("_vague"), obj)
    filled = ordered.fill_forward(marked, ["meeting_id", "speaker"], "ord", meaningful, "_last", rows)
    wants = F.col("_vague") | (~present & F.col("root_verb").isNotNull())
    takes = wants & F.col("_last").isNotNull()
    return (
        filled.withColumn("_takes", takes)
        .withColumn("object", F.when(F.col("_takes"), F.col("_last")).otherwise(obj))
        .withColumn("object_resolved", F.when(F.col("_takes"), True))
        .drop("_vague", "_last", "_takes")
    )


def score_triplets(df: DataFrame) -> DataFrame:
    """Confidence in a triplet and the reasons it was lowered, in a fixed order.

    Penalties are whole hundredths, so the score is summed as integers and divided once; this equals rounding
    the floating sum to two places.
    """
    subject, obj = F.lower("subject"), F.lower("object")
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "resolved_via_context": yes(F.col("object_resolved")) | yes(F.col("subject_resolved")),
        "unresolved_pronoun_subject": yes(subject.isin(lx.TRIPLET_PRONOUNS)),
        "unresolved_pronoun_object": yes(obj.isin(lx.TRIPLET_PRONOUNS)),
        "weak_root_verb": yes(F.col("root_verb").isin(lx.WEAK_TRIPLET_VERBS)),
        "null_subject": F.col("subject").isNull(),
        "null_object": F.col("object").isNull(),
    }
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]))
    cents = F.lit(100)
    for name, hit in checks.items():
        cents = cents - F.when(hit, round(lx.TRIPLET_PENALTY[name] * 100)).otherwise(0)
    return df.withColumn("triplet_confidence", F.greatest(F.lit(0), cents) / F.lit(100.0)).withColumn(
        "triplet_flags", flags
    )


def resolve_triplets(df: DataFrame, strict: bool = False, rows: int | None = None) -> DataFrame:
    """let's, speaker default, you, carry-forward, score; in that order."""
    return score_triplets(resolve_objects(resolve_subjects(df), strict, rows))


def pair_acceptances(df: DataFrame) -> DataFrame:
    """A reply that accepts the request right before it is a decision. Needs `prev_is_request`."""
    pair = F.col("prev_is_request") & is_acceptance(F.col("text"))
    raise_it = F.col("_pair") & (F.col("confidence") < lx.PAIR_CONFIDENCE_FLOOR)
    return (
        df.withColumn("_pair", pair)
        .withColumn("is_turn_pair_acceptance", F.when(F.col("_pair"), True))
        .withColumn("paired_request_idx", F.when(F.col("_pair"), (F.col("ord") - 1).cast("int")))
        .withColumn("is_decision", F.col("is_decision") | F.col("_pair"))
        .withColumn("confidence_zone", F.when(raise_it, "high").otherwise(F.col("confidence_zone")))
        .withColumn("confidence", F.when(raise_it, lx.PAIR_CONFIDENCE).otherwise(F.col("confidence")))
        .drop("_pair")
    )


def meeting_types(sentences: DataFrame, rows: int | None = None) -> DataFrame:
    """D10 over a sentence table: each signal is a boolean maximum, combined map-side per meeting.

    A signal of several words may start in one sentence and end in a later one, so each text is looked at
    together with the sentences before it (as many as the longest signal has words, less one).
    """
    reach = max(len(s.split()) for s in lx.TASK_SIGNALS + lx.STATUS_SIGNALS) - 1
    placed = ordered.with_halo(sentences.select("meeting_id", "ord", "text"), "ord", reach, rows)
    w = ordered.window(["meeting_id"], "ord", rows).rowsBetween(-reach, 0)
    joined = placed.select("meeting_id", F.lower(F.array_join(F.collect_list("text").over(w), " ")).alias("t"))
    hits = [
        F.bool_or(F.contains("t", F.lit(s))).alias(f"_{kind}{i}")
        for kind, signals in (("task", lx.TASK_SIGNALS), ("status", lx.STATUS_SIGNALS))
        for i, s in enumerate(signals)
    ]
    found = joined.groupBy("meeting_id").agg(*hits)

    def total(kind: str, signals) -> Column:
        out = F.lit(0)
        for i in range(len(signals)):
            out = out + F.col(f"_{kind}{i}").cast("int")
        return out

    counted = found.select(
        "meeting_id",
        total("task", lx.TASK_SIGNALS).alias("task_signals"),
        total("status", lx.STATUS_SIGNALS).alias("status_signals"),
    )
    return counted.withColumn("meeting_type", meeting_type_from(F.col("task_signals"), F.col("status_signals")))
