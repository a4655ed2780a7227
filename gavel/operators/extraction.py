"""Who does it and until when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import signals as sg
from gavel.functions.text import capitalize_word, let, replace, strip, words


# The first three tokens of a text.
OPENING = r"(?U)^\s*\S+(?:\s+\S+){0,2}"


def named_speakers(text: Column, known: Column) -> tuple[Column, Column]:
    """F1 rules 2 and 4 against a meeting's speakers: (leading name, mentioned name), null where none.

    Rule 2 looks at the first three tokens. Rule 4 looks for whole-word mentions; of several, the first in
    the text counts, then the smaller name. A substring test runs first, so the per-name pattern is only
    compiled for names that occur at all.
    """
    lower = F.lower(text)
    occurring = let(lower, lambda low: F.filter(known, lambda n: F.contains(low, F.lower(n))))
    opening = F.filter(
        F.transform(words(F.lower(F.regexp_extract(text, OPENING, 0))), lambda w: F.rtrim(w, F.lit(",:"))),
        lambda w: (w != "") & (F.array_contains(known, w) | F.array_contains(known, capitalize_word(w))),
    )
    # In plain ASCII a leading name is one that occurs.
    lead = F.when(F.exists(occurring, lambda n: n != "") | (F.length(text) != F.octet_length(text)), let(F.get(opening, F.lit(0)), capitalize_word))

    def at(name: Column) -> Column:
        return F.regexp_instr(text, F.concat(F.lit(r"(?iU)\b\Q"), name, F.lit(r"\E\b")))

    mentions = F.filter(
        F.transform(occurring, lambda n: F.struct(at(n).alias("at"), n.alias("name"))), lambda m: m["at"] > 0
    )
    return lead, F.array_min(mentions)["name"]


def with_named_speakers(sentences: DataFrame) -> DataFrame:
    """Resolve rules 2 and 4 where the speaker array is at hand and drop the array, so that it never travels
    through a shuffle with every sentence."""
    lead, mention = named_speakers(F.col("text"), F.col("known_speakers"))
    return (
        sentences.withColumn("lead_speaker", lead)
        .withColumn("mentioned_speaker", mention)
        .drop("known_speakers")
    )


def assignee(
    subject: Column, speaker: Column, lead: Column, mention: Column, qa_answer: Column | None = None
) -> Column:
    """F1 + F2: self, named addressee, team, mention; then a usable answer of the caller's model; then the
    speaker."""
    who = F.coalesce(F.lower(subject), F.lit(""))
    rule = F.coalesce(
        F.when(who.isin(lx.SELF_SUBJECTS), F.nullif(speaker, F.lit(""))),
        F.when(~who.isin(lx.SELF_SUBJECTS), lead),
        F.when(who.isin(lx.TEAM_SUBJECTS), F.lit(lx.TEAM_ASSIGNEE)),
        F.when(~who.isin(lx.SELF_SUBJECTS), mention),
    )
    if qa_answer is None:
        return F.coalesce(rule, speaker)
    answer = strip(qa_answer)
    usable = F.when((F.length(answer) > 1) & ~answer.isin(lx.GENERIC_SPEAKERS), answer)
    return F.coalesce(rule, usable, speaker)


def clean_answer(answer: Column, known: Column) -> Column:
    """Strip 'Alice:' and 'Alice said:' prefixes and trailing punctuation; prefer a known speaker, also
    the first capitalised word of a longer answer; otherwise keep the cleaned answer."""
    bare = F.rtrim(strip(replace(answer, r"^\s*\w+\s*(?:said)?\s*:\s*", "")), F.lit(".,;:!?"))
    def pick(a: Column) -> Column:
        capital = F.get(F.filter(words(a), lambda w: w.rlike(r"^\p{Lu}")), F.lit(0))
        name = F.rtrim(capital, F.lit(".,;:!?"))
        return F.when(F.array_contains(known, a), a).when(F.array_contains(known, name), name).otherwise(a)

    return let(bare, pick)


def extract(detections: DataFrame) -> DataFrame:
    """decision rows with assignee, deadline and evidence.

    Optional inputs: `qa_answer` (F2), `date_entities` (F5), `known_speakers` or the resolved
    `lead_speaker` / `mentioned_speaker` columns (F1); without any of the latter no speaker is known.
    """
    df = detections.where("is_decision")
    if "known_speakers" in df.columns:
        df = with_named_speakers(df)
    have = set(df.columns)
    null = F.lit(None).cast("string")
    lead = F.col("lead_speaker") if "lead_speaker" in have else null
    mention = F.col("mentioned_speaker") if "mentioned_speaker" in have else null
    text = F.col("text")
    evidence = F.struct(
        text.alias("text"),
        F.coalesce("speaker", F.lit("Unknown")).alias("speaker"),
        (F.col("sentence_type") if "sentence_type" in have else F.lit("general")).alias("sentence_type"),
        F.coalesce(F.col("hard_filtered") if "hard_filtered" in have else F.lit(False), F.lit(False)).alias(
            "hard_filtered"
        ),
    )
    keep = [c for c in ("meeting_type",) if c in have]
    return df.select(
        "meeting_id", "ord", "sentence_id", *keep,
        text.alias("raw_text"),
        assignee(
            F.col("subject"), F.col("speaker"), lead, mention, F.col("qa_answer") if "qa_answer" in have else None
        ).alias("assignee"),
        sg.deadline(text, F.col("date_entities") if "date_entities" in have else None).alias("deadline"),
        F.col("confidence").alias("detection_confidence"),
        *([F.col("modal_boost")] if "modal_boost" in have else []),
        *([F.col("generated")] if "generated" in have else []),
        "root_verb", "object",
        evidence.alias("evidence"),
    )


def extraction_stats(extractions: DataFrame) -> DataFrame:
    """counts, shares and averages per meeting, combined map-side."""
    aggs = [
        F.count(F.lit(1)).alias("n_definitions"),
        F.count("assignee").alias("n_with_assignee"),
        F.count("deadline").alias("n_with_deadline"),
        F.avg("detection_confidence").alias("avg_confidence"),
    ]
    if "modal_boost" in extractions.columns:
        aggs.append(F.avg((F.coalesce("modal_boost", F.lit(0.0)) > 0).cast("double")).alias("modal_share"))
    return extractions.groupBy("meeting_id").agg(*aggs)
