"""Whole-corpus plans: raw transcripts to tasks, stage by stage, as one lazy frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions import ordered
from gavel.functions.text import sentence_type
from gavel.operators import context, dedup, detection, extraction, syntax, tasks, turns


@dataclass
class Stages:
    """The frames of each stage; all lazy, nothing runs until one is written or collected."""

    sentences: DataFrame
    detections: DataFrame
    extractions: DataFrame
    tasks: DataFrame
    contract: DataFrame | None = None


def prepare(
    sentences: DataFrame,
    annotations: DataFrame | None = None,
    strict: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Annotated, typed sentences with dialogue context resolved.

    Expects `(meeting_id, ord, sentence_id, speaker, text)`; an optional `known_speakers` array is used up
    here, before anything is shuffled. `rows` as in `ordered`.
    """
    known = F.col("known_speakers") if "known_speakers" in sentences.columns else None
    addressed = sentences.withColumn("addressee", context.addressee(F.col("text"), known))
    if known is not None:
        addressed = extraction.with_named_speakers(addressed)
    annotated = (
        syntax.annotate_by_rules(addressed)
        if annotations is None
        else syntax.with_annotations(addressed, annotations)
    )
    typed = annotated.withColumn("sentence_type", sentence_type(F.col("text")))
    return context.resolve_triplets(context.dialogue_windows(typed, rows=rows), strict, rows)


def tasks_from_sentences(
    sentences: DataFrame,
    mode: str = "rule",
    scores: DataFrame | None = None,
    annotations: DataFrame | None = None,
    semantic: bool = False,
    vectors: str | None = None,
    detection_col: str | None = None,
    rows: int | None = None,
) -> Stages:
    """Sentences to tasks. An optional `meeting_type` column is used by the priors and the validator."""
    resolved = prepare(sentences, annotations, rows=rows)
    detected = detection.detect(resolved, mode, scores)
    extracted = extraction.extract(detected)
    built = tasks.build_tasks(extracted, rows)
    valid = tasks.validate_tasks(tasks.score_tasks(built, detection_col))
    final = dedup.drop_equal_titles(valid)
    if semantic:
        final = dedup.drop_similar(final, vectors=vectors)
    return Stages(resolved, detected, extracted, final)


def extract_tasks(transcripts: DataFrame, allow_mmss: bool = False, **options) -> Stages:
    """Raw `(meeting_id, raw_text)` to action items.

    Parsing, splitting, cleaning and filtering are a narrow stage behind the scan. A meeting is one row of
    text, bounded by the upload limit, so the windows after it run over whole meetings.
    """
    stages = tasks_from_sentences(turns.sentences_from_transcripts(transcripts, allow_mmss), **options)
    stages.contract = tasks.to_contract(transcripts, stages.tasks)
    return stages


def tasks_from_turns(
    turn_table: DataFrame, rows: int | None = ordered.SEGMENT_ROWS, known_speakers: bool = True, **options
) -> Stages:
    """A turn table of any shape to tasks, as `extract_tasks` makes them from raw text.

    Windows run over segments of `rows` turns, whatever the size of a meeting; None means whole meetings. With
    `known_speakers=False` names in the text are not taken for speakers.
    """
    sentences = turns.sentences_from_turns(turn_table, rows)
    if known_speakers:
        sentences = turns.with_known_speakers(sentences, turn_table)
    types = context.meeting_types(sentences, rows).select("meeting_id", "meeting_type")
    return tasks_from_sentences(sentences.join(types, "meeting_id"), rows=rows, **options)
