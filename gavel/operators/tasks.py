"""Extractions -> titled, scored, validated tasks -> one contract row per meeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions import ordered
from gavel.functions import signals as sg
from gavel.functions import text as tx


def title_of(raw_text: Column, verb: Column, obj: Column, generated: Column | None = None) -> Column:
    """G2, then G6: the triplet title when it is valid, else generated text that passes G5, else G4."""
    fallback = tx.rule_based_title(raw_text)
    if generated is not None:
        fallback = F.coalesce(F.when(tx.is_generated_task(generated), generated), fallback)
    usable = tx.let(tx.triplet_title(verb, obj), lambda t: F.when(tx.is_valid_title(t, verb, obj), t))
    return F.coalesce(usable, fallback)


def titled(extractions: DataFrame) -> DataFrame:
    """G2-G6 and the final G3, without task numbers."""
    generated = F.col("generated") if "generated" in extractions.columns else None
    title = title_of(F.col("raw_text"), F.col("root_verb"), F.col("object"), generated)
    return tx.once(extractions, "task", title).where(tx.is_valid_title(F.col("task")))


TASK_COLUMNS = [
    "meeting_id", "ord", "sentence_id", "meeting_type", "detection_confidence", "task", "assignee", "deadline", "evidence",
]


def build_tasks(extractions: DataFrame, rows: int | None = None) -> DataFrame:
    """Valid titles, numbered per meeting after filtering. What only the titles needed is dropped here."""
    slim = titled(extractions).select(*[c for c in TASK_COLUMNS if c in [*extractions.columns, "task"]])
    numbered = ordered.number_rows(slim, ["meeting_id"], "ord", "_n", rows)
    return numbered.withColumn("task_id", F.concat(F.lit("task_"), F.col("_n"))).drop("_n")


def score_tasks(tasks: DataFrame, detection_col: str | None = None) -> DataFrame:
    """H1 + H2. By default every task counts as surely detected; `detection_col` uses a detector's score."""
    detected = None if detection_col is None else F.col(detection_col)
    return tasks.withColumn(
        "confidence", sg.task_confidence(F.col("assignee"), F.col("deadline"), detected)
    ).withColumn("requires_manual_review", F.when(sg.needs_review(F.col("confidence")), True))


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """H3; a frame without a meeting type is treated as mixed."""
    kind = F.col("meeting_type") if "meeting_type" in tasks.columns else F.lit("mixed")
    return tasks.where(
        sg.is_valid_task(
            F.col("confidence"), F.col("evidence.hard_filtered"), F.col("evidence.text"),
            F.col("evidence.sentence_type"), kind,
        )
    )


def to_contract(meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per meeting, `summary` and the ordered `action_items`, both always present.

    A meeting's items end up in one array, because that is the format; the meeting's transcript bounds it.
    """
    items = tasks.groupBy("meeting_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "ord",
                        F.struct(
                            F.col("task").alias("title"), F.col("task").alias("description"), "assignee", "deadline"
                        ).alias("item"),
                    )
                )
            ),
            lambda s: s["item"],
        ).alias("action_items")
    )
    empty = F.from_json(
        F.lit("[]"), "array<struct<title:string,description:string,assignee:string,deadline:string>>"
    )
    return meetings.select("meeting_id").join(items, "meeting_id", "left").select(
        "meeting_id",
        F.struct(F.lit(None).cast("string").alias("summary_text")).alias("summary"),
        F.coalesce("action_items", empty).alias("action_items"),
    )
