"""Transcripts, labels and predictions in; stage outputs and contracts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel import schemas


def file_stem(suffix: str) -> Column:
    """File name without folder and the given ending."""
    escaped = suffix.replace(".", r"\.")
    encoded = F.col("_metadata.file_name")
    name = F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)
    return F.regexp_extract(name, rf"^(.*){escaped}$", 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A1, A2: one row per `*.txt` file, `meeting_id` from its name.

    Files are read as bytes, so that bad bytes never fail a scan. File sources skip files of zero bytes; a file
    of blanks gives a meeting without turns. Files beyond the upload limit are never loaded; `read_uploads` lists
    them, and those of other types, with the reason.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" + lx.UPLOAD_SUFFIX).load(path)
    raw = raw.where(F.col("length") <= lx.MAX_UPLOAD_BYTES)
    return raw.select(
        file_stem(lx.UPLOAD_SUFFIX).alias("meeting_id"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("raw_text"),
    )


def checked_uploads(files: DataFrame) -> DataFrame:
    """A3 on `(path, length, content)`: `error` for wrong type or size; otherwise the text, with invalid
    UTF-8 bytes replaced."""
    error = F.when(~F.col("path").endswith(lx.UPLOAD_SUFFIX), "Only .txt files are supported.").when(
        F.col("length") > lx.MAX_UPLOAD_BYTES, "File too large."
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_replace(name, r"\.txt$", "").alias("meeting_id"), "path", "length", error.alias("error"),
        F.when(error.isNull(), F.make_valid_utf8(F.col("content").cast("string"))).alias("raw_text"),
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """A3 over a landing folder of any files."""
    return checked_uploads(spark.read.format("binaryFile").load(path))


def new_transcripts(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """A4: a meeting has one transcript; uploads for one that has a transcript are left out."""
    return uploads.join(existing.select("meeting_id"), "meeting_id", "left_anti")


def conflicting_transcripts(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    return uploads.join(existing.select("meeting_id"), "meeting_id", "left_semi")


def _labelled(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*" + suffix).json(path)
        .withColumn("meeting_id", file_stem(suffix))
    )


def read_gold_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A meeting without a file simply has no rows."""
    return _labelled(spark, path, "_tasks_gold.json", schemas.GOLD_TASKS)


def read_gold_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A6."""
    return _labelled(spark, path, "_decisions_gold.json", schemas.GOLD_DECISIONS)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A7."""
    return _labelled(spark, path, "_tasks.json", schemas.TASKS)


STAGE_COLUMNS = {
    "processed": [
        "sentence_id", "turn_id", "speaker", "timestamp", "text", "root_verb", "object", "subject",
        "subject_resolved", "object_resolved", "triplet_confidence", "triplet_flags",
    ],
    "decisions": [
        "sentence_id", "speaker", "text", "root_verb", "object", "subject", "is_decision", "confidence", "method",
        "hard_filtered", "confidence_zone", "requires_manual_review", "transformer_decision_type",
        "transformer_confidence", "modal_boost", "downward_prior", "has_negation", "context_decision_type",
        "context_confidence", "is_turn_pair_acceptance", "paired_request_idx",
    ],
    "extractions": ["raw_text", "assignee", "deadline", "detection_confidence", "root_verb", "object", "evidence"],
    "outputs": ["task_id", "task", "assignee", "deadline", "confidence", "evidence", "requires_manual_review"],
}


def meeting_format(sentences: DataFrame, keep_metadata: bool = True) -> DataFrame:
    """C17: three columns, or all metadata the frame has."""
    names = STAGE_COLUMNS["processed"] if keep_metadata else ["sentence_id", "speaker", "text"]
    return sentences.select("meeting_id", *[c for c in names if c in sentences.columns])


def write_stage(df: DataFrame, stage: str, path: str, fmt: str = "json", per_meeting: bool = False) -> None:
    """A5: one stage's serialisable columns, with the meeting id.

    `per_meeting` writes a folder per meeting, which suits some hundred meetings; a large corpus would turn into
    as many small files, so by default rows of many meetings share files.
    """
    names = [c for c in STAGE_COLUMNS[stage] if c in df.columns]
    writer = df.select("meeting_id", *names).write.mode("overwrite").format(fmt)
    (writer.partitionBy("meeting_id") if per_meeting else writer).save(f"{path}/{stage}")


def write_contract(contract: DataFrame, path: str) -> None:
    """One JSON object per meeting; nulls are written, since both keys and all item fields are promised."""
    contract.write.mode("overwrite").option("ignoreNullFields", False).json(path)
