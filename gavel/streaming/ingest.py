"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gavel.plans.meeting_tasks import extract_tasks
from gavel.session import cut_lineage
from gavel.sources.files import checked_uploads

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def admitted(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of a transcript inside the watermark goes on, later ones are dropped.

    `requests` needs `transcript_id` and the event time `requested_at`.
    """
    return requests.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["transcript_id"])


def landing_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Uploads of any name as they arrive in a folder; each file is seen once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


@dataclass
class BatchLedger:
    """Tables in a folder that every batch of a stream adds to exactly once.

    A batch's rows of a table go to `<folder>/<table>/batch=<id>`, written anew when the batch is replayed; then
    `<folder>/_ledger/batch=<id>` commits it. Readers see the rows of committed batches only, and a committed
    batch is never written again, so a failure at any place neither loses nor repeats rows.
    """

    spark: SparkSession
    folder: str

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def committed(self, batch_id: int) -> bool:
        return self._exists(f"{self.folder}/_ledger/batch={batch_id}/_SUCCESS")

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch_id}")

    def commit(self, batch_id: int) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/_ledger/batch={batch_id}")

    def read(self, table: str) -> DataFrame | None:
        """Rows of all committed batches with their `batch`; None before the first one."""
        if not self._exists(f"{self.folder}/_ledger"):
            return None
        done = self.spark.read.parquet(f"{self.folder}/_ledger").select(F.col("batch").cast("long")).distinct()
        rows = self.spark.read.parquet(f"{self.folder}/{table}").withColumn("batch", F.col("batch").cast("long"))
        return rows.join(done, "batch", "left_semi")


def run_into_ledger(uploads: DataFrame, ledger: BatchLedger, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """N5 with its own sink: tables `tasks`, `rejects` and `meetings` of the ledger.

    A meeting that an earlier batch has taken keeps its first transcript (A4), as does one that a batch has several
    times (the first path); the others are rejects.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        if ledger.committed(batch_id):
            return
        checked = cut_lineage(checked_uploads(batch))
        sound = checked.where("error IS NULL")
        first = sound.groupBy("meeting_id").agg(F.min("path").alias("path"))
        known = ledger.read("meetings")
        if known is not None:
            first = first.join(known.select("meeting_id"), "meeting_id", "left_anti")
        first = cut_lineage(first)
        again = sound.join(first, ["meeting_id", "path"], "left_anti").withColumn("error", F.lit("Meeting already has a transcript."))
        ledger.write("tasks", extract_tasks(sound.join(first, ["meeting_id", "path"], "left_semi").select("meeting_id", "raw_text"), **options).tasks, batch_id)
        ledger.write("rejects", checked.where("error IS NOT NULL").unionByName(again).select("path", "length", "error"), batch_id)
        ledger.write("meetings", first, batch_id)
        ledger.commit(batch_id)

    writer = uploads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_transcripts(
    uploads: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
    rejects: Callable[[DataFrame, int], None] | None = None,
    **options,
) -> StreamingQuery:
    """Every upload runs through the plan once; `sink(tasks, batch_id)` stores a batch's tasks and
    `rejects(uploads, batch_id)` its refused uploads with path, length and reason.

    A transcript is complete in its file, so batches carry no state. A batch may be replayed after a failure;
    a sink that overwrites by batch id (or by meeting) makes the result exactly-once.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        checked = checked_uploads(batch)
        if rejects is not None:
            checked = cut_lineage(checked)  # read twice
        if rejects is not None:
            rejects(checked.where(F.col("error").isNotNull()).select("path", "length", "error"), batch_id)
        sound = checked.where(F.col("error").isNull()).select("meeting_id", "raw_text")
        sink(extract_tasks(sound, **options).tasks, batch_id)

    writer = uploads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_states(log: DataFrame) -> DataFrame:
    """Running last state per job; write it in update mode."""
    row = F.struct("updated_at", "status", "current_step")
    return log.groupBy("job_id").agg(F.max(row).alias("_r")).select("job_id", "_r.*")


def daily_counts(rows: DataFrame, time: str, kind: str, delay: str = "1 day") -> DataFrame:
    """Rows per calendar day and kind, with late rows accepted up to the delay."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("day"), kind, "n")
    )
