"""Fan-out of notifications and events, read marks, job state from a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.operators.board import job_progress


def recipients(projects: DataFrame) -> DataFrame:
    """One row per distinct owner, creator and member of a project."""
    people = F.array_compact(
        F.array_distinct(F.concat(F.array("owner_id", "created_by"), F.transform("members", lambda m: m["user_id"])))
    )
    return projects.select(F.col("id").alias("project_id"), F.explode(people).alias("user_id"))


def fan_out(messages: DataFrame, projects: DataFrame) -> DataFrame:
    """`messages(project_id, message, type, created_at)` to one unread row per recipient.

    The join meets each project once before its people are exploded, so a busy project shuffles its messages,
    not its messages times its members.
    """
    people = F.array_compact(
        F.array_distinct(F.concat(F.array("owner_id", "created_by"), F.transform("members", lambda m: m["user_id"])))
    )
    crowd = projects.select(F.col("id").alias("project_id"), people.alias("_people"))
    return (
        messages.join(crowd, "project_id")
        .withColumn("user_id", F.explode("_people"))
        .withColumn("read", F.lit(False))
        .drop("_people")
    )


def inbox(notifications: DataFrame, user_id) -> DataFrame:
    """Newest first."""
    return notifications.where(F.col("user_id") == F.lit(user_id)).orderBy(F.col("created_at").desc(), "id")


def unread_counts(notifications: DataFrame) -> DataFrame:
    """N2 for every user."""
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("unread"))


def mark_read(notifications: DataFrame, user_id, ids: DataFrame | None = None) -> DataFrame:
    """Mark the user's given (or all) notifications; `changed` tells which ones were unread before."""
    mine = F.col("user_id") == F.lit(user_id)
    if ids is not None:
        asked = ids.select(F.col(ids.columns[0]).alias("id"), F.lit(True).alias("_asked")).distinct()
        notifications = notifications.join(asked, "id", "left")
        mine = mine & F.col("_asked").isNotNull()
    changed = mine & ~F.col("read")
    return notifications.withColumn("changed", changed).withColumn("read", F.col("read") | F.col("changed")).drop("_asked")


def event(kind: str, **fields: Column) -> Column:
    """A JSON event."""
    payload = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))


def job_events(jobs: DataFrame) -> DataFrame:
    """Progress and completion events of jobs."""
    done = F.col("status") == "completed"
    updated = event(
        "processing_updated",
        jobId=F.col("id").cast("string"), status=F.col("status"), currentStep=F.col("current_step"),
        progress=job_progress(F.col("current_step")),
    )
    finished = event(
        "processing_completed", jobId=F.col("id").cast("string"), transcriptId=F.col("transcript_id").cast("string")
    )
    return jobs.select(
        F.col("id").alias("job_id"), "project_id",
        F.explode(F.array_compact(F.array(updated, F.when(done, finished)))).alias("event"),
    )


def task_events(tasks: DataFrame, kind: str = "task_created") -> DataFrame:
    return tasks.select(
        F.col("id").alias("task_id"), "project_id",
        event(
            kind, id=F.col("id").cast("string"), projectId=F.col("project_id").cast("string"),
            title=F.col("title"), status=F.col("status"), priority=F.col("priority"),
        ).alias("event"),
    )


def publish_events(published: DataFrame) -> DataFrame:
    """N3 of `published(project_id, transcript_id, task_ids, duplicates)`, one row per published transcript."""
    return published.select(
        "project_id", "transcript_id",
        event(
            "publish_completed", projectId=F.col("project_id").cast("string"), transcriptId=F.col("transcript_id").cast("string"),
            taskIds=F.col("task_ids"), count=F.size("task_ids"), duplicates=F.col("duplicates"),
        ).alias("event"),
    )


def deliver(events: DataFrame, people: DataFrame) -> DataFrame:
    """One row per event and recipient; `people` is `(project_id, user_id)` as of N1."""
    return events.join(people, "project_id")


def changed_count(marked: DataFrame) -> DataFrame:
    """How many notifications the marking changed."""
    return marked.agg(F.count_if("changed").alias("changed"))


def latest_job_state(log: DataFrame) -> DataFrame:
    """The last transition of every job, combined map-side."""
    row = F.struct(*[c for c in log.columns if c != "job_id"])
    return log.groupBy("job_id").agg(F.max_by(row, F.struct("updated_at", "seq")).alias("_r")).select("job_id", "_r.*")


def admit_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """N4, batch: one new job per transcript that has no active job; of several requests the first counts."""
    from gavel.operators.board import active_job_per_transcript

    fresh = requests.groupBy("transcript_id").agg(
        F.min_by(F.struct(*[c for c in requests.columns if c != "transcript_id"]), F.col("requested_at")).alias("_r")
    ).select("transcript_id", "_r.*")
    return fresh.join(active_job_per_transcript(jobs), "transcript_id", "left_anti")
