"""Changes to board tables as frames: what would change, and the table after the change.

Spark tables are rewritten, not updated in place, so each operator returns the new content (and, where the
caller needs it, a change set). Writers overwrite only the partitions the change touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions.text import strip
from gavel.operators.results import iso_date


def first_per_key(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """First row of each key by a grouped minimum: combined map-side, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, "_r.*").select(*df.columns)


def last_per_key(df: DataFrame, by: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, "_r.*").select(*df.columns)


def replace_pending(suggestions: DataFrame, items: DataFrame, dedup_titles: bool = True) -> DataFrame:
    """M1: pending suggestions of every transcript in `items` are replaced by its new items.

    `items` is `(transcript_id, pos, …)` with suggestion columns. With `dedup_titles` the first item of a
    case-insensitive title stays and blank titles are skipped; the other code path keeps all of them.
    """
    touched = items.select("transcript_id").distinct()
    fresh = items.withColumn("suggested_title", strip(F.col("suggested_title")) if dedup_titles else F.col("suggested_title"))
    if dedup_titles:
        fresh = first_per_key(
            fresh.where(F.coalesce("suggested_title", F.lit("")) != "").withColumn("_k", F.lower("suggested_title")),
            ["transcript_id", "_k"], "pos",
        ).drop("_k")
    fresh = fresh.withColumn("review_status", F.lit("PENDING")).drop("pos")
    settled = suggestions.where(F.col("review_status") != "PENDING")
    untouched = suggestions.where(F.col("review_status") == "PENDING").join(touched, "transcript_id", "left_anti")
    return settled.unionByName(untouched).unionByName(fresh, allowMissingColumns=True)


def publish_changes(
    tasks: DataFrame, items: DataFrame, valid_assignee: Column | None = None, rows: int | None = None
) -> DataFrame:
    """M2: the change set of publishing `items(transcript_id, pos, title, description, assignee, deadline)`
    against the non-manual tasks of the same transcripts.

    `action` is created, updated, unchanged or duplicate, one row per usable item. On a transcript's first
    publish the first of equal titles is created and the others are duplicates. On a later one an item whose
    title exists updates that task when description, assignee or deadline differ from what the previous item
    of the same title left behind, and is unchanged otherwise; a new title is created and then treated alike.
    The state before an item is a fill-forward over (transcript, title); `rows` as given by
    `ordered.segment_rows` splits it where one title is repeated without end.
    """
    incoming = _incoming(items, valid_assignee)
    published = tasks.where(~F.col("is_manual") & F.col("transcript_reference").isNotNull())
    existing = (
        published.where(F.coalesce(strip(F.col("title")), F.lit("")) != "")
        .groupBy(F.col("transcript_reference").alias("transcript_id"), F.lower(strip(F.col("title"))).alias("_k"))
        # of several tasks with one title the one read last counts
        .agg(F.max_by(_old_task(F.col("id")), F.col("id")).alias("_old"))
    )
    seen = published.select(F.col("transcript_reference").alias("transcript_id")).distinct().withColumn("_republish", F.lit(True))
    # The old task joins last: it isn't carried through the other join, and its keys deal the rows for the fill-forward, too.
    joined = incoming.join(seen, "transcript_id", "left").join(existing, ["transcript_id", "_k"], "left")

    stated = ordered.fill_forward(
        joined.withColumn("_state", _state()), ["transcript_id", "_k"], "pos", F.col("_state"), "_previous", rows
    )
    return (
        _acted(stated)
        .withColumn("title_key", F.col("_k"))
        .select("transcript_id", "pos", "title", "title_key", "description", "assignee_id", "due_date", "task_id", "action")
    )


def _incoming(items: DataFrame, valid_assignee: Column | None) -> DataFrame:
    """The usable items with their values as they are published; `_k`: the title that is compared."""
    title = strip(F.when(F.coalesce("title", F.lit("")) == "", lx.UNTITLED).otherwise(F.col("title")))
    ok_assignee = F.col("_a").rlike("^[0-9a-f]{24}$") if valid_assignee is None else valid_assignee
    return (
        items.withColumn("title", title)
        .where(F.col("title") != "")
        .withColumn("_k", F.lower("title"))
        .withColumn("_a", F.nullif(strip(F.col("assignee").cast("string")), F.lit("")))
        .withColumn("assignee_id", F.when(ok_assignee, F.col("_a")))
        .withColumn("due_date", iso_date(F.col("deadline")))
        .withColumn("description", F.coalesce("description", F.lit("")))
    )


def _state() -> Column:
    return F.struct(strip(F.col("description")).alias("d"), F.col("assignee_id").alias("a"), F.col("due_date").alias("u"))


def _old_task(id_: Column) -> Column:
    return F.struct(id_.alias("id"), "description", F.col("assignee_id").cast("string").alias("assignee_id"), "due_date")


def _acted(stated: DataFrame) -> DataFrame:
    """Add `action` and `task_id` to items with `_state`, `_previous`, `_old` and `_republish`."""
    old = F.struct(
        strip(F.coalesce(F.col("_old.description"), F.lit(""))).alias("d"), F.col("_old.assignee_id").alias("a"), F.col("_old.due_date").alias("u")
    )
    # What a title looked like before this item: the previous item's state, for the first one the old task's.
    prior = F.coalesce("_previous", F.when(F.col("_old").isNotNull(), old))
    action = (
        F.when(F.col("_old").isNull() & F.col("_previous").isNull(), "created")
        .when(~F.coalesce("_republish", F.lit(False)), "duplicate")
        .when(F.col("_state").eqNullSafe(F.col("_prior")), "unchanged")
        .otherwise("updated")
    )
    return stated.withColumn("_prior", prior).withColumn("action", action).withColumn("task_id", F.col("_old.id"))


def publish_counts(changes: DataFrame) -> DataFrame:
    """M2: per transcript, how many items led to which action; unchanged ones count as duplicates."""
    return changes.groupBy("transcript_id").agg(
        F.count_if(F.col("action") == "created").alias("created"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action").isin("unchanged", "duplicate")).alias("duplicates"),
    )


def apply_publish(tasks: DataFrame, changes: DataFrame, new_id: Column) -> DataFrame:
    """M2: the task table after publishing: untouched rows, updated rows, new rows.

    `new_id` builds the id of a created task from the change columns. The last effective item of a title
    decides its final state.
    """
    effective = changes.where(F.col("action").isin("created", "updated"))
    last = F.struct("description", "assignee_id", "due_date", "task_id")
    final = effective.groupBy("transcript_id", "title_key").agg(F.max_by(last, "pos").alias("_last"), F.min_by("title", "pos").alias("title"))
    kind = {f.name: f.dataType for f in tasks.schema}
    new, created = F.col("_last.task_id").isNull(), {
        "id": new_id.cast(kind["id"]), "transcript_reference": F.col("transcript_id").cast(kind["transcript_reference"]), "title": F.col("title"),
        "status": F.lit("TODO"), "priority": F.lit("MEDIUM"), "is_manual": F.lit(False),
    }
    updated = {"description": F.col("_last.description"), "assignee_id": F.col("_last.assignee_id").cast(kind["assignee_id"]), "due_date": F.col("_last.due_date")}
    # The changes are worked out once: one full join gives old, changed and new tasks. A new task has no old id and so
    # meets none; what it is spread by keeps new tasks from meeting in one place.
    revised = final.select(
        F.col("_last.task_id").alias("_old"), F.when(new, F.xxhash64("transcript_id", "title_key")).otherwise(F.lit(0)).alias("_spread"), F.lit(True).alias("_touched"),
        *[F.when(new, c).alias(f"_new_{name}") for name, c in created.items() if name in kind], *[c.alias(f"_new_{name}") for name, c in updated.items()],
    )
    before = tasks.withColumns({"_old": F.col("id"), "_spread": F.lit(0).cast("long"), "_there": F.lit(True)})
    is_new = F.col("_there").isNull()

    def value(name: str) -> Column:
        if name in updated:
            return F.when(F.col("_touched"), F.col(f"_new_{name}")).otherwise(F.col(name))
        old = F.col("_old" if name == "id" else name)
        return F.when(is_new, F.col(f"_new_{name}") if name in created else F.lit(None)).otherwise(old)

    both = before.join(revised, ["_old", "_spread"], "full")
    return both.select(*[value(c).alias(c) for c in tasks.columns])


def publish(tasks: DataFrame, items: DataFrame, new_id: Column, valid_assignee: Column | None = None, rows: int = ordered.SEGMENT_ROWS) -> DataFrame:
    """M2: the task table after publishing `items`: `apply_publish` of `publish_changes`, in one shuffle by transcript where it can be.

    Tasks that aren't published can't change and stay where they are; published ones travel with their transcript's items, and
    every row comes out where its title was compared. That takes ids that no two titles share (told by hashes of ids)
    and transcripts of no more than `rows` rows; else changes are worked out first and meet the tasks by id.
    """
    is_published = F.coalesce(~F.col("is_manual") & F.col("transcript_reference").isNotNull(), F.lit(False))
    key = F.lower(strip(F.col("title")))
    published = tasks.where(is_published)
    old, asked = published.select(F.col("transcript_reference").alias("transcript_id")), items.select("transcript_id")
    kind = {f.name: f.dataType for f in tasks.schema}
    alike = (
        kind["transcript_reference"] == asked.schema["transcript_id"].dataType and kind["description"] == StringType() and kind["due_date"] == DateType()
        and kind["assignee_id"] in (StringType(), IntegerType(), LongType())  # their texts give them back
    )
    # Where a task of this id can change: one title of one transcript, or nowhere.
    place = F.when(is_published & (F.coalesce(key, F.lit("")) != ""), F.xxhash64("transcript_reference", key)).otherwise(F.lit(0).cast("long"))
    places = tasks.where("id IS NOT NULL").select(F.xxhash64("id").alias("id"), place.alias("at")).groupBy("id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    if not alike or ordered.segment_rows(old.unionAll(asked), ["transcript_id"], rows) is not None or not places.where("a < b").isEmpty():
        changes = publish_changes(tasks, items, valid_assignee, ordered.segment_rows(items, ["transcript_id"], rows))
        return apply_publish(tasks, changes, new_id)

    shared = ["title", "description", "due_date", F.col("assignee_id").cast("string").alias("assignee_id")]
    own = [c for c in tasks.columns if c not in ("transcript_reference", "title", "description", "due_date", "assignee_id")]
    there = published.select(F.col("transcript_reference").alias("transcript_id"), *shared, *[F.col(c).alias(f"_t_{c}") for c in own], F.lit(False).alias("_item"))
    incoming = _incoming(items, valid_assignee).select("transcript_id", "pos", *shared, F.lit(True).alias("_item"))
    both = there.unionByName(incoming, allowMissingColumns=True)
    both = both.select(*sorted(both.columns, key=lambda c: (c == "title", both.schema[c].dataType == StringType())))  # numbers first: smaller when compressed
    both = both.withColumn("_republish", F.bool_or(~F.col("_item")).over(Window.partitionBy("transcript_id"))).withColumn("title_key", key)
    title = Window.partitionBy("transcript_id", "title_key").orderBy("_item", "pos")  # its tasks, then its items
    whole = title.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_task = lambda c: F.when(~F.col("_item"), c)
    stated = both.withColumn("_state", F.when(F.col("_item"), _state())).withColumns({
        "_old": F.max_by(of_task(_old_task(F.col("_t_id"))), of_task(F.col("_t_id"))).over(whole),
        "_previous": F.last("_state", ignorenulls=True).over(title.rowsBetween(Window.unboundedPreceding, -1)),
        "_end": F.lead(F.lit(1)).over(title).isNull(),
    })
    effective = F.col("_item") & F.col("action").isin("created", "updated")
    last = F.struct("description", "assignee_id", "due_date", "task_id")
    final = _acted(stated).withColumns({
        "_touched": F.bool_or(effective).over(whole),
        "_last": F.max_by(F.when(effective, last), F.when(effective, F.col("pos"))).over(whole),
        "_first": F.min_by(F.when(effective, F.col("title")), F.when(effective, F.col("pos"))).over(whole),
    })
    new = F.col("_item")  # a title without a task: its last row becomes one
    final = final.where(~new | (F.col("_end") & F.col("_touched") & F.col("_last.task_id").isNull())).withColumn("title", F.when(new, F.col("_first")).otherwise(F.col("title")))
    changed = new | F.coalesce(F.col("_touched") & (F.col("_t_id") == F.col("_last.task_id")), F.lit(False))
    created = {"id": new_id.cast(kind["id"]), "status": F.lit("TODO"), "priority": F.lit("MEDIUM"), "is_manual": F.lit(False)}

    def value(name: str) -> Column:
        if name in ("title", "transcript_reference"):
            return F.col("title" if name == "title" else "transcript_id")
        if name not in own:
            return F.when(changed, F.col(f"_last.{name}")).otherwise(F.col(name)).cast(kind[name])
        return F.when(new, created[name]).otherwise(F.col(f"_t_{name}")) if name in created else F.col(f"_t_{name}")

    return final.select(*[value(c).alias(c) for c in tasks.columns]).unionByName(tasks.where(~is_published))


def upsert_by_key(table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """M3, M4: non-null change values overwrite, missing rows are created. One change row per key."""
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = table.join(renamed, key, "full")
    return merged.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )


def update_by_key(table: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """M4, M6: like the upsert, without new rows."""
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    merged = table.join(renamed, key, "left")
    return merged.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns]
    )


def review_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """M5: apply `decisions(id, decision, title, description, due_date, reviewer)` to suggestions.

    Per decided suggestion: the new status, the error of a forbidden approval, and for a sound approval the
    task's values (the override, else the suggestion).
    """
    joined = suggestions.join(decisions, "id")
    rejected = (F.col("decision") == "approve") & (F.col("review_status") == "REJECTED")
    repeated = (F.col("decision") == "approve") & F.col("task_id").isNotNull()
    error = F.when(rejected, "Cannot approve a rejected suggestion.").when(repeated, "Suggestion has already been approved.")
    approved = (F.col("decision") == "approve") & F.col("error").isNull()
    status = (
        F.when(approved, "APPROVED")
        .when(F.col("decision") == "reject", "REJECTED")
        .when((F.col("decision") == "edit") & (F.col("review_status") == "PENDING"), "MODIFIED")
        .otherwise(F.col("review_status"))
    )
    override = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return (
        joined.withColumn("error", error)
        .select(
            "id", "meeting_id", "transcript_id", "decision", "error",
            status.alias("review_status"),
            F.when(approved | (F.col("decision") == "reject"), F.col("reviewer")).alias("reviewed_by"),
            F.when(approved, override("title", "suggested_title")).alias("task_title"),
            F.when(approved, override("description", "suggested_description")).alias("task_description"),
            F.when(approved, F.coalesce("due_date", "suggested_deadline")).alias("task_due_date"),
            F.when(approved, F.col("transcript_quote")).alias("evidence_quote"),
        )
    )


def approved_tasks(reviews: DataFrame, meetings: DataFrame, at: Column) -> DataFrame:
    """M5: the task row of every sound approval in `review_suggestions`' result.

    Project and team come from the meeting, the owner defaults to the reviewer, the quote becomes the first evidence
    and the status the first history entry. `task_of` names the row.
    """
    quote = F.struct(F.col("transcript_id"), F.col("evidence_quote").alias("quote"))
    by = F.col("reviewed_by")
    return reviews.where("decision = 'approve' AND error IS NULL").join(
        meetings.select(F.col("id").alias("meeting_id"), "project_id", "team_id"), "meeting_id"
    ).select(
        task_of(F.col("id")).alias("id"), "project_id", "team_id", "meeting_id", F.col("id").alias("task_suggestion_id"),
        F.col("transcript_id").alias("transcript_reference"), F.col("task_title").alias("title"), F.col("task_description").alias("description"),
        F.lit("TODO").alias("status"), F.lit("MEDIUM").alias("priority"), by.alias("owner_id"), F.col("task_due_date").alias("due_date"),
        by.alias("created_by"), F.lit(False).alias("is_manual"), F.array_compact(F.array(F.when(F.coalesce("evidence_quote", F.lit("")) != "", quote))).alias("evidence"),
        F.array(history_entry(F.lit(None), F.lit("TODO"), by, at)).alias("status_history"),
    )


def task_of(suggestion_id: Column) -> Column:
    return F.concat(F.lit("task-"), suggestion_id.cast("string"))


def reviewed_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """M5: the suggestions after their review, with the new status, reviewer and task; an edit applies its fields."""
    reviews = review_suggestions(suggestions, decisions).select(
        "id", F.col("error").isNull().alias("_sound"), "decision", F.col("review_status").alias("_status"), F.col("reviewed_by").alias("_by")
    )
    edits = decisions.where("decision = 'edit'").select("id", F.col("title").alias("_title"), F.col("description").alias("_description"), F.col("due_date").alias("_due"))
    joined = suggestions.join(reviews, "id", "left").join(edits, "id", "left")
    new = {
        "review_status": F.coalesce("_status", "review_status"),
        "task_id": F.when((F.col("decision") == "approve") & F.col("_sound"), task_of(F.col("id"))).otherwise(F.col("task_id")),
        "suggested_title": F.coalesce("_title", "suggested_title"), "suggested_description": F.coalesce("_description", "suggested_description"),
        "suggested_deadline": F.coalesce("_due", "suggested_deadline"),
    }
    return joined.withColumns(new).select(*suggestions.columns, F.col("_by").alias("reviewed_by"))


def history_entry(old: Column, new: Column, by: Column, at: Column) -> Column:
    return F.struct(
        old.cast("string").alias("old_status"), new.alias("new_status"), by.alias("changed_by"), at.alias("changed_at")
    )


def initial_history(new: Column, by: Column, at: Column) -> Column:
    """M7."""
    return F.array(history_entry(F.lit(None), new, by, at))


def update_tasks(tasks: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """M6: non-null fields of `changes(id, …, changed_by, changed_at)` apply; a changed status is appended to
    the history."""
    renamed = changes.select(
        "id", *[F.col(c).alias(f"_new_{c}") for c in columns], F.col("changed_by").alias("_by"), F.col("changed_at").alias("_at")
    )
    merged = tasks.join(renamed, "id", "left")
    if "status" in columns:
        moved = F.col("_new_status").isNotNull() & (F.col("_new_status") != F.col("status"))
        entry = history_entry(F.col("status"), F.col("_new_status"), F.col("_by"), F.col("_at"))
        merged = merged.withColumn(
            "status_history", F.when(moved, F.array_append("status_history", entry)).otherwise(F.col("status_history"))
        )
    return merged.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in tasks.columns]
    )


def append_entries(table: DataFrame, additions: DataFrame, column: str) -> DataFrame:
    """M8: append `additions(id, pos, entry)` to an embedded array, in `pos` order."""
    grouped = additions.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda s: s["entry"]).alias("_add")
    )
    empty = F.slice(F.col(column), 1, 0)
    return table.join(grouped, "id", "left").withColumn(
        column, F.concat(F.col(column), F.coalesce("_add", empty))
    ).drop("_add")


def patch_entries(table: DataFrame, patches: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """M8: overwrite non-null `fields` of the embedded entry named by `patches(id, entry_id, …)`; one patch
    per (id, entry)."""
    grouped = patches.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("entry_id", F.struct(*fields)))).alias("_patch")
    )
    names = [f.name for f in table.schema[column].dataType.elementType]

    def patched(entry: Column) -> Column:
        new = F.try_element_at("_patch", entry["id"])
        return F.struct(
            *[(F.coalesce(new[n], entry[n]) if n in fields else entry[n]).alias(n) for n in names]
        )

    return table.join(grouped, "id", "left").withColumn(
        column, F.when(F.col("_patch").isNull(), F.col(column)).otherwise(F.transform(column, patched))
    ).drop("_patch")


def change_members(table: DataFrame, changes: DataFrame) -> DataFrame:
    """M9: apply `changes(id, op, user_id, role, joined_at)`, one per row of the table, to `members`.

    `error` reports adding a member twice, removing or re-ranking a stranger, and removing the owner.
    """
    joined = table.join(
        changes.select("id", "op", F.col("user_id").alias("_user"), F.col("role").alias("_role"), F.col("joined_at").alias("_at")), "id"
    )
    inside = F.coalesce(F.exists("members", lambda m: m["user_id"] == F.col("_user")), F.lit(False))
    owner = F.coalesce(F.col("owner_id") == F.col("_user"), F.lit(False)) if "owner_id" in table.columns else F.lit(False)
    error = (
        F.when((F.col("op") == "add") & inside, "User is already a member.")
        .when((F.col("op") == "remove") & owner, "Owner cannot be removed.")
        .when((F.col("op") != "add") & ~inside, "Member not found.")
    )
    entry = F.struct(F.col("_user").alias("user_id"), F.col("_role").alias("role"), F.col("_at").alias("joined_at"))
    members = (
        F.when(F.col("error").isNotNull(), F.col("members"))
        .when(F.col("op") == "add", F.array_append("members", entry))
        .when(F.col("op") == "remove", F.filter("members", lambda m: m["user_id"] != F.col("_user")))
        .otherwise(
            F.transform(
                "members",
                lambda m: F.struct(
                    m["user_id"].alias("user_id"),
                    F.when(m["user_id"] == F.col("_user"), F.col("_role")).otherwise(m["role"]).alias("role"),
                    m["joined_at"].alias("joined_at"),
                ),
            )
        )
    )
    return joined.withColumn("error", error).withColumn("members", members).select(*table.columns, "op", "error")


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Drop rows by key."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def delete_meetings(meetings: DataFrame, transcripts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meetings and, with them, their transcripts."""
    return delete_rows(meetings, ids), delete_rows(transcripts, ids, "meeting_id")


def delete_tasks(tasks: DataFrame, ids: DataFrame, requester) -> DataFrame:
    """Only the owner deletes an owned task. Tasks that the requester may not delete stay whatever is asked, so they
    are not joined; of the others only those not asked for are kept."""
    asked = ids.select(F.col(ids.columns[0]).alias("id"))
    allowed = F.coalesce(F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(requester)), F.lit(False))
    return tasks.where(~allowed).unionByName(tasks.where(allowed).join(asked, "id", "left_anti"))


def clean_up(table: DataFrame, pattern: str = lx.CLEANUP_NAMES) -> DataFrame:
    """M11."""
    return table.where(~F.coalesce(F.col("name").rlike(pattern), F.lit(False)))


def cleaned_count(table: DataFrame, pattern: str = lx.CLEANUP_NAMES) -> DataFrame:
    return table.agg(F.count_if(F.col("name").rlike(pattern)).alias("deleted"))


def sync_by_position(tasks: DataFrame, edits: DataFrame, order: str = "id", shares: int = 64) -> DataFrame:
    """The n-th task of a transcript takes the n-th edited item `(transcript_id, pos)`, `pos` from 1.

    Only the first tasks of a transcript, as many as it has edited positions, can change. They are found in
    two steps, first inside `shares` random shares of the transcript's tasks, then among the few that are left, so that
    a transcript of any size is ranked in parallel.
    """
    reach = edits.groupBy(F.col("transcript_id").alias("transcript_reference")).agg(F.max("pos").alias("_reach"))
    asked = tasks.join(reach, "transcript_reference", "left").withColumn("_share", F.pmod(F.xxhash64(order), F.lit(shares)))
    share = Window.partitionBy("transcript_reference", "_share").orderBy(order)
    first = asked.withColumn("_rank", F.row_number().over(share)).withColumn(
        "_near", F.coalesce(F.col("_rank") <= F.col("_reach"), F.lit(False))
    )
    w = Window.partitionBy("transcript_reference").orderBy(order)
    numbered = first.where("_near").withColumn("pos", F.row_number().over(w))
    item = edits.select(
        F.col("transcript_id").alias("transcript_reference"), "pos",
        F.struct("title", "description", "assignee", "deadline").alias("_item"),
    )
    joined = numbered.join(item, ["transcript_reference", "pos"], "left")
    has = F.col("_item").isNotNull()
    kind = {f.name: f.dataType for f in tasks.schema}
    edited = (
        joined.withColumn("title", F.when(has, F.coalesce(F.nullif(strip(F.col("_item.title")), F.lit("")), F.col("title"))).otherwise(F.col("title")))
        .withColumn("description", F.when(has, F.coalesce(strip(F.col("_item.description")), F.col("description"))).otherwise(F.col("description")))
        .withColumn("due_date", F.when(has, F.coalesce(iso_date(F.col("_item.deadline")), F.col("due_date"))).otherwise(F.col("due_date")))
        .withColumn("assignee_id", F.when(has, F.nullif(F.col("_item.assignee"), F.lit("")).cast(kind["assignee_id"])).otherwise(F.col("assignee_id")))
        .select(*tasks.columns)
    )
    return first.where(~F.col("_near")).select(*tasks.columns).unionByName(edited)


def default_meetings(uploads: DataFrame, meetings: DataFrame) -> DataFrame:
    """New meeting rows for uploads that name no (existing) meeting; the upload id names the meeting."""
    known = meetings.select(F.col("id").alias("meeting_id"), F.lit(True).alias("_known"))
    return (
        uploads.join(known, "meeting_id", "left")
        .where(F.col("_known").isNull())
        .select(
            F.col("upload_id").alias("id"), "project_id", F.lit(lx.UPLOAD_MEETING_TITLE).alias("title"), F.col("uploaded_by").alias("created_by")
        )
    )


def create_projects(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """`requests(request_id, team_id, name, creator_id)` -> created or conflict.

    Names are trimmed; a name the team already has conflicts, and of several equal requests the first wins.
    """
    named = requests.withColumn("name", strip(F.col("name"))).withColumn("_k", F.lower("name"))
    taken = projects.select("team_id", F.lower(strip(F.col("name"))).alias("_k")).distinct().withColumn("_taken", F.lit(True))
    firsts = named.groupBy("team_id", "_k").agg(F.min("request_id").alias("_first"))
    joined = named.join(taken, ["team_id", "_k"], "left").join(firsts, ["team_id", "_k"])
    free = F.col("_taken").isNull() & (F.col("request_id") == F.col("_first"))
    return joined.select(
        "request_id", "team_id", "name", F.col("creator_id").alias("owner_id"),
        F.when(free, "created").otherwise("conflict").alias("outcome"),
    )


def create_teams(requests: DataFrame, at: Column) -> DataFrame:
    """Team rows of `requests(id, workspace_id, name, description, creator_id)`; the creator is the first owner."""
    return requests.select(
        "id", "workspace_id", "name", "description", F.col("creator_id").alias("created_by"), new_team_members(F.col("creator_id"), at).alias("members")
    )


def new_team_members(creator: Column, at: Column) -> Column:
    """A new team's creator is its first owner."""
    return F.array(F.struct(creator.alias("user_id"), F.lit("OWNER").alias("role"), at.alias("joined_at")))
