"""Queries over the task board: filters, pages, access scopes, lookups, board views.

Filters are plain column predicates, so they reach the scan; pages are `orderBy().offset().limit()`, which
Spark runs as a top-k per partition instead of a full sort. A requester is a parameter, members are embedded
arrays, and nothing is broadcast by hand: the planner broadcasts a side only below its own size threshold.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.text import strip


def filter_tasks(
    tasks: DataFrame,
    *,
    project_id=None,
    project_ids=None,
    team_id=None,
    meeting_id=None,
    assignee_id=None,
    owner_id=None,
    status: str | None = None,
    priority: str | None = None,
    due_before: date | str | None = None,
    due_after: date | str | None = None,
    is_manual: bool | None = None,
) -> DataFrame:
    """K1, K4: optional predicates, ANDed; date bounds are inclusive; one project wins over a project list.

    `project_ids` is a list or a frame with an `id` column (a semi join); an empty one gives no tasks.
    """
    equal = {
        "team_id": team_id, "meeting_id": meeting_id, "assignee_id": assignee_id, "owner_id": owner_id,
        "status": status, "priority": priority, "is_manual": is_manual,
    }
    if project_id is not None:
        equal["project_id"] = project_id
    elif isinstance(project_ids, DataFrame):
        tasks = tasks.join(project_ids.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    elif project_ids is not None:
        tasks = tasks.where(F.col("project_id").isin(list(project_ids)))
    for name, value in equal.items():
        if value is not None:
            tasks = tasks.where(F.col(name) == F.lit(value))
    if due_before is not None:
        tasks = tasks.where(F.col("due_date") <= F.lit(due_before).cast("date"))
    if due_after is not None:
        tasks = tasks.where(F.col("due_date") >= F.lit(due_after).cast("date"))
    return tasks


def page(df: DataFrame, sort_by: str = "created_at", descending: bool = True, skip: int = 0, limit: int = 50,
         tie: str = "id") -> DataFrame:
    """K2: a sorted page. Nulls sort as the smallest value; `tie` makes the order total."""
    key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_first()
    return df.orderBy(key, tie).offset(skip).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """K3."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def has_member(members: Column, user_id, role: str | None = None) -> Column:
    def test(m: Column) -> Column:
        hit = m["user_id"] == F.lit(user_id)
        return hit if role is None else hit & (m["role"] == role)

    return F.coalesce(F.exists(members, test), F.lit(False))


def teams_of(teams: DataFrame, user_id) -> DataFrame:
    return teams.where(has_member(F.col("members"), user_id))


def is_project_member(user_id) -> Column:
    """Owner, creator or embedded member."""
    return (
        F.coalesce(F.col("owner_id") == F.lit(user_id), F.lit(False))
        | F.coalesce(F.col("created_by") == F.lit(user_id), F.lit(False))
        | has_member(F.col("members"), user_id)
    )


def may_edit_task(user_id) -> Column:
    """Unowned tasks are open to project members; otherwise the owner only."""
    return F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(user_id))


def is_manager(role: Column) -> Column:
    return F.lower(F.coalesce(role, F.lit(""))) == "manager"


def accessible_projects(projects: DataFrame, teams: DataFrame, user_id, include_archived: bool = False) -> DataFrame:
    """K5: own, created, joined, or of one of the user's teams. The teams enter as a left join on a distinct
    key, so each project stays one row."""
    mine = teams_of(teams, user_id).select(F.col("id").alias("team_id"), F.lit(True).alias("_mine")).distinct()
    scoped = projects.join(mine, "team_id", "left").where(is_project_member(user_id) | F.col("_mine").isNotNull())
    return active(scoped, include_archived).select(*projects.columns)


def active(projects: DataFrame, include_archived: bool = False) -> DataFrame:
    return projects if include_archived else projects.where(~F.col("is_archived"))


def project_access(projects: DataFrame, teams: DataFrame) -> DataFrame:
    """K5 for everybody at once: distinct (user_id, project_id), for reports and row-level filters."""
    direct = projects.select(
        F.col("id").alias("project_id"),
        F.explode(
            F.array_compact(
                F.array_distinct(
                    F.concat(F.array("owner_id", "created_by"), F.transform("members", lambda m: m["user_id"]))
                )
            )
        ).alias("user_id"),
    )
    by_team = (
        teams.select(F.col("id").alias("team_id"), F.explode("members").alias("m"))
        .select("team_id", "m.user_id")
        .distinct()
        .join(projects.select("team_id", F.col("id").alias("project_id")), "team_id")
    )
    return direct.select("user_id", "project_id").union(by_team.select("user_id", "project_id")).distinct()


def scoped_tasks(tasks: DataFrame, projects: DataFrame, teams: DataFrame, user_id, **filters) -> DataFrame:
    """K6: without a project or a team the list is limited to the requester's projects."""
    if filters.get("project_id") is None and filters.get("team_id") is None:
        filters["project_ids"] = accessible_projects(projects, teams, user_id).select("id")
    return filter_tasks(tasks, **filters)


def projects_of_team(projects: DataFrame, team_id, include_archived: bool = False) -> DataFrame:
    """K7."""
    return active(projects.where(F.col("team_id") == F.lit(team_id)), include_archived)


def search_teams(teams: DataFrame, user_id, search: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """K8: the member's teams by name pattern, sorted by name; the page size stays within 1..100."""
    mine = teams_of(teams, user_id)
    if search and search.strip():
        mine = mine.where(F.col("name").rlike("(?i)" + search.strip()))
    return mine.orderBy("name", "id").offset(max(0, skip)).limit(max(1, min(limit, 100)))


def teams_with_owner(teams: DataFrame, users: DataFrame) -> DataFrame:
    """K9: first OWNER member and, where the account exists, its profile."""
    owner = F.get(F.filter("members", lambda m: m["role"] == "OWNER"), F.lit(0))["user_id"]
    profile = users.select(F.col("id").alias("_owner"), F.col("email").alias("owner_email"), F.col("full_name").alias("owner_name"))
    return teams.withColumn("_owner", owner).join(profile, "_owner", "left").select(
        *teams.columns, F.when(F.col("owner_email").isNotNull(), F.col("_owner")).alias("owner_id"), "owner_email", "owner_name"
    )


def member_details(teams: DataFrame, users: DataFrame) -> DataFrame:
    """One row per member with an account."""
    members = teams.select(F.col("id").alias("team_id"), F.explode("members").alias("m")).select(
        "team_id", "m.user_id", "m.role", "m.joined_at"
    )
    return members.join(users.select(F.col("id").alias("user_id"), "email", "full_name"), "user_id")


def meetings_page(meetings: DataFrame, skip: int = 0, limit: int = 50, **where) -> DataFrame:
    """Of a project or team, latest meeting date first, then latest creation."""
    for name, value in where.items():
        meetings = meetings.where(F.col(name) == F.lit(value))
    return meetings.orderBy(
        F.col("meeting_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id"
    ).offset(skip).limit(limit)


def transcripts_of_project(transcripts: DataFrame, meetings: DataFrame, project_id) -> DataFrame:
    """Newest first."""
    ids = meetings.where(F.col("project_id") == F.lit(project_id)).select(F.col("id").alias("meeting_id"))
    return transcripts.join(ids, "meeting_id", "left_semi").orderBy(F.col("created_at").desc(), "id")


def suggestions_of_meeting(suggestions: DataFrame, meeting_id, status: str | None = None) -> DataFrame:
    """K14."""
    found = suggestions.where(F.col("meeting_id") == F.lit(meeting_id))
    return found if status is None else found.where(F.col("review_status") == status)


def embedded(tasks: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    """Rows of an embedded array (evidence, subtasks, notes, status_history) with their position."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return tasks.select(F.col("id").alias("task_id"), explode(column).alias("position", "entry")).select(
        "task_id", "position", "entry.*"
    )


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """K16."""
    return users.where(F.col("email") == email).select("id", "email", "full_name", "role")


def users_by_email_part(users: DataFrame, part: str) -> DataFrame:
    """K17."""
    return users.where(F.contains(F.lower("email"), F.lit(part.lower())))


def duplicate_project_names(projects: DataFrame) -> DataFrame:
    """Team and normalised name used by more than one project."""
    return (
        projects.groupBy("team_id", F.lower(strip(F.col("name"))).alias("name_key"))
        .agg(F.count(F.lit(1)).alias("n_projects"), F.min("id").alias("first_id"))
        .where(F.col("n_projects") > 1)
    )


def name_taken(candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """Candidate rows whose name another project of the team already has; the candidate's own id does
    not count against it."""
    owners = projects.groupBy(F.col("team_id"), F.lower(strip(F.col("name"))).alias("_k")).agg(
        F.min("id").alias("_min"), F.max("id").alias("_max")
    )
    keyed = candidates.withColumn("_k", F.lower(strip(F.col("name"))))
    other = F.col("id").isNull() | (F.col("_min") != F.col("id")) | (F.col("_max") != F.col("id"))
    return keyed.join(owners, ["team_id", "_k"]).where(other).select(*candidates.columns)


def board_status(status: Column) -> Column:
    """K19."""
    value = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(value.isin("IN_PROGRESS", "IN-PR0GRESS", "IN_REVIEW"), "in-progress")
        .when(value.isin("DONE", "COMPLETED", "CANCELLED"), "completed")
        .otherwise("todo")
    )


def stored_status(status: Column) -> Column:
    """K19, the way back."""
    return F.when(status == "todo", "TODO").when(status == "in-progress", "IN_PROGRESS").when(status == "completed", "DONE")


def _named_month_date(text: Column) -> Column:
    """Dates with the month's name, before or after the day, with or without weekday and time: the date as it is written."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    month_first, day_first = r"^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})\b", r"^(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?,?[\s-]+(\d{4})\b"
    part = lambda a, b: F.when(plain.rlike(month_first), F.regexp_extract(plain, month_first, a)).otherwise(F.regexp_extract(plain, day_first, b))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in lx.MONTHS]), part(1, 2))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3, 3), month.cast("string"), part(2, 1)), "yyyy-M-d"))


def parse_deadline(text: Column) -> Column:
    """Yyyy-MM-dd, day-first with - or / in any mix, else an ISO timestamp or a date with the month's name; null when
    none fits, and for days that a month doesn't have."""
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{2}[-/]\d{2}[-/]\d{4}$"), F.try_to_date(F.translate(text, "/", "-"), "dd-MM-yyyy")),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(text).cast("date")),
        _named_month_date(text),
    )


def urgency(due: Column, as_of: date | str) -> Column:
    """K21."""
    days = F.datediff(due, F.lit(as_of).cast("date"))
    return F.when(days < 0, "overdue").when(days <= lx.NEAR_DAYS, "near").otherwise("default")


def board_filter(
    tasks: DataFrame,
    as_of: date | str,
    *,
    user_id=None,
    only_mine: bool = False,
    only_unassigned: bool = False,
    deadline_filter: str = "all",
    custom_date: date | str | None = None,
    due: str = "due_date",
) -> DataFrame:
    """K22. Tasks without a (valid) deadline pass only the 'all' filter and skip the custom-date check."""
    today = F.lit(as_of).cast("date")
    keep = F.lit(True)
    if only_mine:
        keep = keep & (F.lit(False) if user_id is None else F.coalesce(F.col("assignee_id") == F.lit(user_id), F.lit(False)))
    if only_unassigned:
        keep = keep & F.col("assignee_id").isNull()
    dated = F.lit(True)
    if custom_date is not None:
        dated = dated & (F.col(due) == F.lit(custom_date).cast("date"))
    if deadline_filter == "today":
        dated = dated & (F.col(due) == today)
    elif deadline_filter in ("near", "overdue"):
        dated = dated & (urgency(F.col(due), as_of) == deadline_filter)
    undated = F.lit(deadline_filter == "all")
    return tasks.where(keep & F.when(F.col(due).isNull(), undated).otherwise(dated))


def board_sort(tasks: DataFrame, ascending: bool = True, due: str = "due_date") -> DataFrame:
    """A missing deadline counts as the latest one."""
    key = F.col(due).asc_nulls_last() if ascending else F.col(due).desc_nulls_first()
    return tasks.orderBy(key, "id")


def board_positions(tasks: DataFrame, ascending: bool = True, due: str = "due_date") -> DataFrame:
    """K23 for tables of any size: `position` of each task in that order, equal deadlines sharing the first one.

    Counts per deadline are ordered, one row per day, so no task sorts the whole board."""
    key = F.col(due).asc_nulls_last() if ascending else F.col(due).desc_nulls_first()
    days = tasks.groupBy(due).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    placed = days.select(F.col(due).alias("_due"), (F.coalesce(before, F.lit(0)) + 1).alias("position"))
    return tasks.join(placed, F.col(due).eqNullSafe(F.col("_due"))).drop("_due")


def board_buckets(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the three lists."""
    return (
        tasks.groupBy(*by)
        .pivot("bucket", ["todo", "in-progress", "completed"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .withColumnRenamed("in-progress", "in_progress")
    )


def with_assignee_name(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """K25."""
    names = users.select(F.col("id").alias("assignee_id"), F.col("full_name").alias("assignee_name"))
    return tasks.join(names, "assignee_id", "left")


def merge_pages(pages: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """Append rows with unseen ids; the first page's row of an id wins, then the first in order."""
    both = pages.withColumn("_page", F.lit(0)).unionByName(more.withColumn("_page", F.lit(1)))
    row = F.struct(*[c for c in pages.columns if c != "id"])
    return both.groupBy("id").agg(F.min_by(row, F.struct("_page", order)).alias("_r")).select("id", "_r.*")


PROJECT_RESPONSE = {
    "id": "id", "teamId": "team_id", "ownerId": "owner_id", "name": "name", "description": "description", "isArchived": "is_archived",
    "createdBy": "created_by", "createdAt": "created_at", "updatedAt": "updated_at",
}
TASK_RESPONSE = {
    "id": "id", "projectId": "project_id", "teamId": "team_id", "meetingId": "meeting_id",
    "transcriptReference": "transcript_reference", "title": "title", "description": "description", "status": "status", "priority": "priority", "ownerId": "owner_id", "deadline": "due_date",
    "createdAt": "created_at", "updatedAt": "updated_at",
}
TRANSCRIPT_RESPONSE = {
    "id": "id", "meetingId": "meeting_id", "processingStatus": "processing_status", "errorMessage": "error_message",
    "createdAt": "created_at", "processedAt": "processed_at", "content": "raw_text", "summary": "_summary",
    "actionItemIds": "_ids", "actionItems": "_items",
}
NOTIFICATION_RESPONSE = {"id": "id", "message": "message", "type": "type", "read": "read", "createdAt": "created_at"}


def respond(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The outward column names."""
    return df.select(*[F.col(source).alias(name) for name, source in names.items()])


def project_response(projects: DataFrame) -> DataFrame:
    with_ids = projects.withColumn("_ids", F.transform("members", lambda m: m["user_id"]))
    return respond(with_ids, {**PROJECT_RESPONSE, "participantIds": "_ids"})


def task_response(tasks: DataFrame) -> DataFrame:
    ids = F.array_compact(F.array("assignee_id"))
    return respond(tasks.withColumn("_ids", ids), {**TASK_RESPONSE, "assigneeIds": "_ids"})


def transcript_response(transcripts: DataFrame) -> DataFrame:
    """`action_items` (structs with a `title`) and `action_item_ids` may be null; without a summary one is made
    of the number of items and the first three titles."""
    titles = F.transform(F.slice("action_items", 1, 3), lambda i: F.coalesce(i["title"], F.lit("Untitled")))
    made = F.concat(
        F.lit("Meeting produced "), F.size("action_items").cast("string"), F.lit(" action items. Key actions: "),
        F.array_join(titles, ", "), F.lit("."),
    )
    some = F.coalesce(F.size("action_items"), F.lit(0)) > 0
    return respond(
        transcripts.withColumns({
            "_summary": F.coalesce(F.nullif(F.col("summary_text"), F.lit("")), F.when(some, made), F.lit("")),
            "_ids": F.coalesce(F.col("action_item_ids").cast("array<string>"), F.array().cast("array<string>")),
            "_items": F.when(F.col("action_items").isNull(), F.filter(F.array(F.lit(None).cast(dict(transcripts.dtypes)["action_items"][6:-1])), lambda x: x.isNotNull())).otherwise(F.col("action_items")),
        }),
        TRANSCRIPT_RESPONSE,
    )


def notification_response(notifications: DataFrame) -> DataFrame:
    return respond(notifications, NOTIFICATION_RESPONSE)


def team_sizes(teams: DataFrame) -> DataFrame:
    """K29 and the owner count of K34."""
    return teams.select(
        "id", "name",
        F.size("members").alias("members"),
        F.size(F.filter("members", lambda m: m["role"] == "OWNER")).alias("owners"),
    )


def busy_requesters(jobs: DataFrame, limit: int = lx.MAX_ACTIVE_JOBS) -> DataFrame:
    """Requesters at their limit of active jobs."""
    return (
        jobs.where(F.col("status").isin(lx.ACTIVE_JOBS))
        .groupBy("requester_id")
        .agg(F.count(F.lit(1)).alias("active_jobs"))
        .where(F.col("active_jobs") >= limit)
    )


def active_job_per_transcript(jobs: DataFrame) -> DataFrame:
    """The first active job of each transcript."""
    return jobs.where(F.col("status").isin(lx.ACTIVE_JOBS)).groupBy("transcript_id").agg(F.min("id").alias("job_id"))


def job_progress(step: Column) -> Column:
    """Whole percent."""
    return F.floor(step / F.lit(lx.JOB_STEPS) * 100).cast("int")


def workspaces_of(workspaces: DataFrame, user_id) -> DataFrame:
    """K32."""
    return workspaces.where(has_member(F.col("members"), user_id))


def teams_of_workspaces(teams: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The teams of the given workspaces (`id`)."""
    return teams.join(workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi")


def slug_conflicts(workspaces: DataFrame) -> DataFrame:
    """K32."""
    return workspaces.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def lookup(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Point lookups for a frame of keys; `found` tells missing rows apart from rows of nulls."""
    return keys.join(table.withColumn("_hit", F.lit(True)), on, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def users_outside_team(users: DataFrame, teams: DataFrame, team_id, requester_id=None) -> DataFrame:
    """Accounts that are not yet members, without the requester."""
    members = (
        teams.where(F.col("id") == F.lit(team_id))
        .select(F.explode("members").alias("m"))
        .select(F.col("m.user_id").alias("id"))
    )
    rest = users.join(members, "id", "left_anti")
    return rest if requester_id is None else rest.where(F.col("id") != F.lit(requester_id))


def jobs_in(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Retryable or terminal jobs."""
    return jobs.where(F.col("status").isin(statuses))
