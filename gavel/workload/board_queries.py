"""Queries over board tables (inventory A9, A10, K, L, M, N).

The board is a view of the given tables: customers are users, suppliers teams, parts projects, orders
meetings and transcripts, line items tasks and suggestions, events jobs and notifications.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions import text as tx
from gavel.operators import board, mutations, notifications, results
from gavel.sources import collections
from gavel.workload import checks as ck
from gavel.workload.bank import PHRASES, _pick
from gavel.workload.registry import query, table

ME = 42
TEAM = 7
AS_OF = "1998-06-15"
STATUSES = lx.TASK_STATUSES
PRIORITIES = lx.TASK_PRIORITIES

USERS = (
    "users AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@mail.test' AS email, 'User ' || c_custkey AS full_name, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Manager' ELSE 'member' END AS role FROM customer)"
)
TEAMS = (
    "teams AS (SELECT s_suppkey AS id, s_nationkey AS workspace_id, CASE WHEN s_suppkey % 9 = 0 THEN 'TEST ' ELSE '' END || s_name AS name, s_suppkey * 3 % 1500 AS created_by FROM supplier), "
    "team_members AS (SELECT s_suppkey AS team_id, k, (s_suppkey * 31 + k * 7) % 2000 AS user_id, CASE WHEN (s_suppkey + k) % 5 = 0 THEN 'OWNER' ELSE 'MEMBER' END AS role, "
    "k * 10 AS joined_at FROM supplier, range(4) r(k))"
)
PROJECTS = (
    "projects AS (SELECT p_partkey AS id, p_partkey % 100 AS team_id, p_partkey * 13 % 1500 AS owner_id, p_partkey * 17 % 1500 AS created_by, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' || upper(p_name) END AS name, p_size < 10 AS is_archived, p_partkey AS created_at, p_partkey + 1 AS updated_at FROM part), "
    "project_members AS (SELECT p_partkey AS project_id, k, (p_partkey * 7 + k * 11) % 1500 AS user_id FROM part, range(3) r(k))"
)
MEETINGS = (
    "meetings AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_custkey % 50 AS team_id, 'Meeting ' || o_orderkey AS title, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS meeting_date, o_orderkey * 7 % 1000 AS created_at, o_totalprice FROM orders)"
)
TASKS = (
    f"tasks AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_partkey AS project_id, l_suppkey AS team_id, l_orderkey AS meeting_id, l_orderkey AS transcript_reference, "
    f"{ck._TEXT}[l_partkey % 64 + 1] AS title, 'from line ' || l_linenumber AS description, ({ck.sql_list(STATUSES)})[(l_orderkey + l_linenumber) % 6 + 1] AS status, "
    f"({ck.sql_list(PRIORITIES)})[l_linenumber % 4 + 1] AS priority, CASE WHEN l_quantity >= 10 THEN (l_partkey * 3 + l_suppkey) % 1500 END AS assignee_id, "
    "CASE WHEN l_tax > 0 THEN l_suppkey * 7 % 1500 END AS owner_id, CASE WHEN l_discount > 0 THEN CAST(l_shipdate AS DATE) END AS due_date, l_returnflag = 'R' AS is_manual, "
    "CAST(l_shipdate AS DATE) AS created_at FROM lineitem)"
)
JOBS = (
    "jobs AS (SELECT event_id AS id, event_id // 3 AS transcript_id, user_id AS requester_id, event_id % 2000 AS project_id, "
    "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'timeout' END AS status, "
    "event_id % 7 AS current_step, ts FROM events)"
)
NOTES = (
    "notes AS (SELECT event_id AS id, user_id, 'Note ' || event_id AS message, event_type AS type, value > 10 AS read, ts AS created_at FROM events)"
)


def cents():
    """Part of a line item's key: order, line, part and supplier alone may repeat."""
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def users(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.test")).alias("email"),
        F.concat(F.lit("User "), "c_custkey").alias("full_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Manager").otherwise("member").alias("role"),
    )


def teams(spark, sf):
    s = F.col("s_suppkey")
    members = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.struct(
            ((s * 31 + k * 7) % 2000).alias("user_id"),
            F.when((s + k) % 5 == 0, "OWNER").otherwise("MEMBER").alias("role"),
            (k * 10).cast("long").alias("joined_at"),
        ),
    )
    return table(spark, sf, "supplier").select(
        s.alias("id"), F.col("s_nationkey").alias("workspace_id"),
        F.concat(F.when(s % 9 == 0, "TEST ").otherwise(""), "s_name").alias("name"), (s * 3 % 1500).alias("created_by"), members.alias("members"),
    )


def projects(spark, sf):
    p = F.col("p_partkey")
    members = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda k: F.struct(
            ((p * 7 + k * 11) % 1500).alias("user_id"), F.lit("MEMBER").alias("role"), k.cast("long").alias("joined_at")
        ),
    )
    return table(spark, sf, "part").select(
        p.alias("id"), (p % 100).alias("team_id"), (p * 13 % 1500).alias("owner_id"), (p * 17 % 1500).alias("created_by"),
        F.when(p % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("name"),
        (F.col("p_size") < 10).alias("is_archived"), p.alias("created_at"), (p + 1).alias("updated_at"), members.alias("members"),
    )


def meetings(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("id"), F.col("o_custkey").alias("project_id"), (F.col("o_custkey") % 50).alias("team_id"), F.concat(F.lit("Meeting "), o).alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("meeting_date"), (o * 7 % 1000).alias("created_at"), "o_totalprice",
    )


def tasks(spark, sf):
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", o, n, p, s, cents()).alias("id"), p.alias("project_id"), s.alias("team_id"), o.alias("meeting_id"), o.alias("transcript_reference"),
        _pick(PHRASES, p % 64).alias("title"), F.concat(F.lit("from line "), n).alias("description"), _pick(STATUSES, (o + n) % 6).alias("status"),
        _pick(PRIORITIES, n % 4).alias("priority"), F.when(F.col("l_quantity") >= 10, (p * 3 + s) % 1500).alias("assignee_id"),
        F.when(F.col("l_tax") > 0, s * 7 % 1500).alias("owner_id"), F.when(F.col("l_discount") > 0, F.col("l_shipdate").cast("date")).alias("due_date"),
        (F.col("l_returnflag") == "R").alias("is_manual"), F.col("l_shipdate").cast("date").alias("created_at"),
    )


def jobs(spark, sf):
    e, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        e.alias("id"), F.floor(e / 3).alias("transcript_id"), F.col("user_id").alias("requester_id"), (e % 2000).alias("project_id"),
        F.when(kind == "click", "running").when(kind == "view", "completed").when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("timeout").alias("status"),
        (e % 7).alias("current_step"), "ts",
    )


def notes(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("Note "), "event_id").alias("message"), F.col("event_type").alias("type"),
        (F.col("value") > 10).alias("read"), F.col("ts").alias("created_at"),
    )


SHORT = "id, project_id, title, status, priority, assignee_id, due_date"
SHORT_COLUMNS = SHORT.split(", ")
MY_TEAMS = f"my_teams AS (SELECT DISTINCT team_id FROM team_members WHERE user_id = {ME})"
MINE = (
    f"mine AS (SELECT * FROM projects p WHERE (owner_id = {ME} OR created_by = {ME} OR EXISTS (SELECT 1 FROM project_members m WHERE m.project_id = p.id AND m.user_id = {ME}) "
    "OR team_id IN (SELECT team_id FROM my_teams)))"
)

# --- A9, A10, K1-K4 ------------------------------------------------------------------------------------


@query(
    "listing_a10",
    ck.with_ctes(TASKS, select="SELECT id, substr(title, 1, 50) AS label, status FROM tasks"),
)
def listing(spark, sf):
    return collections.listing(tasks(spark, sf), "title", 50, "status")


@query(
    "collection_save_a9",
    ck.with_ctes(USERS, select="SELECT id, email, CASE WHEN role = 'Manager' THEN 'Renamed' ELSE full_name END AS full_name, role FROM users "
                 "UNION ALL SELECT -1 - s_suppkey, 'new@mail.test', s_name, 'member' FROM supplier"),
)
def collection_save(spark, sf):
    rows = users(spark, sf)
    changed = rows.where(F.col("role") == "Manager").withColumn("full_name", F.lit("Renamed"))
    fresh = table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("id"), F.lit("new@mail.test").alias("email"), F.col("s_name").alias("full_name"), F.lit("member").alias("role")
    )
    return collections.save(rows, changed.unionByName(fresh))


@query(
    "task_filter_k1",
    ck.with_ctes(
        TASKS,
        select=f"SELECT {SHORT} FROM tasks WHERE status = 'TODO' AND priority = 'HIGH' AND due_date >= DATE '1996-01-01' AND due_date <= DATE '1999-12-31' AND NOT is_manual",
    ),
)
def task_filter(spark, sf):
    return board.filter_tasks(
        tasks(spark, sf), status="TODO", priority="HIGH", due_after="1996-01-01", due_before="1999-12-31", is_manual=False
    ).select(*SHORT_COLUMNS)


@query(
    "task_page_k2",
    ck.with_ctes(TASKS, select=f"SELECT {SHORT} FROM tasks ORDER BY due_date DESC NULLS LAST, id LIMIT 50 OFFSET 100"),
)
def task_page(spark, sf):
    return board.page(tasks(spark, sf), "due_date", True, 100, 50).select(*SHORT_COLUMNS)


@query(
    "task_page_ascending_k2",
    ck.with_ctes(TASKS, select=f"SELECT {SHORT} FROM tasks ORDER BY assignee_id ASC NULLS FIRST, id LIMIT 40 OFFSET 20"),
)
def task_page_ascending(spark, sf):
    return board.page(tasks(spark, sf), "assignee_id", False, 20, 40).select(*SHORT_COLUMNS)


@query("task_count_k3", ck.with_ctes(TASKS, select="SELECT count(*) AS total FROM tasks WHERE status = 'DONE' AND is_manual"))
def task_count(spark, sf):
    return board.total(board.filter_tasks(tasks(spark, sf), status="DONE", is_manual=True))


@query("my_tasks_k4", ck.with_ctes(TASKS, select=f"SELECT {SHORT} FROM tasks WHERE assignee_id = {ME} AND priority = 'LOW'"))
def my_tasks(spark, sf):
    return board.filter_tasks(tasks(spark, sf), assignee_id=ME, priority="LOW").select(*SHORT_COLUMNS)


# --- K5-K11 --------------------------------------------------------------------------------------------


@query(
    "accessible_projects_k5",
    ck.with_ctes(TEAMS, PROJECTS, MY_TEAMS, MINE, select="SELECT id, team_id, name FROM mine WHERE NOT is_archived"),
)
def accessible_projects(spark, sf):
    return board.accessible_projects(projects(spark, sf), teams(spark, sf), ME).select("id", "team_id", "name")


@query(
    "project_access_k5",
    ck.with_ctes(
        TEAMS, PROJECTS,
        select="SELECT user_id, count(*) AS n_projects FROM (SELECT owner_id AS user_id, id FROM projects UNION SELECT created_by, id FROM projects "
        "UNION SELECT user_id, project_id FROM project_members UNION SELECT t.user_id, p.id FROM team_members t JOIN projects p USING (team_id)) GROUP BY user_id",
    ),
)
def project_access(spark, sf):
    access = board.project_access(projects(spark, sf), teams(spark, sf))
    return access.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_projects"))


@query(
    "scoped_tasks_k6",
    ck.with_ctes(TEAMS, PROJECTS, TASKS, MY_TEAMS, MINE, select=f"SELECT {SHORT} FROM tasks WHERE project_id IN (SELECT id FROM mine WHERE NOT is_archived)"),
)
def scoped_tasks(spark, sf):
    return board.scoped_tasks(tasks(spark, sf), projects(spark, sf), teams(spark, sf), ME).select(*SHORT_COLUMNS)


@query("team_projects_k7", ck.with_ctes(PROJECTS, select=f"SELECT id, name, is_archived FROM projects WHERE team_id = {TEAM} AND NOT is_archived"))
def team_projects(spark, sf):
    return board.projects_of_team(projects(spark, sf), TEAM).select("id", "name", "is_archived")


@query(
    "team_search_k8",
    ck.with_ctes(
        TEAMS,
        select="SELECT t.id, t.name FROM teams t JOIN (SELECT DISTINCT team_id FROM team_members WHERE user_id = 38) m ON m.team_id = t.id WHERE regexp_matches(name, 'supplier', 'i') ORDER BY name, id LIMIT 100",
    ),
)
def team_search(spark, sf):
    return board.search_teams(teams(spark, sf), 38, " supplier ", 0, 500).select("id", "name")


@query(
    "team_owners_k9",
    ck.with_ctes(
        USERS, TEAMS,
        "owners AS (SELECT team_id, arg_min(user_id, k) AS user_id FROM team_members WHERE role = 'OWNER' GROUP BY 1)",
        select="SELECT t.id, t.name, u.id AS owner_id, u.email AS owner_email, u.full_name AS owner_name FROM teams t LEFT JOIN owners o ON o.team_id = t.id LEFT JOIN users u ON u.id = o.user_id",
    ),
)
def team_owners(spark, sf):
    return board.teams_with_owner(teams(spark, sf), users(spark, sf)).select("id", "name", "owner_id", "owner_email", "owner_name")


@query(
    "member_details_k10",
    ck.with_ctes(USERS, TEAMS, select="SELECT team_id, user_id, m.role, joined_at, email, full_name FROM team_members m JOIN users u ON u.id = m.user_id"),
)
def member_details(spark, sf):
    return board.member_details(teams(spark, sf), users(spark, sf)).select("team_id", "user_id", "role", "joined_at", "email", "full_name")


@query(
    "edit_rights_k11",
    ck.with_ctes(
        USERS, TASKS, PROJECTS,
        select=f"SELECT t.id, (owner_id IS NULL OR owner_id = 35) AS may_edit, coalesce(lower(u.role) = 'manager', false) AS by_manager FROM tasks t LEFT JOIN users u ON u.id = t.assignee_id",
    ),
)
def edit_rights(spark, sf):
    roles = users(spark, sf).select(F.col("id").alias("assignee_id"), "role")
    return tasks(spark, sf).join(roles, "assignee_id", "left").select(
        "id", board.may_edit_task(35).alias("may_edit"), board.is_manager(F.col("role")).alias("by_manager")
    )


# --- K12-K18 -------------------------------------------------------------------------------------------


@query(
    "meeting_page_k12",
    ck.with_ctes(MEETINGS, select="SELECT id, title, meeting_date FROM meetings WHERE team_id = 7 ORDER BY meeting_date DESC NULLS LAST, created_at DESC, id LIMIT 30 OFFSET 10"),
)
def meeting_page(spark, sf):
    return board.meetings_page(meetings(spark, sf), 10, 30, team_id=7).select("id", "title", "meeting_date")


@query(
    "project_transcripts_k13",
    ck.with_ctes(
        MEETINGS, "docs AS (SELECT doc_id AS id, doc_id AS meeting_id, n_chars AS created_at FROM documents)",
        select="SELECT id, created_at FROM docs WHERE meeting_id IN (SELECT id FROM meetings WHERE project_id < 200 AND project_id = 77 OR project_id = 78) ORDER BY created_at DESC, id",
    ),
)
def project_transcripts(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("meeting_id"), F.col("n_chars").alias("created_at")
    )
    m = meetings(spark, sf).withColumn("project_id", F.when(F.col("project_id").isin(77, 78), 77).otherwise(0))
    return board.transcripts_of_project(docs, m, 77).select("id", "created_at")


SUGGESTIONS = (
    f"suggestions AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_orderkey AS meeting_id, l_orderkey AS transcript_id, {ck._TEXT}[l_partkey % 64 + 1] AS suggested_title, "
    f"'about ' || l_partkey AS suggested_description, ({ck.sql_list(lx.REVIEW_STATUSES)})[l_linenumber % 4 + 1] AS review_status, CASE WHEN l_linenumber % 4 = 1 THEN 'task' || l_partkey END AS task_id, "
    "CASE WHEN l_discount > 0 THEN CAST(l_shipdate AS DATE) END AS suggested_deadline, CASE WHEN l_tax > 0.04 THEN 'quote ' || l_suppkey END AS transcript_quote FROM lineitem)"
)


def suggestions(spark, sf):
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", o, n, p, s, cents()).alias("id"), o.alias("meeting_id"), o.alias("transcript_id"), _pick(PHRASES, p % 64).alias("suggested_title"),
        F.concat(F.lit("about "), p).alias("suggested_description"), _pick(lx.REVIEW_STATUSES, n % 4).alias("review_status"),
        F.when(n % 4 == 1, F.concat(F.lit("task"), p)).alias("task_id"), F.when(F.col("l_discount") > 0, F.col("l_shipdate").cast("date")).alias("suggested_deadline"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("quote "), s)).alias("transcript_quote"),
    )


@query(
    "meeting_suggestions_k14",
    ck.with_ctes(SUGGESTIONS, select="SELECT id, suggested_title FROM suggestions WHERE meeting_id = 100 AND review_status = 'PENDING' UNION ALL SELECT id, suggested_title FROM suggestions WHERE meeting_id = 101"),
)
def meeting_suggestions(spark, sf):
    rows = suggestions(spark, sf)
    found = board.suggestions_of_meeting(rows, 100, "PENDING").unionByName(board.suggestions_of_meeting(rows, 101))
    return found.select("id", "suggested_title")


@query(
    "pending_listing_a10",
    ck.with_ctes(SUGGESTIONS, select="SELECT id, substr(suggested_title, 1, 55) AS label FROM suggestions WHERE review_status = 'PENDING'"),
)
def pending_listing(spark, sf):
    return collections.pending_listing(suggestions(spark, sf))


@query(
    "embedded_members_k15",
    ck.with_ctes(TEAMS, select="SELECT team_id AS task_id, CAST(k AS INTEGER) AS position, user_id, role, joined_at FROM team_members"),
)
def embedded_members(spark, sf):
    return board.embedded(teams(spark, sf), "members")


@query(
    "user_lookups_k16_k17",
    ck.with_ctes(USERS, select="SELECT id, email, full_name, role FROM users WHERE email = 'customer.000000042@mail.test' UNION ALL SELECT id, email, full_name, role FROM users WHERE contains(lower(email), '99@mail')"),
)
def user_lookups(spark, sf):
    rows = users(spark, sf)
    exact = board.user_by_email(rows, "customer.000000042@mail.test")
    return exact.unionByName(board.users_by_email_part(rows, "99@MAIL"))


@query(
    "duplicate_project_names_k18",
    ck.with_ctes(PROJECTS, select="SELECT team_id, lower(trim(name)) AS name_key, count(*) AS n_projects, min(id) AS first_id FROM projects GROUP BY 1, 2 HAVING count(*) > 1"),
)
def duplicate_project_names(spark, sf):
    return board.duplicate_project_names(projects(spark, sf))


@query(
    "name_conflicts_k18",
    ck.with_ctes(
        PROJECTS, "wanted AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS id, p_partkey % 100 AS team_id, upper(p_name) AS name, p_partkey AS ref FROM part)",
        select="SELECT ref FROM wanted w WHERE EXISTS (SELECT 1 FROM projects p WHERE p.team_id = w.team_id AND lower(trim(p.name)) = lower(trim(w.name)) AND p.id IS DISTINCT FROM w.id)",
    ),
)
def name_conflicts(spark, sf):
    p = F.col("p_partkey")
    wanted = table(spark, sf, "part").select(
        F.when(p % 3 == 0, p).alias("id"), (p % 100).alias("team_id"), F.upper("p_name").alias("name"), p.alias("ref")
    )
    return board.name_taken(wanted, projects(spark, sf)).select("ref")


# --- K19-K25 -------------------------------------------------------------------------------------------
BUCKET = "CASE WHEN status IN ('IN_PROGRESS', 'IN_REVIEW') THEN 'in-progress' WHEN status IN ('DONE', 'CANCELLED') THEN 'completed' ELSE 'todo' END"


@query(
    "board_status_k19",
    ck.with_ctes(TASKS, select=f"SELECT id, {BUCKET} AS bucket, CASE {BUCKET} WHEN 'todo' THEN 'TODO' WHEN 'in-progress' THEN 'IN_PROGRESS' ELSE 'DONE' END AS stored FROM tasks"),
)
def board_status(spark, sf):
    bucket = board.board_status(F.lower("status"))
    return tasks(spark, sf).select("id", bucket.alias("bucket"), board.stored_status(bucket).alias("stored"))


_raw_date = (
    "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') "
    "WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' ELSE 'next week' END"
)


@query(
    "date_formats_k20",
    f"SELECT o_orderkey, {_raw_date} AS raw, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS due FROM orders",
)
def date_formats(spark, sf):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 3, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00"))).otherwise("next week")
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("due", board.parse_deadline(F.col("raw")))


@query(
    "month_name_dates_k20",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%-d %B %Y') "
    "WHEN 2 THEN strftime(o_orderdate, '%a, %d %b %Y') || ' 10:00:00 GMT' ELSE strftime(o_orderdate, '%A %B %d %Y') END AS raw, CAST(o_orderdate AS DATE) AS due FROM orders",
)
def month_name_dates(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(d, "MMM d, yyyy")).when(k == 1, F.date_format(d, "d MMMM yyyy"))
        .when(k == 2, F.concat(F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT"))).otherwise(F.date_format(d, "EEEE MMMM dd yyyy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("due", board.parse_deadline(F.col("raw")))


URGENCY = f"CASE WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date <= DATE '{AS_OF}' + 2 THEN 'near' ELSE 'default' END"


@query("urgency_k21", ck.with_ctes(TASKS, select=f"SELECT id, due_date, {URGENCY} AS urgency FROM tasks"))
def urgency(spark, sf):
    return tasks(spark, sf).select("id", "due_date", board.urgency(F.col("due_date"), AS_OF).alias("urgency"))


@query(
    "board_filter_k22",
    ck.with_ctes(
        TASKS,
        select=f"SELECT 'near' AS filter, id FROM tasks WHERE {URGENCY} = 'near' UNION ALL SELECT 'overdue_unassigned', id FROM tasks WHERE {URGENCY} = 'overdue' AND assignee_id IS NULL "
        f"UNION ALL SELECT 'mine_today', id FROM tasks WHERE assignee_id = {ME} AND due_date = DATE '{AS_OF}' UNION ALL SELECT 'custom', id FROM tasks WHERE due_date IS NULL OR due_date = DATE '1997-03-03'",
    ),
)
def board_filter(spark, sf):
    t = tasks(spark, sf)
    views = {
        "near": {"deadline_filter": "near"},
        "overdue_unassigned": {"deadline_filter": "overdue", "only_unassigned": True},
        "mine_today": {"deadline_filter": "today", "only_mine": True, "user_id": ME},
        "custom": {"custom_date": "1997-03-03"},
    }
    parts = [board.board_filter(t, AS_OF, **v).select(F.lit(n).alias("filter"), "id") for n, v in views.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "board_sort_k23",
    ck.with_ctes(
        TASKS,
        select="SELECT 'asc' AS direction, id, due_date, rank() OVER (ORDER BY due_date ASC NULLS LAST) AS position FROM tasks "
        "UNION ALL SELECT 'desc', id, due_date, rank() OVER (ORDER BY due_date DESC NULLS FIRST) FROM tasks",
    ),
)
def board_sort(spark, sf):
    t = tasks(spark, sf).select("id", "due_date")
    placed = lambda up, name: board.board_positions(t, up).select(F.lit(name).alias("direction"), "id", "due_date", "position")
    return placed(True, "asc").unionByName(placed(False, "desc"))


@query(
    "board_buckets_k24",
    ck.with_ctes(
        TASKS,
        select=f"SELECT project_id, count(*) FILTER ({BUCKET} = 'todo') AS todo, count(*) FILTER ({BUCKET} = 'in-progress') AS in_progress, count(*) FILTER ({BUCKET} = 'completed') AS completed FROM tasks GROUP BY 1",
    ),
)
def board_buckets(spark, sf):
    return board.board_buckets(tasks(spark, sf).withColumn("bucket", board.board_status(F.col("status"))), ["project_id"])


@query("assignee_names_k25", ck.with_ctes(USERS, TASKS, select="SELECT t.id, assignee_id, full_name AS assignee_name FROM tasks t LEFT JOIN users u ON u.id = t.assignee_id"))
def assignee_names(spark, sf):
    return board.with_assignee_name(tasks(spark, sf), users(spark, sf)).select("id", "assignee_id", "assignee_name")


# --- K26-K36 -------------------------------------------------------------------------------------------


@query(
    "initials_k26",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '?' WHEN p_partkey % 3 = 1 THEN upper(substr(p_type, 1, 2)) ELSE upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', -1), 1, 1)) END AS initials FROM part",
)
def initials(spark, sf):
    p = F.col("p_partkey")
    name = F.when(p % 3 == 0, " ").when(p % 3 == 1, F.col("p_type")).otherwise(F.concat(F.lit(" "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.initials(name).alias("initials"))


@query(
    "page_merge_k27",
    ck.with_ctes(USERS, select="SELECT id, CASE WHEN role = 'Manager' THEN full_name ELSE 'second page' END AS full_name FROM users"),
)
def page_merge(spark, sf):
    rows = users(spark, sf)
    first = rows.where(F.col("role") == "Manager").select("id", "full_name")
    return board.merge_pages(first, rows.select("id", F.lit("second page").alias("full_name")), "full_name")


@query(
    "project_response_k28",
    ck.with_ctes(
        PROJECTS,
        select='SELECT id, team_id AS "teamId", owner_id AS "ownerId", name, \'about \' || name AS description, is_archived AS "isArchived", created_by AS "createdBy", created_at AS "createdAt", updated_at AS "updatedAt", '
        "(SELECT string_agg(user_id::VARCHAR, ',' ORDER BY k) FROM project_members m WHERE m.project_id = p.id) AS \"participantIds\" FROM projects p",
    ),
)
def project_response(spark, sf):
    out = board.project_response(projects(spark, sf).withColumn("description", F.concat(F.lit("about "), "name")))
    return out.withColumn("participantIds", F.array_join(F.col("participantIds").cast("array<string>"), ","))


@query(
    "task_response_k28",
    ck.with_ctes(
        TASKS,
        select='SELECT id, project_id AS "projectId", meeting_id AS "meetingId", transcript_reference AS "transcriptReference", title, description, due_date AS deadline, coalesce(CAST(assignee_id AS VARCHAR), \'\') AS "assigneeIds" FROM tasks',
    ),
)
def task_response(spark, sf):
    t = tasks(spark, sf).withColumn("updated_at", F.col("created_at"))
    return board.task_response(t).select(
        "id", "projectId", "meetingId", "transcriptReference", "title", "description", "deadline", F.array_join(F.col("assigneeIds").cast("array<string>"), ",").alias("assigneeIds")
    )


@query(
    "transcript_response_k28",
    ck.with_ctes(
        TASKS,
        "items AS (SELECT transcript_reference AS id, list(title ORDER BY id) AS titles FROM tasks GROUP BY 1)",
        select="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Given ' || o_orderkey WHEN len(titles) > 0 THEN 'Meeting produced ' || len(titles) || ' action items. Key actions: ' || array_to_string(titles[1:3], ', ') || '.' ELSE '' END AS summary, """
        """o_orderstatus AS "processingStatus", coalesce(len(titles), 0)::INTEGER AS items FROM orders LEFT JOIN items ON items.id = o_orderkey""",
    ),
)
def transcript_response(spark, sf):
    o = F.col("o_orderkey")
    pair = F.struct("id", "title")
    items = tasks(spark, sf).groupBy(F.col("transcript_reference").alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("action_items"))
    rows = table(spark, sf, "orders").select(
        o.alias("id"), o.alias("meeting_id"), F.col("o_orderstatus").alias("processing_status"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit("").alias("raw_text"), F.when(o % 3 == 0, F.concat(F.lit("Given "), o)).otherwise("").alias("summary_text"),
    )
    full = rows.join(items, "id", "left").withColumn("action_item_ids", F.transform("action_items", lambda i: i["id"]))
    return board.transcript_response(full).select("id", "summary", "processingStatus", F.size("actionItems").alias("items"))


@query("notification_response_k28", ck.with_ctes(NOTES, select='SELECT id, message, type, read, created_at AS "createdAt" FROM notes'))
def notification_response(spark, sf):
    return board.notification_response(notes(spark, sf))


@query(
    "team_sizes_k29",
    ck.with_ctes(TEAMS, select="SELECT t.id, name, CAST(count(*) AS INTEGER) AS members, CAST(count(*) FILTER (role = 'OWNER') AS INTEGER) AS owners FROM teams t JOIN team_members m ON m.team_id = t.id GROUP BY 1, 2"),
)
def team_sizes(spark, sf):
    return board.team_sizes(teams(spark, sf))


@query(
    "active_jobs_k30",
    ck.with_ctes(JOBS, select="SELECT requester_id, count(*) AS active_jobs FROM jobs WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) >= 3"),
)
def active_jobs(spark, sf):
    return board.busy_requesters(jobs(spark, sf))


@query(
    "active_job_per_transcript_k30",
    ck.with_ctes(JOBS, select="SELECT transcript_id, min(id) AS job_id FROM jobs WHERE status IN ('pending', 'running') GROUP BY 1"),
)
def active_job_per_transcript(spark, sf):
    return board.active_job_per_transcript(jobs(spark, sf))


@query("job_progress_k31", ck.with_ctes(JOBS, select="SELECT id, CAST(floor(current_step / 6.0::DOUBLE * 100) AS INTEGER) AS progress FROM jobs"))
def job_progress(spark, sf):
    return jobs(spark, sf).select("id", board.job_progress(F.col("current_step")).alias("progress"))


@query(
    "workspaces_k32",
    ck.with_ctes(
        TEAMS,
        select="SELECT 'member' AS kind, name AS label, id AS n FROM teams WHERE id IN (SELECT team_id FROM team_members WHERE user_id = 38) "
        "UNION ALL SELECT 'slug', slug, count(*) FROM (SELECT 'ws-' || (id % 40) AS slug FROM teams) GROUP BY slug HAVING count(*) > 1",
    ),
)
def workspaces(spark, sf):
    spaces = teams(spark, sf).withColumn("slug", F.concat(F.lit("ws-"), F.col("id") % 40))
    mine = board.workspaces_of(spaces, 38).select(F.lit("member").alias("kind"), F.col("name").alias("label"), F.col("id").alias("n"))
    return mine.unionByName(board.slug_conflicts(spaces).select(F.lit("slug").alias("kind"), F.col("slug").alias("label"), "n"))


@query(
    "point_lookups_k33",
    ck.with_ctes(
        MEETINGS, select="SELECT e.event_id AS id, m.title, m.id IS NOT NULL AS found FROM events e LEFT JOIN meetings m ON m.id = e.event_id",
    ),
)
def point_lookups(spark, sf):
    keys = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return board.lookup(keys, meetings(spark, sf).select("id", "title"), "id")


@query(
    "users_outside_team_k34",
    ck.with_ctes(USERS, TEAMS, select=f"SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM team_members WHERE team_id = {TEAM}) AND id <> {ME}"),
)
def users_outside_team(spark, sf):
    return board.users_outside_team(users(spark, sf), teams(spark, sf), TEAM, ME).select("id")


@query(
    "slugs_k35",
    "SELECT doc_id, coalesce(nullif(regexp_replace(replace(lower(substr(text, 1, 1) || text), ' ', '-'), '[^a-z0-9-]', '', 'g'), ''), 'workspace-' || doc_id) AS slug FROM documents",
)
def slugs(spark, sf):
    name = F.concat(F.substring("text", 1, 1), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.slug(name, F.concat(F.lit("workspace-"), "doc_id")).alias("slug"))


@query(
    "job_states_k36",
    ck.with_ctes(JOBS, select="SELECT 'retryable' AS kind, id FROM jobs WHERE status IN ('failed', 'timeout') UNION ALL SELECT 'terminal', id FROM jobs WHERE status IN ('completed', 'failed', 'cancelled', 'timeout')"),
)
def job_states(spark, sf):
    j = jobs(spark, sf)
    part = lambda name, states: board.jobs_in(j, states).select(F.lit(name).alias("kind"), "id")
    return part("retryable", lx.RETRYABLE_JOBS).unionByName(part("terminal", lx.TERMINAL_JOBS))


# --- L -------------------------------------------------------------------------------------------------


def outputs(spark, sf):
    """Result JSON per order: sound ones and every kind of damage."""
    o, k = F.col("o_orderkey"), F.col("o_orderkey") % 6
    item = F.concat(
        F.lit('{"title": "Call '), F.col("o_custkey"), F.lit('", "assignee": "'), F.when(o % 4 == 0, "Team").otherwise(F.concat(F.lit("User "), "o_custkey")),
        F.lit('", "deadline": "'), F.when(o % 3 == 0, "Friday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit('"}'),
    )
    raw = (
        F.when(k == 0, F.concat(F.lit('{"summary": {"summary_text": "S'), o, F.lit('"}, "action_items": ['), item, F.lit(', {"title": " "}, 5]}')))
        .when(k == 1, F.concat(F.lit('{"action_items": ['), item, F.lit("]}")))
        .when(k == 2, F.lit('{"summary": [], "action_items": []}'))
        .when(k == 3, F.lit('{"summary": {}, "action_items": {"title": "x"}}'))
        .when(k == 4, F.lit("[1, 2]"))
        .otherwise('{"summary": null}')
    )
    return table(spark, sf, "orders").select(o.alias("id"), raw.alias("raw"))


CHECKED_OUTPUTS = (
    "checked AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, 'Call ' || o_custkey AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'User ' || o_custkey END AS assignee, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline FROM orders)"
)


@query(
    "output_validation_l1",
    ck.with_ctes(
        CHECKED_OUTPUTS,
        select="SELECT id, CASE k WHEN 2 THEN 'summary must be an object' WHEN 3 THEN 'action_items must be a list' WHEN 4 THEN 'output must be an object' END AS error, "
        "CASE WHEN k = 0 THEN 'S' || id END AS summary_text, CASE WHEN k < 2 THEN title ELSE '' END AS titles, CASE WHEN k = 0 THEN 2 ELSE 0 END AS n_dropped FROM checked",
    ),
)
def output_validation(spark, sf):
    out = results.validate_outputs(outputs(spark, sf))
    return out.select("id", "error", "summary_text", F.array_join(F.transform("items", lambda i: i["title"]), "|").alias("titles"), "n_dropped")


@query(
    "output_mapping_l2_l4",
    ck.with_ctes(CHECKED_OUTPUTS, select="SELECT id, title, '' AS description, assignee, deadline FROM checked WHERE k < 2"),
)
def output_mapping(spark, sf):
    mapped = results.map_outputs(results.validate_outputs(outputs(spark, sf)))
    return mapped.select("id", F.explode("items").alias("i")).select("id", "i.title", "i.description", "i.assignee", "i.deadline")


@query(
    "assignee_accounts_l5",
    ck.with_ctes(
        USERS,
        "asked AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' USER ' || user_id WHEN 1 THEN 'Customer.00000' || (event_id % 300) WHEN 2 THEN NULL ELSE 'nobody' END AS assignee FROM events)",
        "named AS (SELECT event_id, lower(trim(assignee)) AS k, (SELECT min(id) FROM users u WHERE lower(u.full_name) = lower(trim(assignee))) AS by_name FROM asked), "
        "keys AS (SELECT DISTINCT k FROM named WHERE by_name IS NULL AND k <> ''), "
        "mails AS (SELECT k, min(id) AS by_mail FROM keys JOIN users u ON starts_with(lower(u.email), k) GROUP BY k)",
        select="SELECT event_id, coalesce(by_name, by_mail) AS assignee_id FROM named LEFT JOIN mails USING (k)",
    ),
)
def assignee_accounts(spark, sf):
    e = F.col("event_id")
    name = F.when(e % 4 == 0, F.concat(F.lit(" USER "), "user_id")).when(e % 4 == 1, F.concat(F.lit("Customer.00000"), e % 300)).when(e % 4 == 3, "nobody")
    items = table(spark, sf, "events").select("event_id", name.alias("assignee"))
    return results.resolve_assignees(items, users(spark, sf)).select("event_id", "assignee_id")


@query(
    "fallback_summaries_l6",
    ck.with_ctes(
        "t AS (SELECT l_orderkey, list(l_comment ORDER BY l_comment) AS titles FROM (SELECT DISTINCT l_orderkey, 'part ' || l_partkey AS l_comment FROM lineitem) GROUP BY 1)",
        select="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'given' WHEN titles IS NULL THEN 'Meeting processed successfully. No action items were extracted.' "
        "ELSE 'Meeting produced ' || len(titles) || ' action items. Key actions: ' || array_to_string(titles[1:3], ', ') || '.' END AS summary FROM orders LEFT JOIN t ON l_orderkey = o_orderkey",
    ),
)
def fallback_summaries(spark, sf):
    titles = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("part "), "l_partkey"))).alias("titles")
    )
    joined = table(spark, sf, "orders").join(titles, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    given = F.when(F.col("o_orderstatus") == "F", "given").when(F.col("o_orderstatus") == "O", "")
    return joined.select("o_orderkey", results.fallback_summary(given, F.col("titles")).alias("summary"))


@query(
    "response_contracts_l7",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/auth/login: missing required keys: token|/auth/login.user: missing required keys: email, fullName' WHEN 1 THEN '/tasks: expected array' "
    "WHEN 2 THEN '' WHEN 3 THEN '/processing/' || event_id || '/status: missing required keys: progress, stepLabel' ELSE '/auth/me: expected object' END AS violations FROM events",
)
def response_contracts(spark, sf):
    e = F.col("event_id") % 5
    calls = table(spark, sf, "events").select(
        "event_id",
        F.when(e == 0, "POST").otherwise("GET").alias("method"),
        F.when(e == 0, "/auth/login").when(e == 1, "/tasks").when(e == 2, "/unlisted").when(e == 3, F.concat(F.lit("/processing/"), "event_id", F.lit("/status"))).otherwise("/auth/me").alias("path"),
        F.when(e == 0, F.concat(F.lit('{"user": {"id": '), "event_id", F.lit("}}"))).when(e == 1, F.lit('{"items": []}')).when(e == 2, F.lit("7"))
        .when(e == 3, F.lit('{"jobId": 1, "status": "x", "currentStep": 2}')).otherwise("[]").alias("body"),
    )
    return results.contract_violations(calls).select("event_id", F.array_join("violations", "|").alias("violations"))


# --- M -------------------------------------------------------------------------------------------------
NEW_ITEMS = (
    f"items AS (SELECT e.event_id AS pos, e.event_id % 4000 AS transcript_id, {ck._TEXT}[e.event_id * 7 % 64 + 1] || CASE WHEN event_id % 9 = 0 THEN ' ' ELSE '' END AS title FROM events e)"
)


def new_items(spark, sf):
    e = F.col("event_id")
    title = F.concat(_pick(PHRASES, e * 7 % 64), F.when(e % 9 == 0, " ").otherwise(""))
    return table(spark, sf, "events").select(e.alias("pos"), (e % 4000).alias("transcript_id"), title.alias("title"))


@query(
    "replace_pending_m1",
    ck.with_ctes(
        SUGGESTIONS, NEW_ITEMS,
        select="SELECT id, transcript_id, suggested_title, review_status FROM suggestions WHERE review_status <> 'PENDING' OR transcript_id NOT IN (SELECT transcript_id FROM items) "
        "UNION ALL SELECT NULL, transcript_id, trim(title), 'PENDING' FROM items QUALIFY row_number() OVER (PARTITION BY transcript_id, lower(trim(title)) ORDER BY pos) = 1",
    ),
)
def replace_pending(spark, sf):
    items = new_items(spark, sf).withColumnRenamed("title", "suggested_title")
    return mutations.replace_pending(suggestions(spark, sf), items).select("id", "transcript_id", "suggested_title", "review_status")


@query(
    "replace_pending_all_m1",
    ck.with_ctes(
        SUGGESTIONS, NEW_ITEMS,
        select="SELECT transcript_id, count(*) AS n FROM (SELECT transcript_id FROM suggestions WHERE review_status <> 'PENDING' OR transcript_id NOT IN (SELECT transcript_id FROM items) UNION ALL SELECT transcript_id FROM items) GROUP BY 1",
    ),
)
def replace_pending_all(spark, sf):
    items = new_items(spark, sf).withColumnRenamed("title", "suggested_title")
    out = mutations.replace_pending(suggestions(spark, sf), items, dedup_titles=False)
    return out.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))


def publish_items(spark, sf):
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        o.alias("transcript_id"), (((n * 100000 + p) * 100000 + F.col("l_suppkey")) * 10000000 + cents()).alias("pos"),
        F.when(p % 11 == 0, "  ").when(p % 13 == 0, F.lit("")).otherwise(F.upper(_pick(PHRASES, p % 64))).alias("title"),
        F.when(n % 2 == 0, F.concat(F.lit("from line "), n)).otherwise("edited").alias("description"),
        F.when(F.col("l_quantity") >= 10, ((p * 3 + F.col("l_suppkey")) % 1500).cast("string")).otherwise("bad id").alias("assignee"),
        F.when(F.col("l_discount") > 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("soon").alias("deadline"),
    )


def published(spark, sf):
    items = publish_items(spark, sf)
    rows = ordered.segment_rows(items, ["transcript_id"])
    return mutations.publish_changes(board_before(spark, sf), items, F.col("_a").rlike("^[0-9]+$"), rows)


def board_before(spark, sf):
    """The board before publishing: every third transcript has manual tasks only, so it is published first now."""
    manual = F.col("is_manual") | (F.col("transcript_reference") % 3 == 0)
    return tasks(spark, sf).withColumn("is_manual", manual)


PUBLISH = (
    f"pitems AS (SELECT l_orderkey AS transcript_id, ((l_linenumber * 100000 + l_partkey) * 100000 + l_suppkey) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, CASE WHEN l_partkey % 11 = 0 THEN '  ' WHEN l_partkey % 13 = 0 THEN 'Untitled' ELSE upper({ck._TEXT}[l_partkey % 64 + 1]) END AS title, "
    "CASE WHEN l_linenumber % 2 = 0 THEN 'from line ' || l_linenumber ELSE 'edited' END AS description, CASE WHEN l_quantity >= 10 THEN CAST((l_partkey * 3 + l_suppkey) % 1500 AS VARCHAR) END AS a, "
    "CASE WHEN l_discount > 0 THEN CAST(l_shipdate AS DATE) END AS u FROM lineitem), "
    "old AS (SELECT transcript_reference AS transcript_id, lower(trim(title)) AS k, max(id) AS id, arg_max(trim(description), id) AS d, arg_max(coalesce(CAST(assignee_id AS VARCHAR), '-'), id) AS a, arg_max(coalesce(CAST(due_date AS VARCHAR), '-'), id) AS u "
    "FROM tasks WHERE NOT is_manual AND transcript_reference % 3 <> 0 GROUP BY 1, 2), "
    "seen AS (SELECT DISTINCT transcript_id FROM old), "
    "inc AS (SELECT i.transcript_id, pos, trim(title) AS title, lower(trim(title)) AS k, i.description, i.a, i.u, old.id AS task_id, s.transcript_id IS NOT NULL AS republish, "
    "trim(i.description) || '|' || coalesce(i.a, '-') || '|' || coalesce(CAST(i.u AS VARCHAR), '-') AS state, old.d || '|' || old.a || '|' || old.u AS old_state "
    "FROM pitems i LEFT JOIN old ON old.transcript_id = i.transcript_id AND old.k = lower(trim(i.title)) LEFT JOIN seen s ON s.transcript_id = i.transcript_id WHERE trim(title) <> ''), "
    "acts AS (SELECT *, CASE WHEN task_id IS NULL AND row_number() OVER w = 1 THEN 'created' WHEN NOT republish THEN 'duplicate' "
    "WHEN state = coalesce(lag(state) OVER w, old_state) THEN 'unchanged' ELSE 'updated' END AS action FROM inc WINDOW w AS (PARTITION BY transcript_id, k ORDER BY pos))"
)


@query(
    "publish_changes_m2",
    ck.with_ctes(TASKS, PUBLISH, select="SELECT transcript_id, pos, title, description, a AS assignee_id, u AS due_date, task_id, action FROM acts"),
)
def publish_changes(spark, sf):
    return published(spark, sf).drop("title_key")


@query(
    "publish_counts_m2",
    ck.with_ctes(
        TASKS, PUBLISH,
        select="SELECT transcript_id, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action IN ('unchanged', 'duplicate')) AS duplicates FROM acts GROUP BY 1",
    ),
)
def publish_counts(spark, sf):
    return mutations.publish_counts(published(spark, sf))


@query(
    "publish_result_m2",
    ck.with_ctes(
        TASKS, PUBLISH,
        "eff AS (SELECT transcript_id, k, arg_min(title, pos) AS title, arg_max(description, pos) AS description, arg_max(coalesce(a, '-'), pos) AS a, arg_max(coalesce(CAST(u AS VARCHAR), '-'), pos) AS u, max(task_id) AS task_id FROM acts WHERE action IN ('created', 'updated') GROUP BY 1, 2)",
        select="SELECT t.id, t.title, coalesce(e.description, t.description) AS description, CASE WHEN e.task_id IS NOT NULL THEN nullif(e.a, '-') ELSE CAST(t.assignee_id AS VARCHAR) END AS assignee_id, "
        "CASE WHEN e.task_id IS NOT NULL THEN nullif(e.u, '-') ELSE CAST(t.due_date AS VARCHAR) END AS due_date, t.status FROM tasks t LEFT JOIN eff e ON e.task_id = t.id "
        "UNION ALL SELECT transcript_id || ':' || k, title, description, nullif(a, '-'), nullif(u, '-'), 'TODO' FROM eff WHERE task_id IS NULL",
    ),
)
def publish_result(spark, sf):
    after = mutations.publish(board_before(spark, sf), publish_items(spark, sf), F.concat_ws(":", "transcript_id", "title_key"), F.col("_a").rlike("^[0-9]+$"))
    return after.select("id", "title", "description", F.col("assignee_id").cast("string").alias("assignee_id"), F.col("due_date").cast("string").alias("due_date"), "status")


@query(
    "summary_upsert_m3_m4",
    ck.with_ctes(
        "base AS (SELECT o_orderkey AS id, 'old' AS summary_text, o_custkey AS owner_id FROM orders), ch AS (SELECT event_id * 3 AS id, CASE WHEN value > 5 THEN 'new ' || event_id END AS summary_text FROM events)",
        select="SELECT coalesce(base.id, ch.id) AS id, coalesce(ch.summary_text, base.summary_text) AS summary_text, owner_id FROM base FULL JOIN ch ON base.id = ch.id",
    ),
)
def summary_upsert(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("old").alias("summary_text"), F.col("o_custkey").alias("owner_id")
    )
    changes = table(spark, sf, "events").select(
        (F.col("event_id") * 3).alias("id"), F.when(F.col("value") > 5, F.concat(F.lit("new "), "event_id")).alias("summary_text")
    )
    return mutations.upsert_by_key(base, changes, ["id"], ["summary_text"])


@query(
    "suggestion_reviews_m5",
    ck.with_ctes(
        SUGGESTIONS,
        "dec AS (SELECT *, CASE length(id) % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, CASE WHEN transcript_id % 2 = 0 THEN 'Override' END AS t FROM suggestions), "
        "err AS (SELECT *, CASE WHEN decision = 'approve' AND review_status = 'REJECTED' THEN 'Cannot approve a rejected suggestion.' WHEN decision = 'approve' AND task_id IS NOT NULL THEN 'Suggestion has already been approved.' END AS error FROM dec)",
        select="SELECT id, decision, error, CASE WHEN decision = 'approve' AND error IS NULL THEN 'APPROVED' WHEN decision = 'reject' THEN 'REJECTED' WHEN decision = 'edit' AND review_status = 'PENDING' THEN 'MODIFIED' ELSE review_status END AS review_status, "
        "CASE WHEN decision = 'reject' OR (decision = 'approve' AND error IS NULL) THEN 9 END AS reviewed_by, CASE WHEN decision = 'approve' AND error IS NULL THEN coalesce(t, suggested_title) END AS task_title, "
        "CASE WHEN decision = 'approve' AND error IS NULL THEN suggested_description END AS task_description, CASE WHEN decision = 'approve' AND error IS NULL THEN suggested_deadline END AS task_due_date, "
        "CASE WHEN decision = 'approve' AND error IS NULL THEN transcript_quote END AS evidence_quote FROM err",
    ),
)
def suggestion_reviews(spark, sf):
    s = suggestions(spark, sf)
    n = F.length("id") % 3
    decisions = s.select(
        "id", F.when(n == 0, "approve").when(n == 1, "reject").otherwise("edit").alias("decision"), F.when(F.col("transcript_id") % 2 == 0, "Override").alias("title"),
        F.lit("").alias("description"), F.lit(None).cast("date").alias("due_date"), F.lit(9).alias("reviewer"),
    )
    return mutations.review_suggestions(s, decisions).drop("meeting_id", "transcript_id")


@query(
    "task_updates_m6_m7",
    ck.with_ctes(
        TASKS,
        select="SELECT id, CASE WHEN project_id % 2 = 0 THEN 'DONE' ELSE status END AS status, CASE WHEN project_id % 3 = 0 THEN 'CRITICAL' ELSE priority END AS priority, title, "
        "'null>' || status || CASE WHEN project_id % 2 = 0 AND status <> 'DONE' THEN ',' || status || '>DONE' ELSE '' END AS history FROM tasks",
    ),
)
def task_updates(spark, sf):
    base = tasks(spark, sf).withColumn(
        "status_history", mutations.initial_history(F.col("status"), F.lit(1).cast("long"), F.col("created_at"))
    )
    p = F.col("project_id")
    changes = base.where((p % 2 == 0) | (p % 3 == 0)).select(
        "id", F.when(p % 2 == 0, "DONE").alias("status"), F.when(p % 3 == 0, "CRITICAL").alias("priority"),
        F.lit(2).cast("long").alias("changed_by"), F.col("created_at").alias("changed_at"),
    )
    out = mutations.update_tasks(base, changes, ["status", "priority"])
    step = F.transform("status_history", lambda h: F.concat(F.coalesce(h["old_status"], F.lit("null")), F.lit(">"), h["new_status"]))
    return out.select("id", "status", "priority", "title", F.array_join(step, ",").alias("history"))


@query(
    "notes_and_subtasks_m8",
    ck.with_ctes(
        "subs AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey, l_linenumber FROM lineitem)",
        select="SELECT o_orderkey AS id, string_agg(CASE WHEN s.pos IS NULL THEN NULL ELSE s.l_partkey || CASE WHEN s.pos = 2 AND o_orderstatus = 'F' THEN ':DONE' ELSE ':TODO' END END, ',' ORDER BY s.pos) AS subtasks FROM orders LEFT JOIN subs s ON s.id = o_orderkey GROUP BY 1",
    ),
)
def notes_and_subtasks(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.from_json(F.lit("[]"), "array<struct<id:int,title:string,status:string>>").alias("subtasks"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("pos"), "l_partkey")
    entry = F.struct(F.col("pos").alias("id"), F.col("l_partkey").cast("string").alias("title"), F.lit("TODO").alias("status"))
    grown = mutations.append_entries(o, rows.select("id", "pos", entry.alias("entry")), "subtasks")
    done = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    patches = done.select(F.col("o_orderkey").alias("id"), F.lit(2).alias("entry_id"), F.lit("DONE").alias("status"))
    patched = mutations.patch_entries(grown, patches, "subtasks", ["status"])
    text = F.array_join(F.transform("subtasks", lambda s: F.concat(s["title"], F.lit(":"), s["status"])), ",")
    return patched.select("id", F.nullif(text, F.lit("")).alias("subtasks"))


@query(
    "member_changes_m9",
    ck.with_ctes(
        TEAMS,
        "ops AS (SELECT id, CASE id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'role' END AS op, CASE WHEN id % 2 = 0 THEN id * 31 % 2000 ELSE 5000 END AS u FROM teams), "
        "inside AS (SELECT o.*, EXISTS (SELECT 1 FROM team_members m WHERE m.team_id = o.id AND m.user_id = u) AS i FROM ops o), "
        "err AS (SELECT *, CASE WHEN op = 'add' AND i THEN 'User is already a member.' WHEN op <> 'add' AND NOT i THEN 'Member not found.' END AS error FROM inside)",
        select="SELECT e.id, op, error, (SELECT string_agg(user_id || ':' || CASE WHEN error IS NULL AND op = 'role' AND user_id = u THEN 'OWNER' ELSE role END, ',' ORDER BY k) FROM team_members m WHERE m.team_id = e.id "
        "AND NOT (error IS NULL AND op = 'remove' AND user_id = u)) || CASE WHEN error IS NULL AND op = 'add' THEN ',' || u || ':OWNER' ELSE '' END AS members FROM err e",
    ),
)
def member_changes(spark, sf):
    t = teams(spark, sf)
    i = F.col("id")
    changes = t.select(
        "id", F.when(i % 3 == 0, "add").when(i % 3 == 1, "remove").otherwise("role").alias("op"), F.when(i % 2 == 0, i * 31 % 2000).otherwise(5000).alias("user_id"),
        F.lit("OWNER").alias("role"), F.lit(99).cast("long").alias("joined_at"),
    )
    out = mutations.change_members(t, changes)
    text = F.array_join(F.transform("members", lambda m: F.concat(m["user_id"].cast("string"), F.lit(":"), m["role"])), ",")
    return out.select("id", "op", "error", text.alias("members"))


@query(
    "cascade_delete_m10",
    ck.with_ctes(
        MEETINGS, TASKS,
        select="SELECT 'meeting' AS kind, CAST(id AS VARCHAR) AS id FROM meetings WHERE meeting_date IS NOT NULL UNION ALL SELECT 'transcript', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT id FROM meetings WHERE meeting_date IS NULL) "
        "UNION ALL SELECT 'task', id FROM tasks WHERE NOT (priority = 'LOW' AND (owner_id IS NULL OR owner_id = 35))",
    ),
)
def cascade_delete(spark, sf):
    m, docs = meetings(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("meeting_id"))
    left, scripts = mutations.delete_meetings(m, docs, m.where(F.col("meeting_date").isNull()).select("id"))
    t = tasks(spark, sf)
    rest = mutations.delete_tasks(t, t.where(F.col("priority") == "LOW").select("id"), 35)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    return tag(left, "meeting").unionByName(tag(scripts, "transcript")).unionByName(tag(rest, "task"))


@query(
    "cleanup_m11",
    ck.with_ctes(TEAMS, select="SELECT id, name FROM teams WHERE name NOT LIKE 'TEST%' UNION ALL SELECT -1, CAST(count(*) AS VARCHAR) FROM teams WHERE name LIKE 'TEST%'"),
)
def cleanup(spark, sf):
    t = teams(spark, sf)
    gone = mutations.cleaned_count(t).select(F.lit(-1).cast("long").alias("id"), F.col("deleted").cast("string").alias("name"))
    return mutations.clean_up(t).select("id", "name").unionByName(gone)


@query(
    "mark_read_m12",
    ck.with_ctes(NOTES, select="SELECT id, read OR user_id = 8 AS read, user_id = 8 AND NOT read AS changed FROM notes"),
)
def mark_read(spark, sf):
    return notifications.mark_read(notes(spark, sf), 8).select("id", "read", "changed")


@query(
    "edit_sync_m13",
    ck.with_ctes(
        TASKS,
        "num AS (SELECT t.*, o_orderstatus, row_number() OVER (PARTITION BY transcript_reference ORDER BY id) AS pos FROM tasks t LEFT JOIN orders ON o_orderkey = transcript_reference)",
        select="SELECT id, CASE WHEN o_orderstatus = 'F' AND pos <= 2 THEN CASE WHEN pos = 1 THEN 'Edited ' || transcript_reference ELSE title END ELSE title END AS title, "
        "CASE WHEN o_orderstatus = 'F' AND pos <= 2 THEN CASE WHEN pos = 1 THEN 17 END ELSE assignee_id END AS assignee_id, "
        "CASE WHEN o_orderstatus = 'F' AND pos = 1 THEN DATE '2024-01-31' ELSE due_date END AS due_date FROM num",
    ),
)
def edit_sync(spark, sf):
    keys = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("transcript_id"))
    first = keys.select(
        "transcript_id", F.lit(1).alias("pos"), F.concat(F.lit(" Edited "), "transcript_id").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit("17").alias("assignee"), F.lit("2024-01-31").alias("deadline"),
    )
    second = first.select(
        "transcript_id", F.lit(2).alias("pos"), F.lit(" ").alias("title"), "description", F.lit("").alias("assignee"), F.lit("soon").alias("deadline")
    )
    return mutations.sync_by_position(tasks(spark, sf), first.unionByName(second)).select("id", "title", "assignee_id", "due_date")


@query(
    "default_meetings_m14",
    ck.with_ctes(MEETINGS, select="SELECT event_id AS id, user_id AS project_id, 'Transcript Upload' AS title, user_id AS created_by FROM events WHERE event_id % 2 = 0 OR event_id NOT IN (SELECT id FROM meetings)"),
)
def default_meetings(spark, sf):
    e = F.col("event_id")
    uploads = table(spark, sf, "events").select(
        e.alias("upload_id"), F.when(e % 2 == 1, e).alias("meeting_id"), F.col("user_id").alias("project_id"), F.col("user_id").alias("uploaded_by")
    )
    return mutations.default_meetings(uploads, meetings(spark, sf))


@query(
    "new_projects_m15",
    ck.with_ctes(
        PROJECTS,
        "req AS (SELECT o_orderkey AS request_id, o_custkey % 100 AS team_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Fresh ' || (o_orderkey % 300) ELSE ' red widget' END AS name, o_custkey AS owner_id FROM orders)",
        select="SELECT request_id, team_id, trim(name) AS name, owner_id, CASE WHEN row_number() OVER (PARTITION BY team_id, lower(trim(name)) ORDER BY request_id) = 1 "
        "AND NOT EXISTS (SELECT 1 FROM projects p WHERE p.team_id = req.team_id AND lower(trim(p.name)) = lower(trim(req.name))) THEN 'created' ELSE 'conflict' END AS outcome FROM req",
    ),
)
def new_projects(spark, sf):
    o = F.col("o_orderkey")
    requests = table(spark, sf, "orders").select(
        o.alias("request_id"), (F.col("o_custkey") % 100).alias("team_id"),
        F.when(o % 2 == 0, F.concat(F.lit("Fresh "), o % 300)).otherwise(" red widget").alias("name"), F.col("o_custkey").alias("creator_id"),
    )
    return mutations.create_projects(requests, projects(spark, sf))


# --- N -------------------------------------------------------------------------------------------------
PEOPLE = "people AS (SELECT id AS project_id, owner_id AS user_id FROM projects UNION SELECT id, created_by FROM projects UNION SELECT project_id, user_id FROM project_members)"


@query("recipients_n1", ck.with_ctes(PROJECTS, PEOPLE, select="SELECT project_id, user_id FROM people"))
def recipients(spark, sf):
    return notifications.recipients(projects(spark, sf))


@query(
    "fan_out_n1",
    ck.with_ctes(PROJECTS, PEOPLE, JOBS, select="SELECT j.id, p.user_id, 'Job ' || j.status AS message, false AS read FROM jobs j JOIN people p USING (project_id)"),
)
def fan_out(spark, sf):
    messages = jobs(spark, sf).select("id", "project_id", F.concat(F.lit("Job "), "status").alias("message"))
    return notifications.fan_out(messages, projects(spark, sf)).select("id", "user_id", "message", "read")


@query(
    "inbox_n2",
    ck.with_ctes(NOTES, select="SELECT 'row' AS kind, id AS n FROM notes WHERE user_id = 8 UNION ALL SELECT 'unread ' || user_id, count(*) FILTER (NOT read) FROM notes GROUP BY user_id"),
)
def inbox(spark, sf):
    rows = notes(spark, sf)
    mine = notifications.inbox(rows, 8).select(F.lit("row").alias("kind"), F.col("id").alias("n"))
    unread = notifications.unread_counts(rows).select(F.concat(F.lit("unread "), "user_id").alias("kind"), F.col("unread").alias("n"))
    return mine.unionByName(unread)


@query(
    "job_events_n3",
    ck.with_ctes(
        JOBS,
        select="""SELECT id AS job_id, '{"type":"processing_updated","payload":{"jobId":"' || id || '","status":"' || status || '","currentStep":' || current_step || ',"progress":' || CAST(floor(current_step / 6.0::DOUBLE * 100) AS INTEGER) || '}}' AS event FROM jobs """
        """UNION ALL SELECT id, '{"type":"processing_completed","payload":{"jobId":"' || id || '","transcriptId":"' || transcript_id || '"}}' FROM jobs WHERE status = 'completed'""",
    ),
)
def job_events(spark, sf):
    return notifications.job_events(jobs(spark, sf)).select("job_id", "event")


@query(
    "task_events_n3",
    ck.with_ctes(
        TASKS,
        select="""SELECT id AS task_id, '{"type":"task_created","payload":{"id":"' || id || '","projectId":"' || project_id || '","title":"' || title || '","status":"' || status || '","priority":"' || priority || '"}}' AS event FROM tasks""",
    ),
)
def task_events(spark, sf):
    return notifications.task_events(tasks(spark, sf)).select("task_id", "event")


@query(
    "job_admission_n4",
    ck.with_ctes(
        JOBS, "req AS (SELECT event_id // 2 AS transcript_id, event_id AS requested_at, user_id FROM events)",
        select="SELECT transcript_id, min(requested_at) AS requested_at, arg_min(user_id, requested_at) AS user_id FROM req WHERE transcript_id NOT IN (SELECT transcript_id FROM jobs WHERE status IN ('pending', 'running')) GROUP BY 1",
    ),
)
def job_admission(spark, sf):
    e = F.col("event_id")
    requests = table(spark, sf, "events").select(F.floor(e / 2).alias("transcript_id"), e.alias("requested_at"), "user_id")
    return notifications.admit_jobs(requests, jobs(spark, sf))


@query(
    "latest_job_state_n6",
    "SELECT user_id AS job_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS status, max(struct_pack(ts := ts, e := event_id)).e AS seq FROM events GROUP BY 1",
)
def latest_job_state(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq")
    )
    return notifications.latest_job_state(log).select("job_id", "status", "seq")


@query(
    "daily_counts_n7",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def daily_counts(spark, sf):
    from gavel.streaming.ingest import daily_counts as counts

    out = counts(table(spark, sf, "events").select("ts", "event_type"), "ts", "event_type")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


# --- M4, M5, M12, M15, K32, N3: what changes leave behind -----------------------------------------------------------
DECIDED = (
    "dec AS (SELECT *, CASE length(id) % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, CASE WHEN transcript_id % 2 = 0 THEN 'Override' END AS t FROM suggestions), "
    "err AS (SELECT *, (decision = 'approve' AND review_status <> 'REJECTED' AND task_id IS NULL) AS taken FROM dec)"
)


def review_decisions(s):
    n = F.length("id") % 3
    return s.select(
        "id", F.when(n == 0, "approve").when(n == 1, "reject").otherwise("edit").alias("decision"), F.when(F.col("transcript_id") % 2 == 0, "Override").alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("date").alias("due_date"), F.lit(9).alias("reviewer"),
    )


@query(
    "approved_tasks_m5",
    ck.with_ctes(
        SUGGESTIONS, MEETINGS, DECIDED,
        select="SELECT 'task-' || err.id AS id, project_id, team_id, meeting_id, coalesce(t, suggested_title) AS title, suggested_description AS description, 'TODO' AS status, 9 AS owner_id, "
        "suggested_deadline AS due_date, transcript_quote AS quote, 'TODO by 9' AS history FROM err JOIN meetings m ON m.id = err.meeting_id WHERE taken",
    ),
)
def approved_tasks(spark, sf):
    s = suggestions(spark, sf)
    built = mutations.approved_tasks(mutations.review_suggestions(s, review_decisions(s)), meetings(spark, sf), F.lit("2024-01-01"))
    first = F.col("status_history")[0]
    return built.select(
        "id", "project_id", "team_id", "meeting_id", "title", "description", "status", "owner_id", "due_date",
        F.get("evidence", F.lit(0))["quote"].alias("quote"), F.concat(first["new_status"], F.lit(" by "), first["changed_by"]).alias("history"),
    )


@query(
    "reviewed_suggestions_m5",
    ck.with_ctes(
        SUGGESTIONS, DECIDED,
        select="SELECT id, CASE WHEN decision = 'edit' THEN coalesce(t, suggested_title) ELSE suggested_title END AS suggested_title, CASE WHEN taken THEN 'APPROVED' WHEN decision = 'reject' THEN 'REJECTED' "
        "WHEN decision = 'edit' AND review_status = 'PENDING' THEN 'MODIFIED' ELSE review_status END AS review_status, CASE WHEN taken THEN 'task-' || id ELSE task_id END AS task_id, "
        "CASE WHEN taken OR decision = 'reject' THEN 9 END AS reviewed_by FROM err",
    ),
)
def reviewed_suggestions(spark, sf):
    s = suggestions(spark, sf)
    return mutations.reviewed_suggestions(s, review_decisions(s)).select("id", "suggested_title", "review_status", "task_id", "reviewed_by")


@query(
    "transcript_edits_m4",
    ck.with_ctes(
        "base AS (SELECT o_orderkey AS id, 'old' AS summary_text, o_custkey AS owner_id FROM orders), ch AS (SELECT event_id * 3 AS id, CASE WHEN value > 5 THEN 'new ' || event_id END AS summary_text FROM events)",
        select="SELECT base.id, coalesce(ch.summary_text, base.summary_text) AS summary_text, owner_id FROM base LEFT JOIN ch ON base.id = ch.id",
    ),
)
def transcript_edits(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("summary_text"), F.col("o_custkey").alias("owner_id"))
    changes = table(spark, sf, "events").select((F.col("event_id") * 3).alias("id"), F.when(F.col("value") > 5, F.concat(F.lit("new "), "event_id")).alias("summary_text"))
    return mutations.update_by_key(base, changes, ["id"], ["summary_text"])


@query(
    "mark_given_m12",
    ck.with_ctes(NOTES, select="SELECT id, read OR (user_id = 8 AND id % 3 = 0) AS read, user_id = 8 AND id % 3 = 0 AND NOT read AS changed FROM notes"),
)
def mark_given(spark, sf):
    given = table(spark, sf, "events").select(F.col("event_id").alias("id")).where("id % 3 = 0")
    return notifications.mark_read(notes(spark, sf), 8, given).select("id", "read", "changed")


@query("marked_count_m12", ck.with_ctes(NOTES, select="SELECT count(*) AS changed FROM notes WHERE user_id = 8 AND NOT read"))
def marked_count(spark, sf):
    return notifications.changed_count(notifications.mark_read(notes(spark, sf), 8))


@query(
    "new_teams_m15",
    "SELECT c_custkey AS id, c_nationkey AS workspace_id, c_name AS name, c_custkey % 700 AS created_by, (c_custkey % 700) || ':OWNER' AS members FROM customer",
)
def new_teams(spark, sf):
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("description"), (F.col("c_custkey") % 700).alias("creator_id"),
    )
    people = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["user_id"], m["role"])), ",")
    return mutations.create_teams(requests, F.lit(0)).select("id", "workspace_id", "name", "created_by", people.alias("members"))


@query("workspace_teams_k32", ck.with_ctes(TEAMS, select="SELECT id, name, workspace_id FROM teams WHERE workspace_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"))
def workspace_teams(spark, sf):
    spaces = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return board.teams_of_workspaces(teams(spark, sf), spaces).select("id", "name", "workspace_id")


@query(
    "delivered_events_n3",
    ck.with_ctes(
        TASKS, PROJECTS, PEOPLE,
        select="""SELECT t.id AS task_id, user_id, '{"type":"task_created","payload":{"id":"' || t.id || '","projectId":"' || t.project_id || '","title":"' || title || '","status":"' || status || '","priority":"' || priority || '"}}' AS event FROM tasks t JOIN people p ON p.project_id = t.project_id""",
    ),
)
def delivered_events(spark, sf):
    people = notifications.recipients(projects(spark, sf))
    return notifications.deliver(notifications.task_events(tasks(spark, sf)), people).select("task_id", "user_id", "event")


@query(
    "publish_events_n3",
    ck.with_ctes(
        TASKS,
        "pub AS (SELECT transcript_reference AS transcript_id, min(project_id) AS project_id, list_sort(list(id)) AS ids, count(*) - count(DISTINCT title) AS duplicates FROM tasks GROUP BY 1)",
        select="""SELECT transcript_id, '{"type":"publish_completed","payload":{"projectId":"' || project_id || '","transcriptId":"' || transcript_id || '","taskIds":["' || array_to_string(ids, '","') || '"],"count":' || len(ids) || ',"duplicates":' || duplicates || '}}' AS event FROM pub""",
    ),
)
def publish_events(spark, sf):
    published = tasks(spark, sf).groupBy(F.col("transcript_reference").alias("transcript_id")).agg(
        F.min("project_id").alias("project_id"), F.array_sort(F.collect_list("id")).alias("task_ids"), (F.count(F.lit(1)) - F.countDistinct("title")).alias("duplicates")
    )
    return notifications.publish_events(published).select("transcript_id", "event")
