"""Explicit schemas of files and tables; every optional field is a nullable column."""

GOLD_TASKS = (
    "task string, assignee string, deadline string, priority string, source_sentence string, "
    "meeting_id string, annotator_id string, confidence double"
)
GOLD_DECISIONS = (
    "decision string, speaker string, timestamp string, vote_result string, source_sentence string, "
    "meeting_id string, annotator_id string, confidence double, text string, is_decision boolean, decision_type string"
)
EVIDENCE = "struct<text:string,speaker:string,sentence_type:string,hard_filtered:boolean>"
TASKS = (
    "task_id string, task string, assignee string, deadline string, confidence double, "
    f"evidence {EVIDENCE}, requires_manual_review boolean"
)
SENTENCES = (
    "meeting_id string, sentence_id int, turn_id int, speaker string, timestamp string, text string, "
    "root_verb string, object string, subject string"
)
MEMBERS = "array<struct<user_id:string,role:string,joined_at:timestamp>>"
USERS = (
    "id string, email string, full_name string, role string, avatar string, is_active boolean, "
    "created_at timestamp, updated_at timestamp"
)
TEAMS = f"id string, workspace_id string, name string, description string, created_by string, members {MEMBERS}"
WORKSPACES = f"id string, name string, slug string, created_by string, members {MEMBERS}"
PROJECTS = (
    "id string, team_id string, owner_id string, name string, description string, "
    "members array<struct<user_id:string,joined_at:timestamp>>, is_archived boolean, created_by string, "
    "created_at timestamp, updated_at timestamp"
)
SUGGESTIONS = (
    "id string, meeting_id string, transcript_id string, suggested_title string, suggested_description string, "
    "suggested_assignee_name string, suggested_deadline date, speaker string, transcript_quote string, "
    "transcript_timestamp string, review_status string, reviewed_by string, task_id string, "
    "created_at timestamp, updated_at timestamp"
)
BOARD_TASKS = (
    "id string, project_id string, team_id string, meeting_id string, task_suggestion_id string, "
    "transcript_reference string, title string, description string, status string, priority string, "
    "assignee_id string, owner_id string, created_by string, due_date date, is_manual boolean, position int, "
    "evidence array<struct<id:string,transcript_id:string,speaker:string,transcript_timestamp:string,quote:string,created_at:timestamp>>, "
    "subtasks array<struct<id:string,title:string,description:string,status:string,assignee_id:string,created_by:string,created_at:timestamp,updated_at:timestamp>>, "
    "notes array<struct<id:string,content:string,created_by:string,created_at:timestamp>>, "
    "status_history array<struct<old_status:string,new_status:string,changed_by:string,changed_at:timestamp>>, "
    "created_at timestamp, updated_at timestamp"
)
JOBS = (
    "id string, transcript_id string, project_id string, requester_id string, status string, current_step int, "
    "step_label string, summary string, action_item_ids array<string>, error_message string, "
    "cancel_requested boolean, created_at timestamp, updated_at timestamp"
)
NOTIFICATIONS = "id string, user_id string, message string, type string, read boolean, created_at timestamp"
COLLECTIONS = {
    "users": USERS, "teams": TEAMS, "workspaces": WORKSPACES, "projects": PROJECTS,
    "suggestions": SUGGESTIONS, "tasks": BOARD_TASKS, "jobs": JOBS, "notifications": NOTIFICATIONS,
}
