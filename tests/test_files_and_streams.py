"""Sources, sinks and the streaming operators on small folders."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gavel.operators import board, mutations, results
from gavel.plans.meeting_tasks import extract_tasks
from gavel.sources import collections, files
from gavel.streaming import ingest

TEXTS = {
    "planning one": "Mara: I will draft the launch plan by Monday.\nTheo: Sure.\nTheo: We need to send the report today.",
    "retro+1": "Wei: Please update the wiki page tomorrow.",
    "empty": " \n",
}


def write_texts(folder, names=TEXTS):
    for name in names:
        (folder / f"{name}.txt").write_text(TEXTS[name], encoding="utf-8")


def test_read_transcripts(spark, tmp_path, rows):
    write_texts(tmp_path)
    (tmp_path / "notes.md").write_text("no")
    assert rows(files.read_transcripts(spark, str(tmp_path))) == sorted(TEXTS.items())


def test_upload_checks(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(files.lx, "MAX_UPLOAD_BYTES", 20)
    (tmp_path / "ok.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "loud.TXT").write_bytes(b"loud")
    (tmp_path / "big.txt").write_bytes(b"x" * 21)
    (tmp_path / "image.png").write_bytes(b"1")
    assert rows(files.read_uploads(spark, str(tmp_path)), "meeting_id", "error", "raw_text") == [
        ("big", "File too large.", None), ("image.png", "Only .txt files are supported.", None), ("loud.TXT", "Only .txt files are supported.", None), ("ok", None, "caf� ok"),
    ]


def test_stage_files_and_contract(spark, tmp_path, rows):
    write_texts(tmp_path)
    stages = extract_tasks(files.read_transcripts(spark, str(tmp_path)))
    for name, df in (("processed", stages.sentences), ("decisions", stages.detections), ("extractions", stages.extractions), ("outputs", stages.tasks)):
        files.write_stage(df, name, str(tmp_path / "out"), per_meeting=name == "outputs")
    back = spark.read.json(str(tmp_path / "out" / "outputs"))
    assert rows(back, "meeting_id", "task_id") == rows(stages.tasks, "meeting_id", "task_id")
    files.write_contract(stages.contract, str(tmp_path / "contract"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "contract")).collect()]
    assert {x["meeting_id"] for x in lines} == set(TEXTS)
    assert all(x["summary"] == {"summary_text": None} and isinstance(x["action_items"], list) for x in lines)
    assert all(set(i) == {"title", "description", "assignee", "deadline"} for x in lines for i in x["action_items"])


def test_gold_and_predictions(spark, tmp_path, rows):
    (tmp_path / "m1_tasks_gold.json").write_text(json.dumps([{"task": "Plan", "assignee": "Mara"}, {"task": "Send"}]))
    (tmp_path / "m1_decisions_gold.json").write_text(json.dumps([{"text": "We go", "is_decision": True}]))
    (tmp_path / "m2_tasks.json").write_text(json.dumps([{"task_id": "task_1", "task": "Plan", "confidence": 0.9}]))
    assert rows(files.read_gold_tasks(spark, str(tmp_path)), "meeting_id", "task", "assignee") == [("m1", "Plan", "Mara"), ("m1", "Send", None)]
    assert rows(files.read_gold_decisions(spark, str(tmp_path)), "meeting_id", "text", "is_decision") == [("m1", "We go", True)]
    assert rows(files.read_predictions(spark, str(tmp_path)), "meeting_id", "task_id", "confidence") == [("m2", "task_1", 0.9)]


def test_collections(spark, tmp_path, rows):
    root = str(tmp_path)
    kind = "id string, user_id string, message string, type string, read boolean, created_at timestamp"
    table = spark.createDataFrame([("a", "u", "hello", "INFO", False, None), ("b", "u", "bye", "INFO", True, None)], kind)
    collections.write_collection(table, root, "notifications")
    stored = collections.read_collection(spark, root, "notifications")
    assert rows(collections.get_by_id(stored, "b"), "message") == [("bye",)]
    saved = collections.save(stored, table.where("id = 'b'").withColumn("message", F.lit("new")))
    assert rows(saved, "id", "message") == [("a", "hello"), ("b", "new")]
    assert collections.insert(stored, table.limit(1)).count() == 3


def test_streamed_uploads_equal_the_batch(spark, tmp_path, rows):
    landing, out = tmp_path / "landing", tmp_path / "tasks"
    landing.mkdir()

    def sink(tasks, batch_id):
        tasks.select("meeting_id", "task_id", "task", "assignee", "deadline").write.mode("overwrite").json(str(out / f"batch={batch_id}"))

    def run():
        uploads = ingest.landing_stream(spark, str(landing), files_per_batch=1)
        ingest.run_transcripts(uploads, sink, str(tmp_path / "checkpoint")).awaitTermination()

    write_texts(landing, ["planning one"])
    run()
    write_texts(landing, ["retro+1"])
    run()
    got = rows(spark.read.json(str(out)), "meeting_id", "task_id", "task", "assignee", "deadline")
    batch = extract_tasks(files.read_transcripts(spark, str(landing))).tasks
    assert got == rows(batch, "meeting_id", "task_id", "task", "assignee", "deadline") and len(got) == 3


def test_refused_uploads_reach_their_sink(spark, tmp_path, rows):
    landing = tmp_path / "landing"
    landing.mkdir()
    write_texts(landing, ["planning one"])
    (landing / "notes.pdf").write_text("x")
    (landing / "LOUD.TXT").write_text("Mara: I will send it.")
    seen = []

    def rejects(uploads, batch_id):
        seen.extend((r.path.rsplit("/", 1)[1], r.error) for r in uploads.collect())

    uploads = ingest.landing_stream(spark, str(landing))
    ingest.run_transcripts(uploads, lambda tasks, batch_id: None, str(tmp_path / "checkpoint"), rejects=rejects).awaitTermination()
    assert sorted(seen) == [(n, "Only .txt files are supported.") for n in ("LOUD.TXT", "notes.pdf")]


def test_a_killed_batch_is_replayed_exactly_once(spark, tmp_path, rows, monkeypatch):
    landing = tmp_path / "landing"
    landing.mkdir()
    write_texts(landing, ["planning one"])
    (landing / "notes.pdf").write_text("x")
    ledger = ingest.BatchLedger(spark, str(tmp_path / "out"))
    run = lambda: ingest.run_into_ledger(ingest.landing_stream(spark, str(landing)), ledger, str(tmp_path / "checkpoint")).awaitTermination()
    commit = ingest.BatchLedger.commit

    def killed(self, batch_id):
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(ingest.BatchLedger, "commit", killed)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    assert ledger.read("tasks") is None and (tmp_path / "out" / "tasks" / "batch=0").exists()
    monkeypatch.setattr(ingest.BatchLedger, "commit", commit)
    run()
    want = rows(extract_tasks(files.read_transcripts(spark, str(landing)).where("meeting_id = 'planning one'")).tasks, "meeting_id", "task_id", "task")
    assert rows(ledger.read("tasks"), "meeting_id", "task_id", "task") == want and want
    assert [r.error for r in ledger.read("rejects").collect()] == ["Only .txt files are supported."]
    (landing / "more.txt").write_text("Mara: I will send the report by Friday.")
    (landing / "planning one.TXT").write_text("x")
    run()
    assert rows(ledger.read("meetings"), "meeting_id") == [("more",), ("planning one",)]
    assert [r for r in rows(ledger.read("tasks"), "meeting_id", "task_id", "task") if r[0] == "planning one"] == want
    ledger.write("tasks", ledger.read("tasks").limit(0).drop("batch"), 7)  # not committed: nobody sees it
    assert {r.batch for r in ledger.read("tasks").select("batch").distinct().collect()} <= {0, 1}


def test_deadline_texts(spark):
    texts = {"2024-03-05": "2024-03-05", "05-03-2024": "2024-03-05", "05/03/2024": "2024-03-05", "05-03/2024": "2024-03-05", "2024-03-05T10:00:00": "2024-03-05", "31-02-2024": None, "soon": None, "5/3/2024": None}
    texts |= {"Mar 5, 2024": "2024-03-05", "5 march 2024": "2024-03-05", "Tue, 05 Mar 2024 10:00:00 GMT": "2024-03-05", "Tue Mar 05 2024": "2024-03-05", "Feb 31, 2024": None, "xyz 5, 2024": None, "5-Mar-2024": "2024-03-05", "march": None}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", board.parse_deadline(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in found} == texts


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Drivers started elsewhere, with the package on their own path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from gavel.session import local_session\nfrom __spark_entry__ import queries\n"
        "spark = local_session('2', 2)\n"
        "print('rows', [queries()[q](spark, '/root/testdata/sf0.001').count() for q in ('similar_pairs_i2_i3', 'decision_clusters_o2')])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [" in done.stdout, done.stderr[-2000:]


def stream_of(spark, tmp_path, name, data, schema):
    """One file per row set, read as a stream in order."""
    folder = tmp_path / name
    for i, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(folder / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(folder))


def test_admission_drops_repeats(spark, tmp_path):
    from datetime import datetime

    t = lambda m: datetime(2024, 1, 1, 8, m)
    stream = stream_of(spark, tmp_path, "req", [[("a", t(1)), ("a", t(2)), ("b", t(3))]], "transcript_id string, requested_at timestamp")
    q = ingest.admitted(stream).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.transcript_id for r in spark.table("admitted").collect()) == ["a", "b"]


def test_latest_states_in_update_mode(spark, tmp_path):
    from datetime import datetime

    t = lambda m: datetime(2024, 1, 1, 8, m)
    kind = "job_id string, status string, current_step int, updated_at timestamp"
    stream = stream_of(spark, tmp_path, "log", [[("j", "running", 1, t(1)), ("j", "completed", 5, t(9)), ("j", "running", 3, t(4))]], kind)
    q = ingest.latest_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.job_id, r.status, r.current_step) for r in spark.table("states").collect()] == [("j", "completed", 5)]


# --- results and changes -------------------------------------------------------------------------------


def test_publish_first_and_second_run(spark, rows):
    board = spark.createDataFrame(
        [], "id string, transcript_reference string, title string, description string, assignee_id string, due_date date, status string, priority string, is_manual boolean"
    )
    kind = "transcript_id string, pos int, title string, description string, assignee string, deadline string"
    account = "a" * 24
    first = spark.createDataFrame(
        [("t", 1, "Plan", "one", account, "2024-05-01"), ("t", 2, " plan ", "two", None, None), ("t", 3, "  ", "x", None, None), ("t", 4, None, "", "bad", "soon")], kind
    )
    changes = mutations.publish_changes(board, first)
    assert rows(changes, "pos", "title", "action") == [(1, "Plan", "created"), (2, "plan", "duplicate"), (4, "Untitled", "created")]
    after = mutations.apply_publish(board, changes, F.concat_ws("/", "transcript_id", "title_key"))
    assert rows(after, "id", "description", "assignee_id") == [("t/plan", "one", account), ("t/untitled", "", None)]
    second = spark.createDataFrame(
        [("t", 1, "Plan", "one", account, "2024-05-01"), ("t", 2, "PLAN", "changed", None, None), ("t", 3, "Extra", "n", None, None), ("t", 4, "extra", "last", None, None)], kind
    )
    changes = mutations.publish_changes(after, second)
    assert rows(changes, "pos", "action") == [(1, "unchanged"), (2, "updated"), (3, "created"), (4, "updated")]
    final = mutations.apply_publish(after, changes, F.concat_ws("/", "transcript_id", "title_key"))
    assert rows(final, "id", "title", "description") == [("t/extra", "Extra", "last"), ("t/plan", "Plan", "changed"), ("t/untitled", "Untitled", "")]


def test_output_validation_keeps_good_parts(spark, rows):
    raw = [
        '{"summary": {"summary_text": "ok"}, "action_items": [{"title": "A"}, {"title": ""}, "x", {"assignee": "B"}]}',
        '{"action_items": null}', '{"summary": 3}', '"text"', "not json",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    out = results.validate_outputs(df)
    assert rows(out, "id", "error", "n_dropped") == [
        (0, None, 3), (1, None, 0), (2, "summary must be an object", 0), (3, "output must be an object", 0), (4, "output must be an object", 0),
    ]


def test_assignee_prefix_and_ties(spark, rows):
    users = spark.createDataFrame(
        [(3, "ann.lee@x.org", "Ann Lee"), (1, "ann.kay@x.org", "Ann Kay"), (2, "lee@x.org", "ann lee")], "id int, email string, full_name string"
    )
    items = spark.createDataFrame([(0, " ANN LEE "), (1, "ann"), (2, "zed"), (3, None), (4, "")], "i int, assignee string")
    assert rows(results.resolve_assignees(items, users), "i", "assignee_id") == [(0, 2), (1, 1), (2, None), (3, None), (4, None)]
