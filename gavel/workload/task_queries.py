"""Queries over detections, extractions, tasks, duplicates, evaluation and clusters (inventory E to J, O)."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions import signals as sg
from gavel.functions import text as tx
from gavel.functions.similarity import cosine, levenshtein_ratio
from gavel.operators import clusters, dedup, detection, evaluation, extraction, tasks
from gavel.operators.context import meeting_types
from gavel.plans.meeting_tasks import extract_tasks, prepare, tasks_from_turns
from gavel.workload import checks as ck
from gavel.workload.bank import NAMES, PHRASES, _pick, call_scores, calls, standups
from gavel.workload.registry import query, table
from gavel.workload.text_queries import call_known, call_rows, call_sentences, joined, standup_sentences

def typed_calls(sentences, rows):
    """Resolved sentences with their meeting's type."""
    types = meeting_types(sentences, rows).select("meeting_id", "meeting_type")
    return prepare(sentences, rows=rows).join(types, "meeting_id")


# --- E -------------------------------------------------------------------------------------------------
CALL_KEPT = ck.CALL_SENTENCES


@query(
    "rule_detection_e1",
    ck.with_ctes(
        *CALL_KEPT,
        select=f"SELECT meeting_id, sentence_id, {ck.ACTIONABLE} AS is_decision, CASE WHEN {ck.ACTIONABLE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, 'rule_based' AS method FROM kept",
    ),
)
def rule_detection(spark, sf):
    return detection.detect(call_sentences(spark, sf)).select("meeting_id", "sentence_id", "is_decision", "confidence", "method")


@query(
    "hard_filter_e2",
    ck.with_ctes(ck.CALLS, ck.SENTENCES, ck.CLEANED, select=f"SELECT meeting_id, sentence_id, {ck.HARD} AS hard_filtered FROM cleaned"),
)
def hard_filter(spark, sf):
    split = calls(spark, sf).withColumn("_parts", tx.split_sentences(F.col("text")))
    placed = ordered.running_total(
        split, ["meeting_id"], "turn_id", {"_through": F.size("_parts")}, call_rows(spark, sf)
    )
    return placed.select("*", F.posexplode("_parts").alias("i", "s")).select(
        "meeting_id", (F.col("_through") - F.size("_parts") + F.col("i") + 1).alias("sentence_id"),
        sg.is_hard_filtered(tx.clean(F.col("s"))).alias("hard_filtered"),
    )


@query(
    "sentence_features_e3_e8",
    ck.with_ctes(
        *ck.CALL_RESOLVED, ck.MEETING_TYPES, ck.FEATURES,
        select="SELECT meeting_id, sentence_id, modal, modal_boost, downward_prior, tense_prior, has_negation FROM features",
    ),
)
def sentence_features(spark, sf):
    s = call_known(spark, sf)
    typed = typed_calls(s, call_rows(spark, sf))
    return detection.with_features(typed).select(
        "meeting_id", "sentence_id", "modal", "modal_boost", "downward_prior", "tense_prior", "has_negation"
    )


@query(
    "requests_and_acceptances_e9_e10",
    ck.with_ctes(*CALL_KEPT, select=f"SELECT meeting_id, sentence_id, {ck.REQUEST} AS is_request, {ck.ACCEPTANCE} AS is_acceptance FROM kept"),
)
def requests_and_acceptances(spark, sf):
    t = F.col("text")
    return call_sentences(spark, sf).select(
        "meeting_id", "sentence_id", sg.is_request(t).alias("is_request"), sg.is_acceptance(t).alias("is_acceptance")
    )


@query(
    "class_scores_e11",
    "SELECT vec_id, " + ck._class("a", "b", "c") + " AS kind, round(greatest(a, b, c) / (a + b + c), 9) AS score FROM "
    "(SELECT vec_id, " + ", ".join(f"list_sum(list_transform(embedding[{a}:{b}], lambda x: abs(x::DOUBLE))) AS {n}" for n, a, b in (("a", 1, 21), ("b", 22, 42), ("c", 43, 64))) + " FROM embeddings)",
)
def class_scores(spark, sf):
    third = lambda a, n: F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    p = [third(1, 21), third(22, 21), third(43, 22)]
    kind, score = sg.class_scores(*p)
    return table(spark, sf, "embeddings").select("vec_id", kind.alias("kind"), F.round(score, 9).alias("score"))


@query(
    "hybrid_detection_e12_e17",
    ck.with_ctes(
        *ck.CALL_HYBRID,
        select="SELECT meeting_id, sentence_id, is_decision, round(confidence, 9) AS confidence, confidence_zone, "
        "CASE WHEN hard THEN 'rule_based' ELSE 'hybrid' END AS method, CASE WHEN hard THEN true END AS hard_filtered, "
        "NOT hard AND zone = 'review' AS requires_manual_review, CASE WHEN NOT hard THEN kind END AS transformer_decision_type, "
        "CASE WHEN NOT hard THEN round(base, 9) END AS transformer_confidence, CASE WHEN NOT hard THEN ctx_kind END AS context_decision_type, "
        "CASE WHEN NOT hard THEN modal_boost END AS modal_boost, CASE WHEN pair THEN true END AS is_turn_pair_acceptance, "
        "CASE WHEN pair THEN CAST(ord - 1 AS INTEGER) END AS paired_request_idx FROM detected",
    ),
)
def hybrid_detection(spark, sf):
    s = call_known(spark, sf)
    typed = typed_calls(s, call_rows(spark, sf))
    found = detection.detect(typed, "hybrid", call_scores(s))
    return found.select(
        "meeting_id", "sentence_id", "is_decision", F.round("confidence", 9).alias("confidence"), "confidence_zone", "method",
        "hard_filtered", "requires_manual_review", "transformer_decision_type",
        F.round("transformer_confidence", 9).alias("transformer_confidence"), "context_decision_type", "modal_boost",
        "is_turn_pair_acceptance", "paired_request_idx",
    )


# --- F, G, H -------------------------------------------------------------------------------------------


@query(
    "assignees_and_deadlines_f1_f6",
    ck.with_ctes(
        *ck.STANDUP_RESOLVED, ck.MEETING_TYPES, ck.RULE, ck.EXTRACTED,
        select="SELECT meeting_id, sentence_id, text AS raw_text, assignee, deadline, root_verb, object, speaker AS evidence_speaker, sentence_type AS evidence_type FROM extracted",
    ),
)
def assignees_and_deadlines(spark, sf):
    out = extraction.extract(detection.detect(prepare(standup_sentences(spark, sf))))
    return out.select(
        "meeting_id", F.col("sentence_id").cast("long").alias("sentence_id"), "raw_text", "assignee", "deadline", "root_verb", "object",
        F.col("evidence.speaker").alias("evidence_speaker"), F.col("evidence.sentence_type").alias("evidence_type"),
    )


_answer = f"CASE sentence_id % 4 WHEN 0 THEN 'participant' WHEN 1 THEN ' ' WHEN 2 THEN 'Dana ' ELSE NULL END"


@query(
    "assignee_answers_f2",
    ck.with_ctes(
        *ck.CALL_RULE, ck.EXTRACTED,
        select="SELECT meeting_id, sentence_id, CASE WHEN who IN ('i', 'me') THEN speaker WHEN lead_speaker IS NOT NULL THEN lead_speaker WHEN who IN "
        f"{ck.in_list(lx.TEAM_SUBJECTS)} THEN 'team' WHEN mentioned_speaker IS NOT NULL THEN mentioned_speaker WHEN sentence_id % 4 = 2 THEN 'Dana' ELSE speaker END AS assignee FROM extracted",
    ),
)
def assignee_answers(spark, sf):
    n = F.col("sentence_id") % 4
    answered = detection.detect(prepare(call_known(spark, sf), rows=call_rows(spark, sf))).withColumn(
        "qa_answer", F.when(n == 0, "participant").when(n == 1, " ").when(n == 2, "Dana ")
    )
    return extraction.extract(answered).select("meeting_id", "sentence_id", "assignee")


@query(
    "deadlines_f3_f4",
    ck.with_ctes(*CALL_KEPT, select=f"SELECT meeting_id, sentence_id, {ck.deadline_sql('text')} AS deadline FROM kept"),
)
def deadlines(spark, sf):
    return call_sentences(spark, sf).select("meeting_id", "sentence_id", sg.deadline(F.col("text")).alias("deadline"))


@query(
    "entity_deadlines_f5",
    ck.with_ctes(
        *CALL_KEPT,
        select="SELECT meeting_id, sentence_id, coalesce(list_filter(CASE WHEN sentence_id % 2 = 0 THEN ['last week', 'Friday'] ELSE ['ok'] END, "
        f"lambda d: {ck.VALID_DEADLINE})[1], {ck.deadline_sql('text')}) AS deadline FROM kept",
    ),
)
def entity_deadlines(spark, sf):
    entities = F.when(F.col("sentence_id") % 2 == 0, F.array(F.lit("last week"), F.lit("Friday"))).otherwise(F.array(F.lit("ok")))
    return call_sentences(spark, sf).select("meeting_id", "sentence_id", sg.deadline(F.col("text"), entities).alias("deadline"))


@query(
    "extraction_stats_f7",
    ck.with_ctes(
        *ck.CALL_HYBRID, ck.EXTRACTED,
        select="SELECT meeting_id, count(*) AS n_definitions, count(assignee) AS n_with_assignee, count(deadline) AS n_with_deadline, "
        "round(avg(confidence), 9) AS avg_confidence, round(avg(CASE WHEN NOT hard AND modal_boost > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS modal_share FROM extracted GROUP BY meeting_id",
    ),
)
def extraction_stats(spark, sf):
    s = call_known(spark, sf)
    typed = typed_calls(s, call_rows(spark, sf))
    stats = extraction.extraction_stats(extraction.extract(detection.detect(typed, "hybrid", call_scores(s))))
    return stats.withColumns({c: F.round(c, 9) for c in ("avg_confidence", "modal_share")})


@query(
    "triplet_titles_g1_g2",
    ck.with_ctes(
        *ck.CALL_RULE, ck.EXTRACTED, ck.TITLED,
        select="SELECT meeting_id, sentence_id, trip AS title, trip IS NOT NULL AND "
        f"{ck.valid_title('trip')} AND NOT (coalesce(root_verb, '') IN {ck.in_list(lx.WEAK_TITLE_VERBS)} AND lower(coalesce(object, '')) IN {ck.in_list(lx.EMPTY_OBJECTS + [''])}) AS valid FROM titles1",
    ),
)
def triplet_titles(spark, sf):
    out = extraction.extract(detection.detect(prepare(call_known(spark, sf), rows=call_rows(spark, sf))))
    title = tx.triplet_title(F.col("root_verb"), F.col("object"))
    return out.select(
        "meeting_id", "sentence_id", title.alias("title"), tx.is_valid_title(title, F.col("root_verb"), F.col("object")).alias("valid")
    )


@query(
    "rule_titles_g3_g4",
    ck.with_ctes(
        ck.CALLS, f"cut AS (SELECT turn_id, {ck.rule_title('text')} AS t FROM turns)",
        f"done AS (SELECT turn_id, {ck.finish_title('t')} AS title FROM cut)",
        select=f"SELECT turn_id, title, {ck.valid_title('title')} AS valid FROM done",
    ),
)
def rule_titles(spark, sf):
    title = tx.rule_based_title(F.col("text"))
    return tx.once(calls(spark, sf).select("turn_id", "text"), "title", title).select(
        "turn_id", "title", tx.is_valid_title(F.col("title")).alias("valid")
    )


@query(
    "generated_titles_g5_g6",
    ck.with_ctes(
        *ck.CALL_RULE, ck.EXTRACTED,
        ck.TITLED.replace("THEN trip ELSE ruled END", "THEN trip WHEN len(" + ck.split_ws("generated") + ") >= 3 AND NOT "
                          + ck.like_re("generated", ck.alt(lx.NON_TASK_SENTENCES)) + " AND " + ck.like_re("generated", lx.GENERATED_TASK_VERBS)
                          + " THEN generated ELSE ruled END").replace(
            "FROM titles1)", "FROM (SELECT *, CASE WHEN sentence_id % 2 = 0 THEN 'Great ' || text ELSE 'Prepare: ' || text END AS generated FROM titles1))", 1),
        select="SELECT meeting_id, task_id, task FROM built",
    ),
)
def generated_titles(spark, sf):
    out = detection.detect(prepare(call_known(spark, sf), rows=call_rows(spark, sf)))
    lead = F.when(F.col("sentence_id") % 2 == 0, "Great ").otherwise("Prepare: ")
    extracted = extraction.extract(out.withColumn("generated", F.concat(lead, F.col("text"))))
    built = tasks.build_tasks(extracted, call_rows(spark, sf))
    return built.select("meeting_id", "task_id", "task")


@query(
    "scored_tasks_h1_h3",
    ck.with_ctes(
        *ck.CALL_RULE, ck.EXTRACTED, ck.TITLED, ck.TASKS,
        select="SELECT meeting_id, task_id, task, assignee, deadline, task_confidence AS confidence, CASE WHEN task_confidence >= 0.5 AND task_confidence < 0.7 THEN true END AS requires_manual_review FROM valid",
    ),
)
def scored_tasks(spark, sf):
    s = call_known(spark, sf)
    typed = typed_calls(s, call_rows(spark, sf))
    built = tasks.build_tasks(extraction.extract(detection.detect(typed)), call_rows(spark, sf))
    return tasks.validate_tasks(tasks.score_tasks(built)).select(
        "meeting_id", "task_id", "task", "assignee", "deadline", "confidence", "requires_manual_review"
    )


@query(
    "reviewed_tasks_h1_h3",
    ck.with_ctes(
        *ck.CALL_HYBRID, ck.EXTRACTED, ck.TITLED,
        ck.TASKS.replace("1::DOUBLE * 0.5::DOUBLE +", "confidence * 0.5::DOUBLE +"),
        select="SELECT meeting_id, task_id, round(task_confidence, 9) AS confidence, CASE WHEN task_confidence >= 0.5 AND task_confidence < 0.7 THEN true END AS requires_manual_review FROM valid",
    ),
)
def reviewed_tasks(spark, sf):
    s = call_known(spark, sf)
    typed = typed_calls(s, call_rows(spark, sf))
    built = tasks.build_tasks(extraction.extract(detection.detect(typed, "hybrid", call_scores(s))), call_rows(spark, sf))
    valid = tasks.validate_tasks(tasks.score_tasks(built, "detection_confidence"))
    return valid.select("meeting_id", "task_id", F.round("confidence", 9).alias("confidence"), "requires_manual_review")


TASK_SQL = "SELECT meeting_id, task_id, task, assignee, deadline, task_confidence AS confidence FROM tasks"


@query("action_items_of_standups", ck.with_ctes(*ck.STANDUP_TASKS, select=TASK_SQL))
def action_items_of_standups(spark, sf):
    return extract_tasks(standups(spark, sf)).tasks.select("meeting_id", "task_id", "task", "assignee", "deadline", "confidence")


@query("unique_titles_i1", ck.with_ctes(*ck.CALL_RULE, ck.EXTRACTED, ck.TITLED, ck.TASKS, select=TASK_SQL))
def unique_titles(spark, sf):
    return tasks_from_turns(calls(spark, sf)).tasks.select("meeting_id", "task_id", "task", "assignee", "deadline", "confidence")


@query(
    "contracts_a8",
    ck.with_ctes(
        *ck.STANDUP_TASKS,
        select="SELECT r.meeting_id, count(t.task) AS n_items, coalesce(string_agg(t.task || '/' || coalesce(t.assignee, '') || '/' || coalesce(t.deadline, ''), '|' ORDER BY t.ord), '') AS items, "
        "CAST(NULL AS VARCHAR) AS summary_text FROM raw r LEFT JOIN tasks t USING (meeting_id) GROUP BY r.meeting_id",
    ),
)
def contracts(spark, sf):
    contract = extract_tasks(standups(spark, sf)).contract
    line = F.transform(
        "action_items",
        lambda i: F.concat(i["title"], F.lit("/"), F.coalesce(i["assignee"], F.lit("")), F.lit("/"), F.coalesce(i["deadline"], F.lit(""))),
    )
    return contract.select(
        "meeting_id", F.size("action_items").cast("long").alias("n_items"), joined(line).alias("items"), "summary.summary_text"
    )


# --- I -------------------------------------------------------------------------------------------------
# Each given vector and two near copies of it, at the operators' own thresholds.
def _copies_sql(k: str) -> str:
    return f"list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.1 * {k} * ((i - 1) % 3 - 1)))"


def near_copy(k):
    return F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (1 + F.lit(0.1) * k * (i % 3 - 1)))


VECTORS = (
    f"vecs AS (SELECT label AS meeting_id, vec_id * 3 + k AS ord, {_copies_sql('k')} AS v, 'task ' || (vec_id * 3 + k) AS task, "
    "(((vec_id * 3 + k) * 7) % 10) / 10.0::DOUBLE AS confidence FROM embeddings, (SELECT unnest([0, 1, 2]) AS k))"
)
VECTOR_CUT = lx.DUPLICATE_SIMILARITY


def vector_tasks(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    v = F.col("vec_id") * 3 + F.col("k")
    return rows.select(
        F.col("label").alias("meeting_id"), v.alias("ord"), near_copy(F.col("k")).alias("v"),
        F.concat(F.lit("task "), v).alias("task"), ((v * 7) % 10 / F.lit(10.0)).alias("confidence"),
    )


PAIRS = (
    "pairs AS (SELECT a.meeting_id, a.ord AS lo, b.ord AS hi, list_cosine_similarity(a.v, b.v) AS similarity FROM vecs a JOIN vecs b "
    f"ON a.meeting_id = b.meeting_id AND a.ord < b.ord WHERE list_cosine_similarity(a.v, b.v) >= {VECTOR_CUT})"
)


@query(
    "similar_pairs_i2_i3",
    ck.with_ctes(VECTORS, PAIRS, select="SELECT meeting_id, lo, hi, round(similarity, 6) AS similarity FROM pairs"),
)
def similar_task_pairs(spark, sf):
    pairs = dedup.duplicate_pairs(vector_tasks(spark, sf), ["meeting_id"], VECTOR_CUT, "v")
    return pairs.select("meeting_id", "lo", "hi", F.round("similarity", 6).alias("similarity"))


SEEDS = (
    "nodes AS (SELECT meeting_id, ord, confidence, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS n FROM vecs), "
    "walk AS (SELECT meeting_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS seeds FROM (SELECT DISTINCT meeting_id FROM vecs) "
    "UNION ALL SELECT w.meeting_id, w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.meeting_id = w.meeting_id AND p.hi = k.ord AND list_contains(w.seeds, p.lo)) "
    "THEN w.seeds ELSE list_append(w.seeds, k.ord) END FROM walk w JOIN nodes k ON k.meeting_id = w.meeting_id AND k.n = w.n + 1), "
    "seeded AS (SELECT meeting_id, unnest(seeds) AS seed FROM walk QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC) = 1), "
    "owned AS (SELECT v.meeting_id, v.ord, v.confidence, coalesce((SELECT min(p.lo) FROM pairs p JOIN seeded s ON s.meeting_id = p.meeting_id AND s.seed = p.lo "
    "WHERE p.meeting_id = v.meeting_id AND p.hi = v.ord), v.ord) AS seed FROM vecs v)"
)


@query(
    "greedy_dedup_i4",
    "WITH RECURSIVE " + ",\n".join([VECTORS, PAIRS, SEEDS])
    + "\nSELECT meeting_id, ord, confidence FROM owned QUALIFY row_number() OVER (PARTITION BY meeting_id, seed ORDER BY confidence DESC, ord) = 1",
)
def greedy_dedup(spark, sf):
    return dedup.drop_similar(vector_tasks(spark, sf), VECTOR_CUT, "v").select("meeting_id", "ord", "confidence")


@query("text_dedup_i4")
def text_dedup(spark, sf):
    return tasks_from_turns(calls(spark, sf), semantic=True).tasks.select("meeting_id", "task_id", "task", "confidence")


@query(
    "near_titles_i5",
    "WITH said AS (SELECT text FROM conversations UNION ALL SELECT regexp_replace(text, '\\s+\\S+$', '') FROM conversations), "
    "t AS (SELECT DISTINCT lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS title FROM said), "
    "w AS (SELECT DISTINCT title, unnest(string_split_regex(title, '\\s+')) AS w FROM t WHERE title <> ''), n AS (SELECT title, count(*) AS n FROM w GROUP BY 1), "
    "p AS (SELECT x.title AS a, y.title AS b, count(*) AS s FROM w x JOIN w y ON x.w = y.w AND x.title < y.title GROUP BY 1, 2) "
    "SELECT md5(a) AS a, md5(b) AS b, s::DOUBLE / (na.n + nb.n - s)::DOUBLE AS similarity FROM p JOIN n na ON na.title = a JOIN n nb ON nb.title = b WHERE s::DOUBLE / (na.n + nb.n - s)::DOUBLE >= 0.8",
)
def near_titles(spark, sf):
    said = table(spark, sf, "conversations").select(F.col("text").alias("task"))
    shorter = said.select(F.regexp_replace("task", r"\s+\S+$", "").alias("task"))
    found = dedup.near_titles(said.unionByName(shorter))
    return found.select(F.md5("a").alias("a"), F.md5("b").alias("b"), "similarity")


# --- J -------------------------------------------------------------------------------------------------
JUDGED = (
    "pred AS (SELECT l_suppkey AS meeting_id, l_orderkey * 10 + l_linenumber AS idx, trim(p_name) || CASE WHEN l_linenumber % 3 = 0 THEN '!' ELSE '' END AS task, "
    "l_discount * 10 AS confidence, CASE WHEN l_linenumber < 6 THEN 'Mara' END AS assignee, CASE WHEN l_linenumber % 2 = 0 THEN 'Friday' END AS deadline "
    "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_suppkey % 10 <> 0), "
    "gold AS (SELECT l_suppkey AS meeting_id, l_orderkey * 10 + l_linenumber AS idx, CASE WHEN l_linenumber = 7 THEN ' ' ELSE upper(p_name) END AS task "
    "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' OR l_suppkey % 10 = 0)"
)


def judged_meetings(spark, sf):
    """All meetings have a prediction; those of every tenth supplier an empty one."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("meeting_id"))


def judged(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    keyed = rows.select("*", F.col("l_suppkey").alias("meeting_id"), (F.col("l_orderkey") * 10 + n).alias("idx"))
    pred = keyed.where((F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 10 != 0)).select(
        "meeting_id", "idx", F.concat(F.trim("p_name"), F.when(n % 3 == 0, "!").otherwise("")).alias("task"),
        (F.col("l_discount") * 10).alias("confidence"), F.when(n < 6, "Mara").alias("assignee"), F.when(n % 2 == 0, "Friday").alias("deadline"),
    )
    gold = keyed.where((F.col("l_returnflag") == "R") | (F.col("l_suppkey") % 10 == 0)).select(
        "meeting_id", "idx", F.when(n == 7, " ").otherwise(F.upper("p_name")).alias("task")
    )
    return pred, gold


_prf = (
    "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall"
)
_f1 = "round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1"


def _prf_sql(source: str, keep: str) -> str:
    return (
        f"SELECT {keep}, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, {_f1} FROM (SELECT *, {_prf} FROM {source})"
    )


MATCHED = (
    "pk AS (SELECT meeting_id, lower(trim(task)) AS k, count(*) AS n FROM pred GROUP BY 1, 2), gk AS (SELECT meeting_id, lower(trim(task)) AS k, count(*) AS n FROM gold GROUP BY 1, 2), "
    "sizes AS (SELECT meeting_id, sum(p)::BIGINT AS n_pred, sum(g)::BIGINT AS n_gold FROM (SELECT meeting_id, count(*) AS p, 0 AS g FROM pred GROUP BY 1 UNION ALL SELECT meeting_id, 0, count(*) FROM gold GROUP BY 1) GROUP BY 1), "
    "hits AS (SELECT pk.meeting_id, sum(least(pk.n, gk.n))::BIGINT AS tp FROM pk JOIN gk ON pk.meeting_id = gk.meeting_id AND pk.k = gk.k AND pk.k <> '' GROUP BY 1), "
    "counts AS (SELECT meeting_id, n_pred, n_gold, coalesce(tp, 0) AS tp, CASE WHEN n_pred = 0 OR n_gold = 0 THEN 0 ELSE n_pred - coalesce(tp, 0) END AS fp, CASE WHEN n_pred = 0 OR n_gold = 0 THEN 0 ELSE n_gold - coalesce(tp, 0) END AS fn FROM sizes LEFT JOIN hits USING (meeting_id))"
)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(
    "exact_matching_j1_j4",
    ck.with_ctes(JUDGED, MATCHED, select=_prf_sql("counts", "meeting_id, n_pred, n_gold")),
)
def exact_matching(spark, sf):
    pred, gold = judged(spark, sf)
    counts = evaluation.exact_matches(pred, gold, ["meeting_id"], "task", "task")
    return rounded(evaluation.match_metrics(counts), "precision", "recall", "f1")


@query(
    "edit_distance_match_j2",
    "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE, 9) AS ratio FROM part",
)
def edit_distance_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(levenshtein_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


def walk_sql(candidates: str, left: str) -> str:
    """The greedy matching as a walk over the left side in order: `final(meeting_id, tp)`."""
    return (
        f"cand AS ({candidates}), ordered AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY idx) AS n FROM {left}), "
        f"walk AS (SELECT meeting_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT meeting_id FROM {left}) "
        "UNION ALL SELECT w.meeting_id, w.n + 1, coalesce(list_append(w.used, (SELECT min(c.r) FROM cand c WHERE c.meeting_id = w.meeting_id AND c.l = o.idx AND NOT list_contains(w.used, c.r))), w.used) "
        "FROM walk w JOIN ordered o ON o.meeting_id = w.meeting_id AND o.n = w.n + 1), "
        "final AS (SELECT meeting_id, len(list_filter(used, lambda u: u IS NOT NULL)) AS tp FROM walk QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC) = 1)"
    )


# The text ratios of the few distinct wordings, as a table for the checking SQL.
ALIKE = ", ".join(
    f"({i}, {j})" for i, a in enumerate(PHRASES) for j, b in enumerate(PHRASES)
    if SequenceMatcher(None, a.strip().lower(), f"{b} now".lower()).ratio() >= lx.PARTIAL_MATCH_RATIO
)


@query(
    "partial_matching_j2_j4",
    "WITH RECURSIVE pv AS (SELECT event_id // 8 AS meeting_id, event_id AS idx, event_id * 11 % 64 AS p FROM events), gv AS (SELECT event_id // 8 AS meeting_id, event_id AS idx, event_id * 5 % 64 AS g FROM events), "
    f"alike AS (SELECT * FROM (VALUES {ALIKE}) t(p, g)), "
    + walk_sql("SELECT pv.meeting_id, pv.idx AS l, gv.idx AS r FROM pv JOIN gv ON pv.meeting_id = gv.meeting_id JOIN alike ON alike.p = pv.p AND alike.g = gv.g", "pv")
    + ", counts AS (SELECT meeting_id, tp, n AS n_pred, n AS n_gold, n - tp AS fp, n - tp AS fn FROM final JOIN (SELECT meeting_id, count(*) AS n FROM pv GROUP BY 1) USING (meeting_id)) "
    + _prf_sql("counts", "meeting_id, n_pred, n_gold"),
)
def partial_matching(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.floor(e / 8).alias("meeting_id"), e.alias("idx"))
    pred = rows.withColumn("task", _pick(PHRASES, F.col("idx") * 11 % 64))
    gold = rows.withColumn("task", F.concat(_pick(PHRASES, F.col("idx") * 5 % 64), F.lit(" Now")))
    counts = evaluation.similar_matches(pred, gold, ["meeting_id"], "task", "task", lx.PARTIAL_MATCH_RATIO)
    return rounded(evaluation.match_metrics(counts), "precision", "recall", "f1")


SPLIT_VECTORS = (
    "pv AS (SELECT label AS meeting_id, vec_id AS idx, embedding::DOUBLE[] AS v FROM embeddings), "
    f"gv AS (SELECT label AS meeting_id, vec_id AS idx, {_copies_sql('1')} AS v FROM embeddings)"
)


@query(
    "semantic_pairs_j3",
    ck.with_ctes(
        SPLIT_VECTORS,
        select="SELECT pv.meeting_id, pv.idx AS lo, gv.idx AS hi, round(list_cosine_similarity(pv.v, gv.v), 6) AS similarity FROM pv JOIN gv ON pv.meeting_id = gv.meeting_id "
        f"WHERE list_cosine_similarity(pv.v, gv.v) >= {lx.SEMANTIC_TASK_COSINE}",
    ),
)
def semantic_pairs(spark, sf):
    from gavel.functions.pairs import similar_across

    pred, gold = split_vectors(spark, sf)
    found = similar_across(pred, gold, ["meeting_id"], "v", lx.SEMANTIC_TASK_COSINE, texts=False)
    return found.withColumn("similarity", F.round("similarity", 6))


def split_vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    keyed = lambda v: rows.select(F.col("label").alias("meeting_id"), F.col("vec_id").alias("idx"), v.alias("v"))
    return keyed(F.col("embedding").cast("array<double>")), keyed(near_copy(1))


def vector_candidates(threshold: float) -> str:
    return f"SELECT pv.meeting_id, pv.idx AS l, gv.idx AS r FROM pv JOIN gv ON pv.meeting_id = gv.meeting_id WHERE list_cosine_similarity(pv.v, gv.v) >= {threshold}"


WALK = (
    walk_sql(vector_candidates(lx.SEMANTIC_TASK_COSINE), "pv")
    + ", counts AS (SELECT meeting_id, tp, np - tp AS fp, ng - tp AS fn FROM final JOIN (SELECT meeting_id, count(*) AS np FROM pv GROUP BY 1) USING (meeting_id) JOIN (SELECT meeting_id, count(*) AS ng FROM gv GROUP BY 1) USING (meeting_id))"
)
# Decisions: a meeting in three has no gold, and its predictions count as false positives.
DECISION_WALK = (
    "gold AS (SELECT * FROM gv WHERE meeting_id % 3 <> 0), "
    + walk_sql(vector_candidates(lx.SEMANTIC_DECISION_COSINE).replace("gv", "gold"), "pv")
    + ", counts AS (SELECT meeting_id, tp, np - tp AS fp, coalesce(ng, 0) - tp AS fn FROM final JOIN (SELECT meeting_id, count(*) AS np FROM pv GROUP BY 1) USING (meeting_id) LEFT JOIN (SELECT meeting_id, count(*) AS ng FROM gold GROUP BY 1) USING (meeting_id))"
)


@query("decision_matching_j4", "WITH RECURSIVE " + SPLIT_VECTORS + ", " + DECISION_WALK + " " + _prf_sql("counts", "meeting_id"))
def decision_matching(spark, sf):
    pred, gold = split_vectors(spark, sf)
    counts = evaluation.similar_matches(pred, gold.where("meeting_id % 3 <> 0"), ["meeting_id"], "v", "v", lx.SEMANTIC_DECISION_COSINE, vectors=True)
    measured = evaluation.match_metrics(counts, empty_gold_counts_predictions=True)
    return rounded(measured.drop("n_pred", "n_gold"), "precision", "recall", "f1")


@query("semantic_matching_j3_j4", "WITH RECURSIVE " + SPLIT_VECTORS + ", " + WALK + " " + _prf_sql("counts", "meeting_id"))
def semantic_matching(spark, sf):
    pred, gold = split_vectors(spark, sf)
    counts = evaluation.similar_matches(pred, gold, ["meeting_id"], "v", "v", lx.SEMANTIC_TASK_COSINE, vectors=True)
    return rounded(evaluation.match_metrics(counts).drop("n_pred", "n_gold"), "precision", "recall", "f1")


@query(
    "extraction_quality_j5",
    ck.with_ctes(
        JUDGED,
        select="SELECT meeting_id, round(avg(confidence), 9) AS avg_confidence, round(avg(CASE WHEN assignee IS NOT NULL AND deadline IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS completeness, "
        "round(1 - avg(CASE WHEN assignee IS NOT NULL AND deadline IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS na_rate, count(*) AS total_tasks FROM pred GROUP BY meeting_id",
    ),
)
def extraction_quality(spark, sf):
    return rounded(evaluation.extraction_quality(judged(spark, sf)[0], ["meeting_id"]), "avg_confidence", "completeness", "na_rate")


@query(
    "detection_quality_j6",
    "SELECT l_returnflag, count(*) AS total, round(avg(l_discount * 10), 9) AS avg_confidence, round(avg(CASE WHEN l_discount * 10 > 0.8 THEN 1.0::DOUBLE ELSE 0 END), 9) AS high_confidence FROM lineitem GROUP BY 1",
)
def detection_quality(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("confidence"))
    return rounded(evaluation.detection_quality(rows, ["l_returnflag"]), "avg_confidence", "high_confidence")


@query(
    "sentence_confusion_j7",
    ck.with_ctes(
        "p AS (SELECT doc_id, source, n_chars > 500 AS d, (n_chars % 10) / 10.0::DOUBLE AS c FROM documents), g AS (SELECT doc_id, source, quality = 1 AS d FROM labels JOIN documents USING (doc_id))",
        "j AS (SELECT source, p.d AS p, g.d AS g, p.c FROM p LEFT JOIN g USING (doc_id, source))",
        "counts AS (SELECT source, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn, "
        "round(avg(c), 9) AS avg_confidence, CASE WHEN count(p) <> count(g) THEN 'Predicted and gold lists must have same length' END AS error FROM j GROUP BY source)",
        select=f"SELECT source, tp, fp, fn, tn, avg_confidence, error, tp + tn AS correct, fp + fn AS incorrect, round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn)::DOUBLE ELSE 0 END, 9) AS accuracy, "
        f"round(precision, 9) AS precision, round(recall, 9) AS recall, {_f1} FROM (SELECT *, {_prf} FROM counts)",
    ),
)
def sentence_confusion(spark, sf):
    docs = table(spark, sf, "documents")
    pred = docs.select("source", "doc_id", (F.col("n_chars") > 500).alias("is_decision"), (F.col("n_chars") % 10 / F.lit(10.0)).alias("confidence"))
    gold = table(spark, sf, "labels").join(docs.select("doc_id", "source"), "doc_id").select("source", "doc_id", (F.col("quality") == 1).alias("is_decision"))
    out = evaluation.sentence_confusion(pred, gold, ["source", "doc_id"], ["source"])
    return rounded(out, "precision", "recall", "f1", "accuracy", "avg_confidence")


@query(
    "confidence_distribution_j8",
    "SELECT l_suppkey, count(*) AS total, count(*) FILTER (d) AS decisions, count(*) FILTER (NOT d) AS non_decisions, round(avg(c), 9) AS avg_confidence, "
    "round(coalesce(avg(c) FILTER (d), 0), 9) AS avg_decision_confidence, round(coalesce(avg(c) FILTER (NOT d), 0), 9) AS avg_non_decision_confidence, min(c) AS min_confidence, max(c) AS max_confidence, "
    "count(*) FILTER (d AND c > 0.8) AS high_confidence_decisions, count(*) FILTER (d AND c < 0.5) AS low_confidence_decisions "
    "FROM (SELECT l_suppkey, l_returnflag = 'A' AS d, l_quantity / 50 AS c FROM lineitem) GROUP BY 1",
)
def confidence_distribution(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "A").alias("is_decision"), (F.col("l_quantity") / 50).alias("confidence")
    )
    out = evaluation.confidence_distribution(rows, ["l_suppkey"])
    return rounded(out, "avg_confidence", "avg_decision_confidence", "avg_non_decision_confidence")


EVALUATED = (
    "quality AS (SELECT meeting_id, avg(confidence) AS avg_confidence, avg(CASE WHEN assignee IS NOT NULL AND deadline IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS completeness FROM pred GROUP BY 1), "
    f"measured AS (SELECT *, {_prf} FROM counts WHERE n_gold > 0), "
    "evaluated AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT m.*, coalesce(avg_confidence, 0) AS avg_confidence, coalesce(completeness, 0) AS completeness FROM measured m LEFT JOIN quality USING (meeting_id)))"
)


@query(
    "meeting_evaluation_j9",
    ck.with_ctes(
        JUDGED, MATCHED, EVALUATED,
        select="SELECT meeting_id, n_pred, n_gold, tp, fp, fn, round(f1, 9) AS f1, round(avg_confidence, 9) AS avg_confidence, round(completeness, 9) AS completeness, 'exact' AS match_type FROM evaluated",
    ),
)
def meeting_evaluation(spark, sf):
    out = evaluation.evaluate_tasks(*judged(spark, sf), meetings=judged_meetings(spark, sf))
    return rounded(out, "f1", "avg_confidence", "completeness").select(
        "meeting_id", "n_pred", "n_gold", "tp", "fp", "fn", "f1", "avg_confidence", "completeness", "match_type"
    )


@query(
    "set_evaluation_j10",
    ck.with_ctes(
        JUDGED,
        "ps AS (SELECT DISTINCT meeting_id, lower(trim(task)) AS k FROM pred WHERE trim(task) <> ''), gs AS (SELECT DISTINCT meeting_id, lower(trim(task)) AS k FROM gold WHERE trim(task) <> '')",
        "per AS (SELECT coalesce(ps.meeting_id, gs.meeting_id) AS meeting_id, ps.k AS p, gs.k AS g FROM ps FULL JOIN gs ON ps.meeting_id = gs.meeting_id AND ps.k = gs.k)",
        "counts AS (SELECT meeting_id, grouping(meeting_id)::BIGINT AS is_total, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM per GROUP BY ROLLUP (meeting_id))",
        select=_prf_sql("counts", "meeting_id, is_total"),
    ),
)
def set_evaluation(spark, sf):
    pred, gold = judged(spark, sf)
    text = lambda df: df.select("meeting_id", F.col("task").alias("text"))
    out = evaluation.set_evaluation(text(pred), text(gold)).withColumn("is_total", F.col("is_total").cast("long"))
    return rounded(out, "precision", "recall", "f1")


@query(
    "evaluation_report_j11",
    ck.with_ctes(
        JUDGED, MATCHED, EVALUATED,
        select="SELECT meeting_id, meeting_id || ':' || chr(10) || '  Gold: ' || n_gold || ' tasks' || chr(10) || '  Predicted: ' || n_pred || ' tasks' || chr(10) || '  Precision: ' || printf('%.3f', round(precision, 3)) || chr(10) "
        "|| '  Recall: ' || printf('%.3f', round(recall, 3)) || chr(10) || '  F1-Score: ' || printf('%.3f', round(f1, 3)) || chr(10) || '  Completeness: ' || printf('%.3f', round(completeness, 3)) || chr(10) || '  Avg Confidence: ' || printf('%.3f', round(round(avg_confidence, 6), 3)) AS report FROM evaluated",
    ),
)
def evaluation_report(spark, sf):
    out = evaluation.evaluate_tasks(*judged(spark, sf), meetings=judged_meetings(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))
    return evaluation.report_lines(out)


@query(
    "annotator_agreement_j13",
    "SELECT source, n, round(observed, 9) AS observed, round(pa * pb + (1 - pa) * (1 - pb), 9) AS expected, "
    "round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN (observed - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) ELSE 1 END, 9) + 0 AS kappa, "
    "CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN (observed - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) ELSE 1 END >= 0.7 AS acceptable "
    "FROM (SELECT source, count(*) AS n, avg((quality = toxic)::INT) AS observed, avg(quality) AS pa, avg(toxic) AS pb FROM labels JOIN documents USING (doc_id) GROUP BY 1)",
)
def annotator_agreement(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    flags = rows.select("source", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return rounded(evaluation.cohen_kappa(flags, "a", "b", ["source"]), "observed", "expected", "kappa")


# --- O -------------------------------------------------------------------------------------------------
DECISIONS = (
    f"near AS (SELECT label, vec_id * 3 + k AS vec_id, {_copies_sql('k')} AS embedding FROM embeddings, (SELECT unnest([0, 1, 2]) AS k)), "
    "decs AS (SELECT label AS meeting_id, vec_id AS sentence_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 5 < 4 THEN 'act' || (vec_id % 3) END AS action, "
    f"'obj' || (vec_id % 4) AS object, ({ck.sql_list(NAMES)})[vec_id % 7 + 1] AS speaker, {ck._TEXT}[vec_id % 64 + 1] AS text FROM near)"
)


# Every pair from this adjusted similarity on is reported.
PAIR_SIMILARITY = 0.1


def decisions(spark, sf):
    v = F.col("vec_id") * 3 + F.col("k")
    return table(spark, sf, "embeddings").withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(
        F.col("label").alias("meeting_id"), v.alias("sentence_id"), near_copy(F.col("k")).alias("vector"),
        F.when(v % 5 < 4, F.concat(F.lit("act"), v % 3)).alias("action"), F.concat(F.lit("obj"), v % 4).alias("object"),
        _pick(NAMES, v % 7).alias("speaker"), _pick(PHRASES, v % 64).alias("text"),
    )


@query(
    "decision_similarity_o1",
    ck.with_ctes(
        DECISIONS,
        "p AS (SELECT a.meeting_id, a.sentence_id AS a, b.sentence_id AS b, list_cosine_similarity(a.v, b.v) AS c, a.action = b.action AND a.object IS DISTINCT FROM b.object AS clash "
        "FROM decs a JOIN decs b ON a.meeting_id = b.meeting_id AND b.sentence_id > a.sentence_id)",
        "s AS (SELECT *, CASE WHEN c < 0.4 THEN 0 ELSE c / (1 + 0.05 * (b - a)) * CASE WHEN clash THEN 0.6 ELSE 1 END END AS sim FROM p)",
        select=f"SELECT meeting_id, a, b, round(c, 6) AS cosine, round(sim, 6) AS similarity FROM s WHERE sim >= {PAIR_SIMILARITY}",
    ),
)
def decision_similarity(spark, sf):
    return clusters.decision_pairs(decisions(spark, sf), PAIR_SIMILARITY).select(
        "meeting_id", "a", "b", F.round("cosine", 6).alias("cosine"), F.round("similarity", 6).alias("similarity")
    )


@query(
    "decision_clusters_o2",
    "WITH RECURSIVE " + DECISIONS + """,
ids AS (SELECT meeting_id, sentence_id, row_number() OVER (PARTITION BY meeting_id ORDER BY sentence_id) AS i FROM decs),
p AS (SELECT a.meeting_id, a.sentence_id AS a, b.sentence_id AS b, list_cosine_similarity(a.v, b.v) AS c, a.action = b.action AND a.object IS DISTINCT FROM b.object AS clash
  FROM decs a JOIN decs b ON a.meeting_id = b.meeting_id AND b.sentence_id > a.sentence_id),
s AS (SELECT p.meeting_id, x.i, y.i AS j, CASE WHEN c < 0.4 THEN 0 ELSE c / (1 + 0.05 * (b - a)) * CASE WHEN clash THEN 0.6 ELSE 1 END END AS sim
  FROM p JOIN ids x ON x.meeting_id = p.meeting_id AND x.sentence_id = a JOIN ids y ON y.meeting_id = p.meeting_id AND y.sentence_id = b),
walk AS (
  SELECT meeting_id, 0 AS step, list(sentence_id ORDER BY i) AS labels FROM ids GROUP BY 1
  UNION ALL
  SELECT meeting_id, step + 1, list_transform(labels, lambda l: CASE WHEN l = y THEN x ELSE l END) FROM (
    SELECT meeting_id, x, y, any_value(step) AS step, any_value(labels) AS labels, round(1 - avg(sim), 9) AS d
    FROM (SELECT w.*, sim, least(labels[i], labels[j]) AS x, greatest(labels[i], labels[j]) AS y FROM walk w JOIN s ON s.meeting_id = w.meeting_id WHERE labels[i] <> labels[j])
    GROUP BY 1, 2, 3 HAVING round(1 - avg(sim), 9) < 0.7
  ) QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY d, x, y) = 1
),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY step DESC) = 1)
SELECT ids.meeting_id, ids.sentence_id, last.labels[ids.i] AS cluster FROM ids JOIN last ON last.meeting_id = ids.meeting_id""",
)
def decision_clusters(spark, sf):
    return clusters.cluster_decisions(decisions(spark, sf))


CLUSTERED = "clustered AS (SELECT *, sentence_id // 16 AS cluster FROM decs)"


def clustered(spark, sf):
    return decisions(spark, sf).withColumn("cluster", F.floor(F.col("sentence_id") / 16))


@query(
    "cluster_arrays_o3",
    ck.with_ctes(
        DECISIONS, CLUSTERED,
        select="SELECT meeting_id, cluster, string_agg(sentence_id::VARCHAR, ',' ORDER BY sentence_id) AS sentences, string_agg(text, '|' ORDER BY sentence_id) AS texts, string_agg(speaker, ',' ORDER BY sentence_id) AS speakers FROM clustered GROUP BY 1, 2",
    ),
)
def cluster_arrays(spark, sf):
    out = clusters.cluster_arrays(clustered(spark, sf))
    return out.select(
        "meeting_id", "cluster", F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentences"),
        joined("texts").alias("texts"), joined("speakers", ",").alias("speakers"),
    )


def _cluster_clean(column: str) -> str:
    out = ck.trim(column)
    for opening in lx.CLUSTER_OPENINGS:
        out = ck.trim(ck.sub(out, opening, "", "i"))
    for filler in lx.TITLE_FILLERS:
        out = ck.trim(ck.sub(out, filler))
    for pronoun, noun in lx.SUMMARY_PRONOUNS:
        out = ck.sub(out, rf"\b{pronoun}\b", noun)
    out = ck.trim(ck.sub(out, r"\s{2,}", " ", "g"))
    out = ck.trim(f"rtrim(rtrim({out}, '?'), '.')")
    for name in lx.DAYS + lx.MONTHS:
        out = ck.sub(out, rf"\b{name}\b", name.capitalize())
    return out


SUMMARIES = (
    f"cut AS (SELECT *, {_cluster_clean('text')} AS t FROM clustered), cleaned AS (SELECT *, {ck.finish_title('t')} AS summary FROM cut), "
    f"reps AS (SELECT meeting_id, cluster, summary FROM cleaned QUALIFY row_number() OVER (PARTITION BY meeting_id, cluster ORDER BY {ck.like_re('summary', lx.GENERATED_TASK_VERBS)} DESC, length(summary) DESC, sentence_id) = 1)"
)


@query(
    "cluster_sentence_cleaning_o4",
    ck.with_ctes(DECISIONS, CLUSTERED, SUMMARIES, select="SELECT meeting_id, sentence_id, summary AS cleaned FROM cleaned"),
)
def cluster_sentence_cleaning(spark, sf):
    return decisions(spark, sf).select("meeting_id", "sentence_id", clusters.clean_sentence(F.col("text")).alias("cleaned"))


@query(
    "cluster_summaries_o5",
    ck.with_ctes(DECISIONS, CLUSTERED, SUMMARIES, select="SELECT meeting_id, cluster, summary FROM reps"),
)
def cluster_summaries(spark, sf):
    return clusters.representatives(clustered(spark, sf))


_says = ck.like_re("text", ck.alt([rf"\b{p}\b" for p in lx.SELF_ASSIGNMENT + lx.DELEGATION]))


@query(
    "cluster_tasks_o6",
    ck.with_ctes(
        DECISIONS, CLUSTERED, SUMMARIES,
        f"who AS (SELECT meeting_id, cluster, coalesce(nullif(regexp_extract(text, '^([A-Z]\\w*),\\s*(?:can|could)\\s+you\\b', 1), ''), nullif(speaker, ''), 'Unknown') AS assignee FROM clustered "
        f"QUALIFY row_number() OVER (PARTITION BY meeting_id, cluster ORDER BY NOT {_says}, sentence_id) = 1)",
        f"due AS (SELECT meeting_id, cluster, arg_min(d, sentence_id) FILTER (d IS NOT NULL) AS due FROM (SELECT *, {ck.deadline_sql('text')} AS d FROM clustered) GROUP BY 1, 2)",
        select=f"SELECT meeting_id, cluster, rtrim(summary, '.') AS title, assignee, coalesce({ck.deadline_sql('summary')}, due) AS deadline FROM reps JOIN who USING (meeting_id, cluster) JOIN due USING (meeting_id, cluster)",
    ),
)
def cluster_tasks(spark, sf):
    return clusters.cluster_tasks(clustered(spark, sf)).select("meeting_id", "cluster", "title", "assignee", "deadline")


@query(
    "answer_cleaning_o7",
    "SELECT event_id, CASE WHEN list_contains(" + ck.sql_list(NAMES) + ", a) THEN a WHEN list_contains(" + ck.sql_list(NAMES)
    + r", coalesce(rtrim(list_filter(" + ck.split_ws("a") + r", lambda w: regexp_matches(w, '^\p{Lu}'))[1], '.,;:!?'), '')) THEN rtrim(list_filter(" + ck.split_ws("a")
    + r", lambda w: regexp_matches(w, '^\p{Lu}'))[1], '.,;:!?') ELSE a END AS answer FROM (SELECT event_id, "
    + r"rtrim(trim(regexp_replace(raw, '^\s*\w+\s*(?:said)?\s*:\s*', '', 'i')), '.,;:!?') AS a FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN n || ': ' || m WHEN 1 THEN n || ' said: ' || m || '.' "
    + f"WHEN 2 THEN 'the ' || m || ' group' ELSE 'nobody,' END AS raw FROM (SELECT event_id, ({ck.sql_list(NAMES)})[event_id % 7 + 1] AS n, ({ck.sql_list(NAMES)})[(event_id // 7) % 7 + 1] AS m FROM events)))",
)
def answer_cleaning(spark, sf):
    e = F.col("event_id")
    n, m = _pick(NAMES, e % 7), _pick(NAMES, F.floor(e / 7) % 7)
    raw = (
        F.when(e % 4 == 0, F.concat(n, F.lit(": "), m)).when(e % 4 == 1, F.concat(n, F.lit(" said: "), m, F.lit(".")))
        .when(e % 4 == 2, F.concat(F.lit("the "), m, F.lit(" group"))).otherwise("nobody,")
    )
    known = F.array(*[F.lit(x) for x in NAMES])
    return table(spark, sf, "events").select("event_id", extraction.clean_answer(raw, known).alias("answer"))


@query(
    "task_evidence_o8",
    ck.with_ctes(
        DECISIONS, CLUSTERED,
        select="SELECT meeting_id, cluster, sentence_id, speaker, text FROM clustered WHERE action IS NOT NULL",
    ),
)
def task_evidence(spark, sf):
    rows = clustered(spark, sf)
    return clusters.evidence_rows(clusters.cluster_tasks(rows), rows.where(F.col("action").isNotNull()))


@query(
    "vector_cosine_i2",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def vector_cosine(spark, sf):
    rows = table(spark, sf, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))
