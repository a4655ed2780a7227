"""Queries over transcripts, sentences and their dialogue context (inventory A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions import text as tx
from gavel.operators import context, syntax, turns
from gavel.plans.meeting_tasks import prepare
from gavel.sources import files
from gavel.workload import checks as ck
from gavel.workload.bank import calls, standups
from gavel.workload.registry import CHECKS, query, table

AS_TEXT = "string"


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("meeting_id"), F.col("text").alias("raw_text"))


def chats(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("turn_id"), F.col("role").alias("speaker"),
        F.lit(None).cast("string").alias("timestamp"), "text",
    )


def standup_sentences(spark, sf):
    return turns.sentences_from_transcripts(standups(spark, sf))


def call_sentences(spark, sf):
    table_of_turns = calls(spark, sf)
    return turns.sentences_from_turns(table_of_turns, call_rows(spark, sf))


def call_known(spark, sf):
    """The sentences with their meeting's speakers."""
    return turns.with_known_speakers(call_sentences(spark, sf), calls(spark, sf))


def call_rows(spark, sf):
    """Turns of a segment; meetings of any size are cut into such segments."""
    return ordered.SEGMENT_ROWS


def joined(column, sep="|"):
    return F.array_join(column, sep)


# --- A, B ----------------------------------------------------------------------------------------------


@query(
    "upload_check_a3",
    "SELECT doc_id AS meeting_id, octet_length(encode(text)) AS length, CASE WHEN doc_id % 5 < 2 THEN 'Only .txt files are supported.' END AS error, "
    "CASE WHEN doc_id % 5 < 2 THEN NULL ELSE md5(text) END AS digest FROM documents",
)
def upload_check(spark, sf):
    source = table(spark, sf, "documents")
    uploads = source.select(
        F.concat(F.lit("/landing/"), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, ".pdf").when(F.col("doc_id") % 5 == 1, ".TXT").otherwise(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.encode("text", "utf-8").alias("content"),
    )
    checked = files.checked_uploads(uploads)
    return checked.select(
        F.regexp_extract("meeting_id", r"^(\d+)", 1).cast("long").alias("meeting_id"), "length", "error", F.md5(F.encode("raw_text", "utf-8")).alias("digest")
    )


@query(
    "one_transcript_per_meeting_a4",
    "SELECT event_id AS meeting_id, user_id FROM events WHERE event_id NOT IN (SELECT conv_id FROM conversations)",
)
def one_transcript(spark, sf):
    uploads = table(spark, sf, "events").select(F.col("event_id").alias("meeting_id"), "user_id")
    return files.new_transcripts(uploads, table(spark, sf, "conversations").select(F.col("conv_id").alias("meeting_id")))


@query(
    "line_explode_b1",
    ck.with_ctes(
        ck.DOCUMENTS, ck.LINE_ROWS,
        select="SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY pos) AS line_no, line FROM line_rows",
    ),
)
def line_explode(spark, sf):
    lines = turns.lines_of(F.col("raw_text"))
    rows = documents(spark, sf).select("meeting_id", F.posexplode_outer(lines).alias("i", "line"))
    return rows.where(F.col("line").isNotNull()).select(
        "meeting_id", (F.col("i") + 1).cast("long").alias("line_no"), "line"
    )


TURN_SQL = "SELECT meeting_id, turn_id, speaker, timestamp, text FROM turns"


@query("turns_of_standups_b2_b6", ck.with_ctes(ck.STANDUPS, *ck.RAW_TURNS, select=TURN_SQL))
def turns_of_standups(spark, sf):
    return turns.parse_turns(standups(spark, sf))


@query("turns_of_documents_b5", ck.with_ctes(ck.DOCUMENTS, *ck.RAW_TURNS, select=TURN_SQL))
def turns_of_documents(spark, sf):
    return turns.parse_turns(documents(spark, sf))


@query(
    "turns_short_timestamps_b2",
    ck.with_ctes(
        ck.STANDUPS.replace("'[00:0' || k || ':30] '", "'[0' || k || ':30] '"), ck.LINE_ROWS,
        ck.parsed_lines(lx.SHORT_TIMESTAMP_LINE), ck.TURNS, select=TURN_SQL,
    ),
)
def turns_short_timestamps(spark, sf):
    short = standups(spark, sf).withColumn("raw_text", F.regexp_replace("raw_text", r"\[00:", "["))
    return turns.parse_turns(short, allow_mmss=True)


LONG_LINES = (
    "line_rows AS (SELECT user_id AS meeting_id, event_id AS pos, "
    f"trim(CASE event_id % 4 WHEN 0 THEN {ck._NAME}[event_id % 7 + 1] || ': ' WHEN 1 THEN '[00:00:10] ' || {ck._NAME}[event_id % 7 + 1] || ': ' ELSE '' END "
    f"|| {ck._TEXT}[event_id % 64 + 1]) AS line FROM events)"
)


@query("turns_of_line_tables_b5", ck.with_ctes(LONG_LINES, ck.parsed_lines(), ck.TURNS, select=TURN_SQL))
def turns_of_line_tables(spark, sf):
    from gavel.workload.bank import NAMES, PHRASES, _pick

    e = F.col("event_id")
    head = F.when(e % 4 == 0, F.concat(_pick(NAMES, e % 7), F.lit(": "))).when(
        e % 4 == 1, F.concat(F.lit("[00:00:10] "), _pick(NAMES, e % 7), F.lit(": "))
    ).otherwise("")
    lines = table(spark, sf, "events").select(
        F.col("user_id").alias("meeting_id"), e.alias("line_no"), F.concat(head, _pick(PHRASES, e % 64)).alias("line")
    )
    return turns.turns_from_lines(lines, call_rows(spark, sf)).select("meeting_id", "turn_id", "speaker", "timestamp", "text")


@query(
    "known_speakers_b7",
    ck.with_ctes(ck.CALLS, ck.SPEAKERS, select="SELECT meeting_id, array_to_string(known, '|') AS known_speakers FROM speakers"),
)
def known_speakers(spark, sf):
    return turns.known_speakers(calls(spark, sf)).select("meeting_id", joined("known_speakers").alias("known_speakers"))


@query(
    "stage_metrics_b8",
    ck.with_ctes(
        ck.STANDUPS, *ck.RAW_TURNS, *ck.SENTENCE_CHAIN,
        select="SELECT meeting_id, length(raw_text) AS meeting_chars, "
        "(SELECT count(*) FROM line_rows l WHERE l.meeting_id = r.meeting_id) AS n_lines, "
        "(SELECT count(*) FROM turns l WHERE l.meeting_id = r.meeting_id) AS n_turns, "
        "(SELECT count(*) FROM sents l WHERE l.meeting_id = r.meeting_id) AS n_sentences, "
        "(SELECT count(*) FROM kept l WHERE l.meeting_id = r.meeting_id) AS n_kept, "
        "(SELECT count(*) FROM cleaned l WHERE l.meeting_id = r.meeting_id AND text <> '') - (SELECT count(*) FROM kept l WHERE l.meeting_id = r.meeting_id) AS n_removed FROM raw r",
    ),
)
def stage_metrics(spark, sf):
    out = turns.stage_metrics(standups(spark, sf))
    return out.select("meeting_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


# --- C -------------------------------------------------------------------------------------------------


@query(
    "sentence_split_c1_c2",
    ck.with_ctes(ck.CHATS, ck.SENTENCES, select="SELECT meeting_id, sentence_id, turn_id, speaker, text FROM sents"),
)
def sentence_split(spark, sf):
    split = chats(spark, sf).withColumn("_parts", tx.split_sentences(F.col("text")))
    rows = ordered.segment_rows(split, ["meeting_id"])
    placed = ordered.running_total(split, ["meeting_id"], "turn_id", {"_through": F.size("_parts")}, rows)
    return placed.select("*", F.posexplode("_parts").alias("i", "s")).select(
        "meeting_id", (F.col("_through") - F.size("_parts") + F.col("i") + 1).alias("sentence_id"), "turn_id", "speaker",
        F.col("s").alias("text"),
    )


@query(
    "text_cleaning_c7_c10",
    ck.with_ctes(ck.CALLS, select=f"SELECT turn_id, {ck.clean('text')} AS cleaned, {ck.trim(ck.sub('text', chr(92) + 's+', ' ', 'g'))} AS collapsed FROM turns"),
)
def text_cleaning(spark, sf):
    t = F.col("text")
    return calls(spark, sf).select("turn_id", tx.clean(t).alias("cleaned"), tx.collapse(t).alias("collapsed"))


@query(
    "stop_sentences_c11",
    ck.with_ctes(
        *ck.CALL_SENTENCES,
        select="SELECT c.meeting_id, count(*) AS n_sentences, count(k.sentence_id) AS n_kept, count(*) - count(k.sentence_id) AS n_removed "
        "FROM cleaned c LEFT JOIN kept k USING (meeting_id, sentence_id) WHERE c.text <> '' GROUP BY c.meeting_id",
    ),
)
def stop_sentences(spark, sf):
    parts = F.filter(F.transform(tx.split_sentences(F.col("text")), tx.clean), lambda s: s != "")
    flat = calls(spark, sf).select("meeting_id", F.explode_outer(parts).alias("s")).where(F.col("s").isNotNull())
    stop = tx.is_stop_sentence(F.col("s"))
    return flat.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(~stop).alias("n_kept"), F.count_if(stop).alias("n_removed")
    )


KEPT_SQL = "SELECT meeting_id, ord, sentence_id, turn_id, speaker, text FROM kept"


@query("kept_sentences_of_standups_c10_c11", ck.with_ctes(*ck.STANDUP_SENTENCES, select=KEPT_SQL))
def kept_of_standups(spark, sf):
    return standup_sentences(spark, sf).select(
        "meeting_id", "ord", F.col("sentence_id").cast("long").alias("sentence_id"), "turn_id", "speaker", "text"
    )


@query("kept_sentences_of_calls_c10_c11", ck.with_ctes(*ck.CALL_SENTENCES, select=KEPT_SQL))
def kept_of_calls(spark, sf):
    return call_sentences(spark, sf).select("meeting_id", "ord", "sentence_id", "turn_id", "speaker", "text")


@query(
    "sentence_types_c12",
    ck.with_ctes(*ck.CALL_SENTENCES, select=f"SELECT meeting_id, sentence_id, {ck.SENTENCE_TYPE} AS sentence_type FROM kept"),
)
def sentence_types(spark, sf):
    return call_sentences(spark, sf).select("meeting_id", "sentence_id", tx.sentence_type(F.col("text")).alias("sentence_type"))


_norm = (
    "regexp_replace(regexp_replace(regexp_replace(" + ck.trim(ck.sub("text", r"\s+", " ", "g"))
    + r", '\.\.+', '.', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g')"
)


@query("normalize_text_c13", f"SELECT doc_id, {_norm} AS normalized FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


_san = f"""trim({_norm}, '''".,;:!?-')"""


@query(
    "sanitize_task_c14",
    ck.with_ctes(ck.CALLS, select=f"SELECT turn_id, CASE WHEN len({ck.split_ws(_san)}) >= 3 THEN {_san} END AS sanitized FROM turns"),
)
def sanitize_task(spark, sf):
    return calls(spark, sf).select("turn_id", tx.sanitize_task(F.col("text")).alias("sanitized"))


@query(
    "extract_names_c15",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter("
    + ck.split_ws("text") + r", lambda w: length(w) > 1 AND regexp_matches(w, '^\p{Lu}')), lambda w: rtrim(w, ',:;.!?')))), '|') AS names FROM documents",
)
def extract_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(F.array_sort(tx.extract_names(F.col("text")))).alias("names"))


@query(
    "shared_patterns_c16",
    ck.with_ctes(
        *ck.CALL_SENTENCES,
        select=f"SELECT meeting_id, sentence_id, {ck.like_re('text', lx.SHARED_ACTION_VERBS)} AS has_action, "
        f"{ck.like_re('text', ck.alt(lx.SHARED_DEADLINES))} AS has_deadline, regexp_matches(speaker, {ck.q(lx.SPEAKER_NAME)}) AS is_name FROM kept",
    ),
)
def shared_patterns(spark, sf):
    t = F.col("text")
    return call_sentences(spark, sf).select(
        "meeting_id", "sentence_id", t.rlike(tx.regex(lx.SHARED_ACTION_VERBS)).alias("has_action"),
        t.rlike(tx.any_of(lx.SHARED_DEADLINES)).alias("has_deadline"), F.col("speaker").rlike(lx.SPEAKER_NAME).alias("is_name"),
    )


@query(
    "meeting_format_c17",
    ck.with_ctes(*ck.CALL_SENTENCES, select="SELECT meeting_id, sentence_id, speaker, text FROM kept"),
)
def meeting_format(spark, sf):
    return files.meeting_format(call_sentences(spark, sf), keep_metadata=False)


@query(
    "annotation_rules_c3_c6",
    ck.with_ctes(
        *ck.CALL_SENTENCES, ck.ANNOTATED,
        select="SELECT meeting_id, sentence_id, root_verb, subject, object, root_tag, has_dobj, is_passive FROM annotated",
    ),
)
def annotation_rules(spark, sf):
    return syntax.annotate_by_rules(call_sentences(spark, sf)).select(
        "meeting_id", "sentence_id", "root_verb", "subject", "object", "root_tag", "has_dobj", "is_passive"
    )


# A dependency-token table in the shape a parser gives, with labels picked by arithmetic on line items.
DEPS = ["nsubj", "dobj", "pobj", "prep", "det", "amod", "compound", "ccomp", "attr", "conj", "npadvmod", "xcomp", "punct"]
POS = ["NOUN", "VERB", "PRON", "PROPN", "ADP", "ADJ"]
LEMMAS = ["have", "review", "by", "team", "report", "go", "send", "get", "plan"]
TOKEN_SQL = (
    "lines AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, "
    "count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), "
    f"tokens AS (SELECT l_orderkey % 100 AS meeting_id, l_orderkey AS sentence_id, i, CASE WHEN l_partkey % 9 = 0 THEN ',' ELSE 'w' || (l_partkey % 50) END AS text, "
    f"({ck.sql_list(LEMMAS)})[l_partkey % 9 + 1] AS lemma, ({ck.sql_list(POS)})[l_suppkey % 6 + 1] AS pos, "
    f"CASE WHEN l_partkey % 2 = 0 THEN 'VB' ELSE 'VBD' END AS tag, CASE WHEN i = 0 THEN 'ROOT' ELSE ({ck.sql_list(DEPS)})[(l_partkey + l_suppkey) % 13 + 1] END AS dep, "
    "CASE WHEN i = 0 THEN 0 ELSE (l_partkey // 7) % n END AS head, CASE WHEN l_suppkey % 10 = 0 THEN 'PERSON' ELSE '' END AS ent_type FROM lines)"
)


def tokens(spark, sf):
    from pyspark.sql import Window

    from gavel.workload.bank import _pick

    w = Window.partitionBy("l_orderkey")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("long").alias("i"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return lines.select(
        (F.col("l_orderkey") % 100).alias("meeting_id"), F.col("l_orderkey").alias("sentence_id"), "i",
        F.when(p % 9 == 0, ",").otherwise(F.concat(F.lit("w"), p % 50)).alias("text"),
        _pick(LEMMAS, p % 9).alias("lemma"), _pick(POS, s % 6).alias("pos"),
        F.when(p % 2 == 0, "VB").otherwise("VBD").alias("tag"),
        F.when(F.col("i") == 0, "ROOT").otherwise(_pick(DEPS, (p + s) % 13)).alias("dep"),
        F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.floor(p / 7) % F.col("n")).alias("head"),
        F.when(s % 10 == 0, "PERSON").otherwise("").alias("ent_type"),
    )


_roots = "roots AS (SELECT * FROM tokens WHERE dep = 'ROOT')"


@query(
    "parse_root_verbs_c3",
    ck.with_ctes(
        TOKEN_SQL, _roots,
        select=f"SELECT r.meeting_id, r.sentence_id, CASE WHEN r.pos IN ('VERB', 'AUX') THEN CASE WHEN r.lemma IN {ck.in_list(lx.LIGHT_ROOTS)} THEN "
        "coalesce((SELECT arg_min(c.lemma, c.i) FROM tokens c WHERE c.sentence_id = r.sentence_id AND c.head = r.i AND c.pos = 'VERB' AND c.dep IN ('xcomp', 'ccomp', 'advcl')), r.lemma) "
        "ELSE r.lemma END END AS root_verb, r.tag AS root_tag FROM roots r",
    ),
)
def parse_root_verbs(spark, sf):
    return syntax.root_verbs(tokens(spark, sf))


def _front(deps: str, order: str) -> str:
    return (
        f"coalesce((SELECT string_agg(c.text, ' ' ORDER BY c.i {order}) FROM tokens c WHERE c.sentence_id = t.sentence_id AND c.head = t.i AND c.i <> t.i "
        f"AND c.dep IN ({deps})) || ' ', '') || t.text"
    )


@query(
    "parse_subjects_c4",
    ck.with_ctes(
        TOKEN_SQL, _roots,
        "picks AS (SELECT t.meeting_id, t.sentence_id, coalesce(min(t.i) FILTER (t.dep IN ('nsubj', 'nsubjpass')), min(t.i) FILTER (t.dep = 'npadvmod'), "
        "min(t.i) FILTER (c.i IS NOT NULL AND (t.pos IN ('NOUN', 'PROPN') OR t.ent_type IN ('PERSON', 'ORG'))), "
        "min(t.i) FILTER (t.pos = 'PROPN' AND t.i < r.i)) AS i, coalesce(bool_or(t.dep = 'nsubjpass'), false) AS is_passive FROM tokens t "
        "LEFT JOIN tokens c ON c.sentence_id = t.sentence_id AND c.i = t.i + 1 AND c.text = ',' LEFT JOIN roots r ON r.sentence_id = t.sentence_id GROUP BY 1, 2)",
        select=f"SELECT p.meeting_id, p.sentence_id, {_front(chr(39) + 'compound' + chr(39) + ', ' + chr(39) + 'amod' + chr(39), 'DESC')} AS subject, p.is_passive FROM picks p "
        "LEFT JOIN tokens t ON t.sentence_id = p.sentence_id AND t.i = p.i",
    ),
)
def parse_subjects(spark, sf):
    return syntax.subjects(tokens(spark, sf))


_np = _front("'det', 'amod', 'compound'", "ASC")


@query(
    "parse_objects_c5",
    ck.with_ctes(
        TOKEN_SQL,
        f"cands AS (SELECT t.meeting_id, t.sentence_id, t.i, CASE t.dep WHEN 'dobj' THEN 1 WHEN 'attr' THEN 3 ELSE 4 END AS pri, t.pos = 'PRON' AS pron, {_np} AS text FROM tokens t "
        "LEFT JOIN tokens h ON h.sentence_id = t.sentence_id AND h.i = t.head "
        f"WHERE t.dep IN ('dobj', 'attr', 'pobj') AND NOT (t.dep = 'pobj' AND coalesce(h.lemma, '') IN {ck.in_list(lx.OBJECT_TEMPORAL_HEADS)}))",
        select="SELECT meeting_id, sentence_id, text AS object FROM cands QUALIFY row_number() OVER (PARTITION BY sentence_id ORDER BY pri, pron, i) = 1",
    ),
)
def parse_objects(spark, sf):
    return syntax.best_objects(syntax.object_candidates(tokens(spark, sf)))


@query(
    "parse_resultatives_c6",
    ck.with_ctes(
        TOKEN_SQL, _roots,
        select=f"SELECT t.meeting_id, t.sentence_id, {_np} AS resultative FROM tokens t JOIN tokens c ON c.sentence_id = t.sentence_id AND c.i = t.head AND c.dep IN ('ccomp', 'acomp') "
        "JOIN roots r ON r.sentence_id = t.sentence_id AND c.head = r.i WHERE t.dep = 'nsubj' "
        f"AND r.lemma IN {ck.in_list(lx.RESULTATIVE_VERBS)} QUALIFY row_number() OVER (PARTITION BY t.sentence_id ORDER BY c.i DESC, t.i) = 1",
    ),
)
def parse_resultatives(spark, sf):
    return syntax.resultative_objects(tokens(spark, sf))


@query(
    "parse_direct_objects_d7",
    ck.with_ctes(
        TOKEN_SQL, _roots,
        "own AS (SELECT t.sentence_id, arg_min(t.text, t.i) AS o FROM tokens t JOIN roots r ON r.sentence_id = t.sentence_id AND t.head = r.i WHERE t.dep = 'dobj' GROUP BY 1), "
        "second AS (SELECT t.sentence_id, t.text AS o FROM tokens t JOIN tokens c ON c.sentence_id = t.sentence_id AND c.i = t.head AND c.dep = 'conj' "
        "JOIN roots r ON r.sentence_id = t.sentence_id AND c.head = r.i WHERE t.dep = 'dobj' QUALIFY row_number() OVER (PARTITION BY t.sentence_id ORDER BY c.i, t.i) = 1)",
        select="SELECT DISTINCT t.meeting_id, t.sentence_id, own.o AS primary_object, CASE WHEN own.o IS NULL THEN second.o END AS secondary_object, own.o IS NOT NULL AS has_dobj "
        "FROM tokens t LEFT JOIN own USING (sentence_id) LEFT JOIN second USING (sentence_id) WHERE t.dep = 'dobj'",
    ),
)
def parse_direct_objects(spark, sf):
    return syntax.direct_objects(tokens(spark, sf))


@query(
    "parse_annotations_c3_c6",
    "SELECT r.meeting_id, r.sentence_id, root_verb, subject, coalesce(resultative, object) AS object, root_tag, coalesce(has_dobj, false) AS has_dobj, is_passive "
    f"FROM ({CHECKS['parse_root_verbs_c3']}) r LEFT JOIN ({CHECKS['parse_subjects_c4']}) s USING (meeting_id, sentence_id) "
    f"LEFT JOIN ({CHECKS['parse_objects_c5']}) o USING (meeting_id, sentence_id) LEFT JOIN ({CHECKS['parse_resultatives_c6']}) x USING (meeting_id, sentence_id) "
    f"LEFT JOIN ({CHECKS['parse_direct_objects_d7']}) d USING (meeting_id, sentence_id)",
)
def parse_annotations(spark, sf):
    return syntax.annotate_from_parse(tokens(spark, sf))


# --- D -------------------------------------------------------------------------------------------------
RESOLVED_SQL = (
    "SELECT meeting_id, sentence_id, root_verb, subject, object, subject_resolved, object_resolved, triplet_confidence, triplet_flags FROM resolved"
)


def resolved_columns(df):
    return df.select(
        "meeting_id", F.col("sentence_id").cast("long").alias("sentence_id"), "root_verb", "subject", "object",
        "subject_resolved", "object_resolved", "triplet_confidence", joined("triplet_flags", ",").alias("triplet_flags"),
    )


@query("triplets_of_calls_d1_d6", ck.with_ctes(*ck.CALL_RESOLVED, select=RESOLVED_SQL))
def triplets_of_calls(spark, sf):
    return resolved_columns(prepare(call_known(spark, sf), rows=call_rows(spark, sf)))


@query("triplets_of_standups_d1_d6", ck.with_ctes(*ck.STANDUP_RESOLVED, select=RESOLVED_SQL))
def triplets_of_standups(spark, sf):
    return resolved_columns(prepare(standup_sentences(spark, sf)))


@query(
    "carry_forward_strict_d4",
    ck.with_ctes(
        *ck.CALL_SENTENCES, ck.ANNOTATED, ck.NO_SPEAKERS, ck.CONTEXT,
        ck.RESOLVED.replace("regexp_replace(trim(lower(object)), '^the\\s+', '')", "trim(lower(object), 'the ')"),
        select="SELECT meeting_id, sentence_id, object, object_resolved FROM resolved",
    ),
)
def carry_forward_strict(spark, sf):
    return prepare(call_sentences(spark, sf), strict=True, rows=call_rows(spark, sf)).select("meeting_id", "sentence_id", "object", "object_resolved")


@query(
    "context_windows_d8",
    ck.with_ctes(*ck.CALL_SENTENCES, ck.ANNOTATED, ck.NO_SPEAKERS, ck.CONTEXT, select="SELECT meeting_id, sentence_id, context_text, prev_speaker FROM context"),
)
def context_windows(spark, sf):
    return context.dialogue_windows(call_sentences(spark, sf), rows=call_rows(spark, sf)).select("meeting_id", "sentence_id", "context_text", "prev_speaker")


@query(
    "request_pairs_d9",
    ck.with_ctes(
        *ck.CALL_SENTENCES, ck.ANNOTATED, ck.NO_SPEAKERS, ck.CONTEXT,
        select=f"SELECT meeting_id, sentence_id, CAST(ord - 1 AS INTEGER) AS paired_request_idx FROM context WHERE prev_is_request AND {ck.ACCEPTANCE}",
    ),
)
def request_pairs(spark, sf):
    looked = context.dialogue_windows(call_sentences(spark, sf), rows=call_rows(spark, sf))
    blank = looked.withColumns({"is_decision": F.lit(False), "confidence": F.lit(0.0), "confidence_zone": F.lit("low")})
    return context.pair_acceptances(blank).where("is_turn_pair_acceptance").select("meeting_id", "sentence_id", "paired_request_idx")


TYPE_SQL = "SELECT meeting_id, task_signals, status_signals, meeting_type FROM meeting_types"


@query("meeting_types_of_calls_d10", ck.with_ctes(*ck.CALL_SENTENCES, ck.MEETING_TYPES, select=TYPE_SQL))
def meeting_types_of_calls(spark, sf):
    return context.meeting_types(call_sentences(spark, sf), call_rows(spark, sf))


@query(
    "meeting_types_of_standups_d10",
    ck.with_ctes(*ck.STANDUP_SENTENCES, ck.MEETING_TYPES, select="SELECT r.meeting_id, coalesce(meeting_type, 'mixed') AS meeting_type FROM raw r LEFT JOIN meeting_types USING (meeting_id)"),
)
def meeting_types_of_standups(spark, sf):
    return turns.sentence_arrays(standups(spark, sf)).select("meeting_id", "meeting_type")
