"""Checking SQL: the same results, written independently for an ANSI engine with RE2 regular expressions.

Common table expressions are plain strings chained by `with_ctes`. RE2 has no look-around, so the two places
that need it insert a marker character first.
"""

from __future__ import annotations

from gavel import lexicon as lx
from gavel.operators import syntax
from gavel.workload.bank import LINES, NAMES, PHRASES

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def alt(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def like_re(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)}, 'i')"


def sub(expr: str, pattern: str, by: str = "", flags: str = "gi") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, {q(flags)})"


def ext(expr: str, pattern: str, group: int = 0, flags: str = "i") -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group}, {q(flags)})"


def trim(expr: str) -> str:
    return f"trim({expr}, {WS})"


def split_ws(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')"


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n" + select


# --- corpora -------------------------------------------------------------------------------------------
_TEXT = f"({sql_list(PHRASES)})"
_NAME = f"({sql_list(NAMES)})"


def _standup_line() -> str:
    phrase = f"{_TEXT}[(event_id * 7 + k * 13 + (event_id // 64) * k) % 64 + 1]"
    name = f"{_NAME}[(event_id + k * k) % 7 + 1]"
    return (
        f"CASE (event_id + k) % 5 WHEN 0 THEN '  ' || {name} || ': ' || {phrase} "
        f"WHEN 1 THEN '  ' || {name} || ': ' || {phrase} "
        f"WHEN 2 THEN {name} || ' - ' || {phrase} || ' ' || chr(10) "
        f"WHEN 3 THEN '[00:0' || k || ':30] ' || {name} || ': ' || {phrase} ELSE {phrase} END"
    )


STANDUPS = (
    "raw AS (SELECT event_id AS meeting_id, "
    f"array_to_string(list_transform(range({LINES}), lambda k: {_standup_line()}), chr(10)) AS raw_text FROM events)"
)
DOCUMENTS = "raw AS (SELECT doc_id AS meeting_id, text AS raw_text FROM documents)"
CALLS = (
    "turns AS (SELECT user_id AS meeting_id, event_id AS turn_id, "
    f"{_NAME}[(event_id + event_id // 50) % 7 + 1] AS speaker, CAST(NULL AS VARCHAR) AS timestamp, "
    f"{_TEXT}[(event_id * 11 + event_id // 64) % 64 + 1] || "
    f"CASE WHEN event_id % 3 = 0 THEN ' ' || {_TEXT}[(event_id * 5 + 3) % 64 + 1] ELSE '' END AS text FROM events)"
)
CHATS = (
    "turns AS (SELECT conv_id AS meeting_id, turn AS turn_id, role AS speaker, "
    "CAST(NULL AS VARCHAR) AS timestamp, text FROM conversations)"
)

LINE_ROWS = (
    "line_rows AS (SELECT meeting_id, pos, line FROM (SELECT meeting_id, "
    f"unnest(list_transform(string_split({trim('raw_text')}, chr(10)), lambda x: {trim('x')})) AS line, "
    f"generate_subscripts(string_split({trim('raw_text')}, chr(10)), 1) AS pos FROM raw) WHERE line <> '')"
)


def parsed_lines(stamp: str = lx.TIMESTAMP_LINE) -> str:
    ts = stamp
    colon_speaker = trim("split_part(line, ':', 1)")
    colon_text = trim("substr(line, instr(line, ':') + 1)")
    return (
        "parsed AS (SELECT meeting_id, pos, line, "
        f"regexp_matches(line, {q(ts)}) AND {trim(ext('line', ts, 2, 'c'))} <> '' AS stamped, "
        f"instr(line, ':') > 0 AND {colon_speaker} <> '' AND {colon_text} <> '' AS coloned, "
        f"regexp_matches(line, {q(lx.DASH_LINE)}) AS dashed FROM line_rows), "
        "spoken AS (SELECT meeting_id, pos, "
        f"CASE WHEN stamped THEN {ext('line', ts, 1, 'c')} END AS timestamp, "
        f"CASE WHEN stamped THEN {trim(ext('line', ts, 2, 'c'))} WHEN coloned THEN {colon_speaker} "
        f"WHEN dashed THEN {trim(ext('line', lx.DASH_LINE, 1, 'c'))} END AS speaker, "
        f"CASE WHEN stamped THEN {trim(ext('line', ts, 3, 'c'))} WHEN coloned THEN {colon_text} "
        f"WHEN dashed THEN {trim(ext('line', lx.DASH_LINE, 2, 'c'))} ELSE line END AS text FROM parsed)"
    )


TURNS = (
    "placed AS (SELECT *, CAST(sum(CASE WHEN speaker IS NOT NULL OR first THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY meeting_id ORDER BY pos) AS INTEGER) AS turn_id FROM (SELECT *, "
    "row_number() OVER (PARTITION BY meeting_id ORDER BY pos) = 1 AS first FROM spoken)), "
    "turns AS (SELECT meeting_id, turn_id, coalesce(max(speaker), 'unknown') AS speaker, max(timestamp) AS timestamp, "
    "string_agg(text, ' ' ORDER BY pos) AS text FROM placed GROUP BY meeting_id, turn_id)"
)
RAW_TURNS = [LINE_ROWS, parsed_lines(), TURNS]


def sentence_list(expr: str) -> str:
    marked = f"regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {trim('x')}), lambda x: x <> '')"


SENTENCES = (
    "sents AS (SELECT meeting_id, turn_id, speaker, timestamp, s AS text, "
    "row_number() OVER (PARTITION BY meeting_id ORDER BY turn_id, i) AS sentence_id FROM (SELECT meeting_id, turn_id, "
    f"speaker, timestamp, unnest({sentence_list('text')}) AS s, generate_subscripts({sentence_list('text')}, 1) AS i FROM turns))"
)


def clean(expr: str) -> str:
    out = trim(sub(expr, r"\s+", " ", "g"))
    out = f"regexp_replace({out}, '\\b(l)(ike\\s+\\w+ing)', '\\1' || chr(2) || '\\2', 'gi')"
    out = sub(out, r"\bum\b|\buh\b|\blike\b", " ")
    out = f"replace({out}, chr(2), '')"
    for phrase, standard in lx.PHRASE_DICTIONARY:
        out = sub(out, rf"\b{phrase}\b", standard)
    return trim(sub(out, r"\s+", " ", "g"))


CLEANED = f"cleaned AS (SELECT meeting_id, turn_id, speaker, timestamp, sentence_id, {clean('text')} AS text FROM sents)"
KEPT = (
    "kept AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY sentence_id) - 1 AS ord FROM cleaned "
    f"WHERE text <> '' AND NOT {like_re('text', alt(lx.STOP_SENTENCES))})"
)
SENTENCE_CHAIN = [SENTENCES, CLEANED, KEPT]

# --- annotation, types, context ------------------------------------------------------------------------
SENTENCE_TYPE = (
    f"CASE WHEN {like_re('text', alt(lx.METRIC_SENTENCES))} THEN 'metric' "
    f"WHEN {like_re('text', alt(lx.OBSERVATION_SENTENCES))} THEN 'observation' "
    f"WHEN {like_re('text', alt(lx.CONSEQUENCE_SENTENCES))} THEN 'consequence' ELSE 'general' END"
)
_head = ext("text", r"^(.*?)" + syntax.VERB_FORMS, 1)
_verb = ext("text", syntax.VERB_FORMS, 1)
_form = f"lower({ext('text', syntax.VERB_FORMS, 2)})"
_tail = ext("text", syntax.CLAUSE, 4)
_phrase = trim(sub(_tail, r"\s*" + syntax.PHRASE_ENDS + r".*$", "", "i"))
ANNOTATED = (
    "annotated0 AS (SELECT *, "
    f"nullif(lower({_verb}), '') AS root_verb, nullif({_phrase}, '') AS object, "
    f"CASE WHEN {_form} IN ('ed', 'd') THEN 'VBD' WHEN {_form} = 'ing' THEN 'VBG' WHEN {_form} = 's' THEN 'VBZ' "
    f"WHEN {_verb} <> '' THEN 'VB' END AS root_tag, "
    f"{like_re('text', syntax.PASSIVE)} AS is_passive, "
    f"nullif({ext(_head, syntax.SUBJECT_WORD, 1)}, '') AS pronoun, "
    rf"nullif(regexp_extract(text, '^([A-Z]\w*),', 1), '') AS called, {SENTENCE_TYPE} AS sentence_type FROM kept), "
    "annotated AS (SELECT * EXCLUDE (pronoun, called), object IS NOT NULL AS has_dobj, "
    "coalesce(pronoun, called, CASE WHEN NOT is_passive AND speaker <> 'unknown' THEN speaker END) AS subject FROM annotated0)"
)
REQUEST = f"(contains(text, '?') OR {like_re('text', alt(lx.REQUESTS))})"
ACCEPTANCE = like_re("text", alt(lx.ACCEPTANCES))
SPEAKERS = (
    "speakers AS (SELECT meeting_id, list_sort(list(DISTINCT speaker)) AS known FROM turns WHERE speaker <> '' GROUP BY meeting_id)"
)
NO_SPEAKERS = "speakers AS (SELECT DISTINCT meeting_id, CAST([] AS VARCHAR[]) AS known FROM turns)"
CONTEXT = (
    "context AS (SELECT a.*, known, lag(speaker) OVER w AS prev_speaker, "
    f"coalesce(lag({REQUEST}) OVER w, false) AS prev_is_request, "
    "concat_ws(' [SEP] ', lag(text, 2) OVER w, lag(text) OVER w, text) AS context_text, "
    f"{trim('''replace(replace(''' + trim('''split_part(text, ',', 1)''') + ''', 'please', ''), 'ok', '')''')} AS opening "
    "FROM annotated a JOIN speakers USING (meeting_id) WINDOW w AS (PARTITION BY meeting_id ORDER BY ord))"
)
_vague = (
    "regexp_replace(trim(lower(object)), '^the\\s+', '') IN " + in_list(lx.TRIPLET_PRONOUNS + lx.TEMPORAL_OBJECTS)
)
RESOLVED = (
    "subj1 AS (SELECT *, starts_with(lower(text), 'let''s') OR starts_with(lower(text), 'let us') AS lets, "
    "subject IS NULL AND root_verb IS NOT NULL AS defaulted FROM context), "
    "subj2 AS (SELECT * REPLACE (CASE WHEN lets THEN 'team' WHEN defaulted THEN speaker ELSE subject END AS subject), "
    f"CASE WHEN contains(text, ',') AND (opening IN {in_list(lx.FIXED_ADDRESSEES)} OR list_contains(known, opening)) "
    "THEN opening END AS addressee FROM subj1), "
    "subj3 AS (SELECT * REPLACE (CASE WHEN subject = 'you' THEN coalesce(addressee, prev_speaker, subject) ELSE subject END AS subject), "
    "CASE WHEN lets OR defaulted OR (subject = 'you' AND coalesce(addressee, prev_speaker) IS NOT NULL) THEN true END "
    f"AS subject_resolved, object IS NOT NULL AND {_vague} AS vague FROM subj2), "
    "obj1 AS (SELECT *, last_value(CASE WHEN object IS NOT NULL AND NOT vague THEN object END IGNORE NULLS) OVER "
    "(PARTITION BY meeting_id, speaker ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_object FROM subj3), "
    "obj2 AS (SELECT * REPLACE (CASE WHEN takes THEN last_object ELSE object END AS object), "
    "CASE WHEN takes THEN true END AS object_resolved FROM (SELECT *, last_object IS NOT NULL AND "
    "(coalesce(vague, false) OR (object IS NULL AND root_verb IS NOT NULL)) AS takes FROM obj1)), "
    "scored0 AS (SELECT *, coalesce(object_resolved, false) OR coalesce(subject_resolved, false) AS f1, "
    f"coalesce(lower(subject) IN {in_list(lx.TRIPLET_PRONOUNS)}, false) AS f2, "
    f"coalesce(lower(object) IN {in_list(lx.TRIPLET_PRONOUNS)}, false) AS f3, "
    f"coalesce(root_verb IN {in_list(lx.WEAK_TRIPLET_VERBS)}, false) AS f4, subject IS NULL AS f5, object IS NULL AS f6 FROM obj2), "
    "resolved AS (SELECT *, greatest(0, 100 - 20 * f1::INT - 20 * f2::INT - 20 * f3::INT - 15 * f4::INT - 20 * f5::INT "
    "- 10 * f6::INT) / 100.0::DOUBLE AS triplet_confidence, "
    "concat_ws(',', CASE WHEN f1 THEN 'resolved_via_context' END, CASE WHEN f2 THEN 'unresolved_pronoun_subject' END, "
    "CASE WHEN f3 THEN 'unresolved_pronoun_object' END, CASE WHEN f4 THEN 'weak_root_verb' END, "
    "CASE WHEN f5 THEN 'null_subject' END, CASE WHEN f6 THEN 'null_object' END) AS triplet_flags FROM scored0)"
)
_joined = "string_agg(lower(text), ' ' ORDER BY ord)"


def _count_signals(signals) -> str:
    return " + ".join(f"contains(t, {q(s)})::INT" for s in signals)


MEETING_TYPES = (
    "meeting_texts AS (SELECT meeting_id, " + _joined + " AS t FROM kept GROUP BY meeting_id), "
    f"meeting_counts AS (SELECT meeting_id, {_count_signals(lx.TASK_SIGNALS)} AS task_signals, "
    f"{_count_signals(lx.STATUS_SIGNALS)} AS status_signals FROM meeting_texts), "
    "meeting_types AS (SELECT *, CASE WHEN status_signals > task_signals * 1.5 THEN 'status_review' "
    "WHEN task_signals > status_signals THEN 'task_oriented' ELSE 'mixed' END AS meeting_type FROM meeting_counts)"
)

# --- detection -----------------------------------------------------------------------------------------
WORDS = split_ws("text")
ACTIONABLE = (
    f"(len({WORDS}) >= 4 AND {like_re('text', lx.DETECTION_VERBS)} AND NOT {like_re('text', alt(lx.NON_ACTION_SENTENCES))})"
)
HARD = like_re(trim("text"), alt(lx.HARD_FILTERS))
MODAL = "CASE " + " ".join(
    f"WHEN {like_re('text', chr(92) + 'b' + m + chr(92) + 'b')} THEN {q(m)}" for m, _ in lx.MODALS
) + " END"
STRENGTH = "CASE modal " + " ".join(f"WHEN {q(m)} THEN {s}::DOUBLE" for m, s in lx.MODALS) + " END"
BOOST = (
    f"CASE WHEN modal IS NULL THEN 0::DOUBLE ELSE least(({STRENGTH}) + CASE WHEN has_dobj THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) END"
)
PRIOR = (
    f"CASE WHEN {like_re('text', alt(lx.SUGGESTION_MARKERS))} THEN 0.5::DOUBLE ELSE "
    "CASE sentence_type WHEN 'observation' THEN 0.2::DOUBLE WHEN 'consequence' THEN 0.25::DOUBLE WHEN 'metric' THEN 0.15::DOUBLE "
    "ELSE 0.7::DOUBLE END * CASE WHEN meeting_type = 'status_review' THEN 0.7::DOUBLE ELSE 1::DOUBLE END END"
)
NEGATED = like_re("text", alt(lx.NEGATIONS))
TENSE = (
    f"CASE WHEN {like_re('text', '|'.join(lx.PAST_WORDS))} THEN 0.2::DOUBLE "
    f"WHEN {like_re('text', chr(92) + 'b(' + '|'.join(lx.PROGRESSIVE_WORDS) + ')' + chr(92) + 'b')} THEN 0.3::DOUBLE "
    "WHEN root_tag IN ('VBD', 'VBN') THEN 0.2::DOUBLE WHEN root_tag = 'VBG' THEN 0.3::DOUBLE ELSE 1::DOUBLE END"
)
FEATURES = (
    f"features AS (SELECT *, {BOOST} AS modal_boost, {PRIOR} AS downward_prior, {TENSE} AS tense_prior, {NEGATED} AS has_negation "
    f"FROM (SELECT r.*, meeting_type, {MODAL} AS modal FROM resolved r JOIN meeting_types USING (meeting_id)))"
)


def _part(a: int, b: int, n: int) -> str:
    return f"((meeting_id * {a} + sentence_id * {b}) % {n} + 1) / {n}::DOUBLE"


CALL_SCORES = (
    f"scored AS (SELECT *, {_part(3, 7, 11)} AS p1, {_part(5, 3, 13)} AS p2, {_part(2, 5, 17)} AS p3, "
    f"{_part(7, 2, 19)} AS c1, {_part(11, 5, 7)} AS c2, {_part(1, 9, 23)} AS c3 FROM features)"
)


def _class(a, b, c):
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 'decision' WHEN {b} >= {c} THEN 'commitment' ELSE 'discussion' END"


ZONE = "CASE WHEN {0} >= 0.7::DOUBLE THEN 'high' WHEN {0} >= 0.4::DOUBLE THEN 'review' ELSE 'low' END"
HYBRID = (
    f"model AS (SELECT *, {_class('p1', 'p2', 'p3')} AS kind, greatest(p1, p2, p3) / (p1 + p2 + p3) AS base, "
    f"{_class('c1', 'c2', 'c3')} AS ctx_kind, greatest(c1, c2, c3) / (c1 + c2 + c3) AS ctx, {HARD} AS hard, {ACTIONABLE} AS rule, "
    f"{ACCEPTANCE} AS accepts FROM scored), "
    "fused AS (SELECT *, CASE WHEN has_negation THEN 0.1::DOUBLE ELSE least(base * downward_prior * tense_prior + modal_boost * 0.3::DOUBLE, 1::DOUBLE) END AS feat FROM model), "
    "final AS (SELECT *, CASE WHEN has_negation THEN 0.1::DOUBLE ELSE least(ctx * 0.4::DOUBLE + feat * 0.6::DOUBLE, 1::DOUBLE) END AS fin FROM fused), "
    f"merged AS (SELECT *, {ZONE.format('fin')} AS zone, NOT hard AND ((kind IN ('decision', 'commitment') AND fin >= 0.4::DOUBLE) OR rule) AS dec0, "
    "CASE WHEN hard THEN 0.1::DOUBLE ELSE fin END AS conf0 FROM final), "
    "detected AS (SELECT *, prev_is_request AND accepts AS pair, dec0 OR (prev_is_request AND accepts) AS is_decision, "
    "CASE WHEN prev_is_request AND accepts AND conf0 < 0.8::DOUBLE THEN 0.85::DOUBLE ELSE conf0 END AS confidence, "
    "CASE WHEN prev_is_request AND accepts AND conf0 < 0.8::DOUBLE THEN 'high' WHEN hard THEN 'low' ELSE zone END AS confidence_zone FROM merged)"
)
RULE = f"detected AS (SELECT r.*, meeting_type, {ACTIONABLE} AS is_decision, false AS hard FROM resolved r JOIN meeting_types USING (meeting_id))"

# --- extraction, tasks ---------------------------------------------------------------------------------
VALID_DEADLINE = (
    f"(length(trim(d)) >= 3 AND NOT {like_re('d', alt(lx.INVALID_DEADLINES))} AND {like_re('d', lx.DEADLINE_ANCHORS)})"
)


def deadline_sql(expr: str) -> str:
    found = ", ".join(trim(ext(expr, p, 0)) for p in lx.DEADLINES)
    return f"list_filter([{found}], lambda d: {VALID_DEADLINE})[1]"


_cap = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"
LEAD = (
    f"list_transform(list_filter(list_transform({split_ws('lower(text)')}[1:3], lambda w: rtrim(w, ',:')), "
    f"lambda w: w <> '' AND (list_contains(known, w) OR list_contains(known, {_cap}))), lambda w: {_cap})[1]"
)
MENTION = (
    "list_sort(list_transform(list_filter(known, lambda n: regexp_matches(text, '\\b' || regexp_escape(n) || '\\b', 'i')), "
    "lambda n: {'at': length(regexp_extract(text, '^(.*?)\\b' || regexp_escape(n) || '\\b', 1, 'i')), 'name': n}))[1].name"
)
EXTRACTED = (
    f"named AS (SELECT *, lower(coalesce(subject, '')) AS who, {LEAD} AS lead_speaker, {MENTION} AS mentioned_speaker, "
    f"{deadline_sql('text')} AS deadline FROM detected WHERE is_decision), "
    "extracted AS (SELECT *, CASE WHEN who IN ('i', 'me') THEN speaker WHEN lead_speaker IS NOT NULL THEN lead_speaker "
    f"WHEN who IN {in_list(lx.TEAM_SUBJECTS)} THEN 'team' ELSE coalesce(mentioned_speaker, speaker) END AS assignee FROM named)"
)


def rule_title(expr: str, openings=lx.CONVERSATIONAL_OPENINGS, nouns=()) -> str:
    out = trim(expr)
    for mark in (". ", "? ", "! "):
        out = trim(f"split_part({out}, {q(mark)}, 1)") if not nouns and openings is lx.CONVERSATIONAL_OPENINGS else out
    for opening in openings:
        out = trim(sub(out, opening, "", "i"))
    for filler in lx.TITLE_FILLERS:
        out = trim(sub(out, filler))
    for pronoun, noun in nouns:
        out = sub(out, rf"\b{pronoun}\b", noun)
    out = trim(sub(out, r"\s{2,}", " ", "g"))
    out = trim(f"rtrim(rtrim({out}, '?'), '.')")
    for name in lx.DAYS + lx.MONTHS:
        out = sub(out, rf"\b{name}\b", name.capitalize())
    return out


def finish_title(column: str) -> str:
    body = f"upper(substr({column}, 1, 1)) || substr({column}, 2)"
    return f"CASE WHEN {column} = '' OR ends_with({column}, '.') THEN {body} ELSE {body} || '.' END"


_imperatives = "CASE lower(root_verb) " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.VERB_IMPERATIVES.items()
) + " ELSE upper(substr(root_verb, 1, 1)) || lower(substr(root_verb, 2)) END"


def valid_title(column: str) -> str:
    ws = split_ws(f"rtrim({trim(column)}, '.')")
    return (
        f"coalesce(len({ws}) > 1 AND NOT ends_with({trim(column)}, '?') AND NOT regexp_full_match(coalesce(({ws})[-1], ''), '\\d+'), false)"
    )


TITLED = (
    f"titles0 AS (SELECT *, CASE WHEN root_verb IS NOT NULL THEN {_imperatives} || CASE WHEN coalesce(trim(object), '') = '' THEN '' "
    "ELSE ' ' || upper(substr(trim(object), 1, 1)) || substr(trim(object), 2) END END AS trip0, "
    f"{rule_title('text')} AS rule0 FROM extracted), "
    f"titles1 AS (SELECT *, {finish_title('trip0')} AS trip, {finish_title('rule0')} AS ruled FROM titles0), "
    f"titles2 AS (SELECT *, CASE WHEN trip IS NOT NULL AND {valid_title('trip')} AND NOT (coalesce(root_verb, '') IN {in_list(lx.WEAK_TITLE_VERBS)} "
    f"AND lower(coalesce(object, '')) IN {in_list(lx.EMPTY_OBJECTS + [''])}) THEN trip ELSE ruled END AS task FROM titles1), "
    f"built AS (SELECT *, 'task_' || row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS task_id FROM titles2 WHERE {valid_title('task')})"
)
TASKS = (
    "graded AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, 1::DOUBLE * 0.5::DOUBLE + CASE WHEN coalesce(assignee, '') <> '' THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE "
    "+ CASE WHEN coalesce(assignee, '') <> '' THEN 1::DOUBLE ELSE 0.5::DOUBLE END * 0.15::DOUBLE "
    "+ CASE WHEN coalesce(deadline, '') <> '' THEN 1::DOUBLE ELSE 0.6::DOUBLE END * 0.15::DOUBLE)) AS task_confidence FROM built), "
    f"valid AS (SELECT * FROM graded WHERE NOT (task_confidence < 0.5 OR hard OR {like_re('text', alt(lx.INVALID_TASK_TEXTS))} "
    "OR (meeting_type = 'status_review' AND task_confidence < 0.65) OR (sentence_type IN ('observation', 'consequence', 'metric') AND task_confidence < 0.75))), "
    "tasks AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY meeting_id, lower(trim(task)) ORDER BY task_confidence DESC, ord) = 1)"
)

STANDUP_SENTENCES = [STANDUPS, *RAW_TURNS, *SENTENCE_CHAIN]
CALL_SENTENCES = [CALLS, *SENTENCE_CHAIN]
STANDUP_RESOLVED = [*STANDUP_SENTENCES, ANNOTATED, SPEAKERS, CONTEXT, RESOLVED]
CALL_RESOLVED = [*CALL_SENTENCES, ANNOTATED, SPEAKERS, CONTEXT, RESOLVED]
STANDUP_TASKS = [*STANDUP_RESOLVED, MEETING_TYPES, RULE, EXTRACTED, TITLED, TASKS]
CALL_RULE = [*CALL_RESOLVED, MEETING_TYPES, RULE]
CALL_HYBRID = [*CALL_RESOLVED, MEETING_TYPES, FEATURES, CALL_SCORES, HYBRID]
