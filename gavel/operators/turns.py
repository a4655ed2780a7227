"""Raw transcripts -> turns -> sentences.

A transcript is one row, and the upload check bounds its size. Lines, turns and sentences are therefore
derived inside the row with array functions: numbering is the array position, the whole step is a narrow map
stage behind the scan, and nothing is shuffled until a dialogue window needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import ordered
from gavel.functions.text import clean, is_bare, is_stop_sentence, let, split_sentences, strip, strip_value


def lines_of(raw_text: Column) -> Column:
    """B1: non-blank trimmed lines of a document."""
    return F.filter(F.transform(F.split(strip(raw_text), "\n"), strip_value), lambda s: s != "")


def parse_line(line: Column, allow_mmss: bool = False) -> Column:
    """struct(timestamp, speaker, text); the speaker is null where no format matches.

    Plain character tests decide which format can apply; each pattern then runs once, rewriting the line to its
    fields around a separator that no trimmed line holds (a line break).
    """
    def fields(pattern: str, order: str) -> Column:
        return F.split(F.regexp_replace(line, "(?dU)" + pattern, order), "\n")

    def entry(timestamp: Column, speaker: Column, text: Column) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            (null if timestamp is None else timestamp).alias("timestamp"),
            (null if speaker is None else speaker).alias("speaker"),
            text.alias("text"),
        )

    def dashed(_: Column | None = None) -> Column:
        parts = fields(lx.DASH_LINE, "$1\n$2")
        match = let(
            parts,
            lambda p: F.when(F.size(p) == 2, entry(None, strip(p[0]), strip(p[1]))).otherwise(entry(None, None, line)),
        )
        return F.when(F.contains(line, F.lit("-")), match).otherwise(entry(None, None, line))

    def coloned() -> Column:
        # Spaces go first, as they are the common case and cheap to trim; mostly nothing is left to strip then.
        pair = F.array(F.trim(F.substring_index(line, ":", 1)), F.trim(F.substr(line, F.instr(line, ":") + 1)))

        def stripped(p: Column) -> Column:
            return let(
                F.array(strip(p[0]), strip(p[1])),
                lambda q: F.when((q[0] != "") & (q[1] != ""), entry(None, q[0], q[1])).otherwise(dashed()),
            )

        match = let(pair, lambda p: F.when(is_bare(p[0]) & is_bare(p[1]), entry(None, p[0], p[1])).otherwise(stripped(p)))
        return F.when(F.contains(line, F.lit(":")), match).otherwise(dashed())

    stamp = lx.SHORT_TIMESTAMP_LINE if allow_mmss else lx.TIMESTAMP_LINE
    stamped = let(
        fields(stamp, "$1\n$2\n$3"),
        lambda p: F.when((F.size(p) == 3) & (strip_value(p[1]) != ""), entry(p[0], strip_value(p[1]), strip_value(p[2]))).otherwise(coloned()),
    )
    return F.when(line.startswith("["), stamped).otherwise(coloned())


def turn_arrays(transcripts: DataFrame, allow_mmss: bool = False) -> DataFrame:
    """Add `n_lines` and `turns`, the array of (turn_id, speaker, timestamp, text)."""
    parsed = transcripts.withColumn(
        "_lines", F.transform(lines_of(F.col("raw_text")), lambda s: parse_line(s, allow_mmss))
    )
    # A turn starts at every matched line and, for text without a speaker, at the first line.
    starts = F.filter(
        F.transform("_lines", lambda s, i: F.when(s["speaker"].isNotNull() | (i == 0), i)),
        lambda i: i.isNotNull(),
    )

    def turn(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
        head = F.get("_lines", start)
        body = F.transform(F.slice("_lines", start + 1, end - start), lambda s: s["text"])
        return F.struct(
            (k + 1).alias("turn_id"),
            F.coalesce(head["speaker"], F.lit(lx.UNKNOWN_SPEAKER)).alias("speaker"),
            head["timestamp"].alias("timestamp"),
            let(F.array_join(body, " "), strip_value).alias("text"),
        )

    return (
        parsed.withColumn("_starts", starts)
        .withColumn("turns", F.transform("_starts", turn))
        .withColumn("n_lines", F.size("_lines"))
        .drop("_lines", "_starts")
    )


def parse_turns(transcripts: DataFrame, allow_mmss: bool = False) -> DataFrame:
    """One row per turn."""
    exploded = turn_arrays(transcripts.select("meeting_id", "raw_text"), allow_mmss).select(
        "meeting_id", F.explode_outer("turns").alias("t")
    )
    return exploded.where(F.col("t").isNotNull()).select("meeting_id", "t.turn_id", "t.speaker", "t.timestamp", "t.text")


def known_speakers(turns: DataFrame) -> DataFrame:
    """B7 over a turn table: distinct non-empty speakers per meeting, combined map-side."""
    return (
        turns.where(F.coalesce("speaker", F.lit("")) != "")
        .groupBy("meeting_id")
        .agg(F.array_sort(F.collect_set("speaker")).alias("known_speakers"))
    )


def with_known_speakers(sentences: DataFrame, turns: DataFrame) -> DataFrame:
    """Sentences of a turn table with their meeting's speakers, as the raw-text path has them; an empty list where
    nobody is named. One small row per meeting is joined; `prepare` uses the list up before anything else moves."""
    known = F.coalesce("known_speakers", F.array().cast("array<string>"))
    return sentences.join(known_speakers(turns), "meeting_id", "left").withColumn("known_speakers", known)


def meeting_type_of(lower_text: Column) -> Column:
    """D10 on a meeting's joined lower-case text: counts of distinct signals, compared."""
    def hits(signals):
        total = F.lit(0)
        for s in signals:
            total = total + F.contains(lower_text, F.lit(s)).cast("int")
        return total

    return meeting_type_from(hits(lx.TASK_SIGNALS), hits(lx.STATUS_SIGNALS))


def meeting_type_from(task: Column, status: Column) -> Column:
    return (
        F.when(status > task * F.lit(lx.STATUS_DOMINANCE), "status_review")
        .when(task > status, "task_oriented")
        .otherwise("mixed")
    )


def sentence_arrays(transcripts: DataFrame, allow_mmss: bool = False) -> DataFrame:
    """B + C for whole meetings, one row per meeting:

    `sentences` holds the cleaned, unfiltered survivors of the stop filter as (sentence_id, turn_id, speaker,
    timestamp, text); ids were given before filtering and keep their gaps. Also `known_speakers` (B7),
    `meeting_type` (D10), `meeting_chars` and the counters of B8.
    """
    turned = turn_arrays(transcripts.select("meeting_id", "raw_text"), allow_mmss)
    per_turn = F.transform(
        "turns",
        lambda t: F.transform(
            split_sentences(t["text"]),
            lambda s: F.struct(
                t["turn_id"].alias("turn_id"),
                t["speaker"].alias("speaker"),
                t["timestamp"].alias("timestamp"),
                s.alias("text"),
            ),
        ),
    )
    numbered = F.transform(
        F.flatten(per_turn),
        lambda s, i: F.struct(
            (i + 1).alias("sentence_id"),
            s["turn_id"].alias("turn_id"),
            s["speaker"].alias("speaker"),
            s["timestamp"].alias("timestamp"),
            clean(s["text"]).alias("text"),
        ),
    )
    return (
        turned.withColumn("_all", numbered)
        .withColumn("_clean", F.filter("_all", lambda s: s["text"] != ""))
        .withColumn("sentences", F.filter("_clean", lambda s: ~is_stop_sentence(s["text"])))
        .select(
            "meeting_id",
            F.length("raw_text").alias("meeting_chars"),
            "n_lines",
            F.size("turns").alias("n_turns"),
            F.size("_all").alias("n_sentences"),
            F.size("_clean").alias("n_clean"),
            F.size("sentences").alias("n_kept"),
            F.array_sort(F.array_distinct(F.transform("turns", lambda t: t["speaker"]))).alias(
                "known_speakers"
            ),
            F.lower(F.array_join(F.transform("sentences", lambda s: s["text"]), " ")).alias("_text"),
            "sentences",
        )
        .withColumn("meeting_type", meeting_type_of(F.col("_text")))
        .drop("_text")
    )


def sentences_from_transcripts(transcripts: DataFrame, allow_mmss: bool = False) -> DataFrame:
    """One row per surviving sentence; `ord` is its dense 0-based position in the meeting."""
    # The outer form keeps the optimizer from adding a size check of the array below the explode, which would
    # evaluate the whole parsing expression once more.
    return (
        sentence_arrays(transcripts, allow_mmss)
        .select(
            "meeting_id", "meeting_type", "known_speakers", F.posexplode_outer("sentences").alias("ord", "s")
        )
        .where(F.col("ord").isNotNull())
        .select(
            "meeting_id", "meeting_type", "known_speakers", F.col("ord").cast("long").alias("ord"),
            "s.sentence_id", "s.turn_id", "s.speaker", "s.timestamp", "s.text",
        )
    )


def stage_metrics(transcripts: DataFrame) -> DataFrame:
    """Counters per meeting, without touching any other row."""
    return sentence_arrays(transcripts).select(
        "meeting_id", "meeting_chars", "n_lines", "n_turns", "n_sentences", "n_kept",
        (F.col("n_clean") - F.col("n_kept")).alias("n_removed"),
    )


# --- turn tables: one utterance per row, possibly millions of rows in one meeting ----------------------


def turns_from_lines(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """B2-B6 for transcripts stored one line per row: `(meeting_id, line_no, line)`.

    Turn numbers are a running sum of turn starts. Turns are grouped by (meeting, turn) and hold only that
    turn's lines. `rows` as given by `ordered.segment_rows`.
    """
    parsed = (
        lines.select("meeting_id", "line_no", strip(F.col("line")).alias("line"))
        .where(F.col("line") != "")
        .withColumn("p", parse_line(F.col("line")))
    )
    # A turn starts at every matched line and at the first line of a meeting, matched or not.
    placed = ordered.number_rows(parsed, ["meeting_id"], "line_no", "_n", rows)
    starts = (F.col("p.speaker").isNotNull() | (F.col("_n") == 1)).cast("int")
    numbered = ordered.running_total(placed, ["meeting_id"], "line_no", {"turn_id": starts}, rows)
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", F.col("p.text").alias("text")))), lambda s: s["text"]
    )
    return (
        numbered.withColumn("turn_id", F.col("turn_id").cast("int"))
        .groupBy("meeting_id", "turn_id")
        .agg(
            F.coalesce(F.max("p.speaker"), F.lit(lx.UNKNOWN_SPEAKER)).alias("speaker"),
            F.max("p.timestamp").alias("timestamp"),
            F.array_join(text, " ").alias("text"),
        )
    )


def sentences_from_turns(turns: DataFrame, rows: int | None = None) -> DataFrame:
    """C1, C2, C10, C11 over a turn table `(meeting_id, turn_id, speaker, timestamp, text)`.

    `turn_id` may be any unique non-negative integer per meeting. Sentence ids and the dense order of the
    survivors are two running sums of per-turn counts, taken in one pass.
    """
    cleaned = turns.withColumn("_all", F.transform(split_sentences(F.col("text")), clean))
    counted = cleaned.withColumn(
        "_kept",
        F.filter(
            F.transform("_all", lambda s, i: F.struct(i.alias("i"), s.alias("text"))),
            lambda s: (s["text"] != "") & ~is_stop_sentence(s["text"]),
        ),
    ).select("meeting_id", "turn_id", "speaker", "timestamp", F.size("_all").alias("_n_all"), "_kept")
    numbered = ordered.running_total(
        counted, ["meeting_id"], "turn_id", {"_sentences": F.col("_n_all"), "_survivors": F.size("_kept")}, rows
    )
    return (
        numbered.select("*", F.posexplode_outer("_kept").alias("_k", "_s"))
        .where(F.col("_k").isNotNull())
        .select(
            "meeting_id",
            (F.col("_survivors") - F.size("_kept") + F.col("_k")).alias("ord"),
            (F.col("_sentences") - F.col("_n_all") + F.col("_s.i") + 1).alias("sentence_id"),
            "turn_id",
            "speaker",
            "timestamp",
            "_s.text",
        )
    )
