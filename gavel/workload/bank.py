"""Meeting corpora derived from the given tables.

The text columns of the tables hold invented words without speakers, modals or deadlines. The corpora below
therefore take their rows, ids, order and sizes from `events` and their wording from a fixed list of sample
sentences, picked by arithmetic on the row's id. Spark and the checking SQL build the same text.

* `standups`: one raw transcript per event (eight lines in mixed formats).
* `calls`: one utterance per event; the user is the meeting, the event id the order, so a busy user is a
  large meeting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


NAMES = ["Mara", "Theo", "Priya", "Luca", "Ines", "Omar", "Wei"]

PHRASES = [
    "I will draft the launch plan by Monday.",
    "Good morning everyone.",
    "Can you review the billing report before Friday?",
    "Sure, I can do that.",
    "Revenue is up 12% compared to last quarter.",
    "Let's schedule the security audit for next week.",
    "We should migrate the search index by end of June.",
    "That's great.",
    "I finished the onboarding screens yesterday.",
    "Mara, please update the release notes by tomorrow.",
    "The dashboard is very slow today.",
    "I'll fix it by Thursday.",
    "Perfect.",
    "You need to send the contract to legal by March 15.",
    "We must not deploy the patch on Friday.",
    "Um, I think we should like test the um payment flow first.",
    "Churn went from 3% to 5%.",
    "Theo, can you write the migration guide?",
    "Yes, I'll handle it.",
    "Everyone should check the new style guide.",
    "Pls do the needful asap.",
    "I am working on the export service.",
    "Maybe we could investigate the cache misses.",
    "Thanks everyone.",
    "Please prepare the budget summary for the board.",
    "They will coordinate with Priya and Omar on the rollout.",
    "I have to document the API before the end of the quarter.",
    "Conversion rate is looking good this month.",
    "Let's start with the roadmap.",
    "Don't optimize the query planner yet.",
    "The board will be happy with the numbers.",
    "Could someone organize the design workshop on 2024-05-17?",
    "Okay, will do.",
    "Luca should validate the invoices by Q3.",
    "I would propose a smaller scope.",
    "Anything else?",
    "We need to finalize the vendor list by next Wednesday, ok?",
    "Kindly prepone the demo.",
    "I'll look into the flaky builds.",
    "The customers switched to a competitor.",
    "Build the staging cluster and test that tomorrow.",
    "Ines, have the prototype ready by tonight.",
    "It seems the retention is down.",
    "Create a checklist for the audit on 12/05.",
    "I can take this.",
    "We lost two servers last week.",
    "Meeting starts at 10:30 in the blue room.",
    "Refactor the import job; document those steps.",
    "No problem.",
    "Wei will monitor the alerts tonight.",
    "I'm going to compile the survey results by end of the week.",
    "Send it to the customers.",
    "Review them again!",
    "What if we audit the access logs?",
    "Have a good weekend and a nice week.",
    "We'll integrate the chat widget in the portal.",
    "Just verify the totals, like running the checks twice.",
    "Add 3 tests.",
    "Update 2000.",
    "The team must resolve the open incidents by 15 August.",
    "Right.",
    "You could summarize the interviews and share it with us.",
    "Implement the retry logic   and   then run that.",
    "Also we need to plan the offsite.",
]

LINES = 8
TASK_EVENTS = 50_000


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def event_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The events that name the rows, dealt evenly: wordings of many characters are made from each narrow row, so the
    number of tasks grows with the rows (their count stands in the files' footers), not with the bytes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_EVENTS)))


def standups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(meeting_id, raw_text)`, one transcript per event."""
    e = F.col("event_id")

    def line(k: Column) -> Column:
        phrase = _pick(PHRASES, (e * 7 + k * 13 + F.floor(e / 64) * k) % 64)
        name = _pick(NAMES, (e + k * k) % 7)
        kind = (e + k) % 5
        return (
            F.when(kind < 2, F.concat(F.lit("  "), name, F.lit(": "), phrase))
            .when(kind == 2, F.concat(name, F.lit(" - "), phrase, F.lit(" \n")))
            .when(kind == 3, F.concat(F.lit("[00:0"), k.cast("string"), F.lit(":30] "), name, F.lit(": "), phrase))
            .otherwise(phrase)
        )

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(LINES - 1)), lambda k: line(k.cast("long"))), "\n")
    events = event_rows(spark, sf_dir, "event_id")
    return events.select(e.alias("meeting_id"), text.alias("raw_text"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(meeting_id, turn_id, speaker, timestamp, text)`, one utterance per event."""
    e = F.col("event_id")
    first = _pick(PHRASES, (e * 11 + F.floor(e / 64)) % 64)
    second = _pick(PHRASES, (e * 5 + 3) % 64)
    return event_rows(spark, sf_dir, "event_id", "user_id").select(
        F.col("user_id").alias("meeting_id"),
        e.alias("turn_id"),
        _pick(NAMES, (e + F.floor(e / 50)) % 7).alias("speaker"),
        F.lit(None).cast("string").alias("timestamp"),
        F.when(e % 3 == 0, F.concat(first, F.lit(" "), second)).otherwise(first).alias("text"),
    )


def call_scores(turns: DataFrame) -> DataFrame:
    """Class scores for hybrid detection, derived from ids: stands in for a caller's score table."""
    a, b = F.col("meeting_id"), F.col("sentence_id")
    part = lambda m, k, n: ((a * m + b * k) % n + 1) / F.lit(float(n))
    return turns.select(
        "meeting_id", "sentence_id",
        part(3, 7, 11).alias("p_decision"), part(5, 3, 13).alias("p_commitment"), part(2, 5, 17).alias("p_discussion"),
        part(7, 2, 19).alias("ctx_p_decision"), part(11, 5, 7).alias("ctx_p_commitment"), part(1, 9, 23).alias("ctx_p_discussion"),
    )
