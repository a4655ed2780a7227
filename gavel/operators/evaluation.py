"""Predictions against gold labels. Every measure is a join of pre-aggregated counts or a plain aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.greedy import first_matching
from gavel.functions.pairs import similar_across
from gavel.functions.text import strip
from gavel.session import cut_lineage


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 from tp, fp, fn."""
    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def match_key(text: Column) -> Column:
    """Two texts match exactly when their keys are equal; blank texts never match."""
    return F.nullif(F.lower(strip(text)), F.lit(""))


def exact_matches(pred: DataFrame, gold: DataFrame, by: list[str], pred_text: str, gold_text: str) -> DataFrame:
    """J4, exact: greedy one-to-one matching of equal keys pairs off min(count, count) of each key, so counts
    per key are enough and no row is joined with another row of a hot key."""
    p = pred.groupBy(*by, match_key(F.col(pred_text)).alias("_k")).agg(F.count(F.lit(1)).alias("_p"))
    g = gold.groupBy(*by, match_key(F.col(gold_text)).alias("_k")).agg(F.count(F.lit(1)).alias("_g"))
    # Blank keys are null and stay unmatched in the full join, which is what they count as.
    return (
        p.join(g, [*by, "_k"], "full")
        .groupBy(*by)
        .agg(
            # `least` skips nulls, so one-sided keys are taken out explicitly.
            F.coalesce(
                F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.least("_p", "_g"))), F.lit(0)
            ).alias("tp"),
            F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pred"),
            F.coalesce(F.sum("_g"), F.lit(0)).alias("n_gold"),
        )
    )


def similar_matches(
    pred: DataFrame,
    gold: DataFrame,
    by: list[str],
    pred_value: str,
    gold_value: str,
    threshold: float,
    vectors: bool = False,
) -> DataFrame:
    """J2-J4, partial and semantic: candidate pairs at or above the threshold, then the greedy matching in
    prediction order. Both sides need `idx`, their order inside the meeting."""
    # Both sides are read several times (blocks, sizes); store them instead of recomputing what made them.
    pred = cut_lineage(pred.select(*by, "idx", F.col(pred_value).alias("v")))
    gold = cut_lineage(gold.select(*by, "idx", F.col(gold_value).alias("v")))
    usable = (lambda df: df) if vectors else (lambda df: df.withColumn("v", F.nullif(strip(F.col("v")), F.lit(""))))
    # Missing and blank values match nothing; they stay in the counts.
    candidates = similar_across(*[usable(df).where("v IS NOT NULL") for df in (pred, gold)], by, "v", threshold, texts=not vectors).select(*by, F.col("lo").alias("left"), F.col("hi").alias("right"))
    tp = first_matching(candidates, by).groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    n_pred = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    n_gold = gold.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold"))
    return n_pred.join(n_gold, by, "full").join(tp, by, "left").select(
        *by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "n_pred", "n_gold")]
    )


def match_metrics(counts: DataFrame, empty_gold_counts_predictions: bool = False) -> DataFrame:
    """Tp, fp, fn and precision, recall, F1; all zero where either side is empty. The decision variant
    still counts the predictions of a meeting without gold as false positives."""
    none = (F.col("n_pred") == 0) | (F.col("n_gold") == 0)
    fp = F.col("n_pred") - F.col("tp")
    fn = F.col("n_gold") - F.col("tp")
    if empty_gold_counts_predictions:
        counted = counts.withColumn("fp", fp).withColumn("fn", fn)
    else:
        counted = counts.withColumn("fp", F.when(none, 0).otherwise(fp)).withColumn("fn", F.when(none, 0).otherwise(fn))
    return with_prf(counted)


def extraction_quality(tasks: DataFrame, by: list[str]) -> DataFrame:
    """J5."""
    filled = [F.coalesce(c, F.lit("")) != "" for c in ("task", "assignee", "deadline")]
    complete = F.avg((filled[0] & filled[1] & filled[2]).cast("double"))
    return tasks.groupBy(*by).agg(
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"),
        complete.alias("completeness"),
        (F.lit(1.0) - complete).alias("na_rate"),
        F.count(F.lit(1)).alias("total_tasks"),
    )


def detection_quality(decisions: DataFrame, by: list[str]) -> DataFrame:
    """J6."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(confidence).alias("avg_confidence"),
        F.avg((confidence > 0.8).cast("double")).alias("high_confidence"),
    )


def sentence_confusion(pred: DataFrame, gold: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Position-aligned labels. `error` is set where the two sides differ in length.

    `key` identifies a position (its prefix `by` the meeting); both sides hold `is_decision`.
    """
    p = F.coalesce("p.is_decision", F.lit(False))
    g = F.coalesce("g.is_decision", F.lit(False))
    both = F.col("p.is_decision").isNotNull() & F.col("g.is_decision").isNotNull()
    joined = pred.select(*key, F.struct("is_decision", "confidence").alias("p")).join(
        gold.select(*key, F.struct("is_decision").alias("g")), key, "full"
    )
    counted = joined.groupBy(*by).agg(
        F.count_if(both & p & g).alias("tp"),
        F.count_if(both & p & ~g).alias("fp"),
        F.count_if(both & ~p & g).alias("fn"),
        F.count_if(both & ~p & ~g).alias("tn"),
        F.avg(F.when(F.col("p").isNotNull(), F.coalesce("p.confidence", F.lit(0.5)))).alias("avg_confidence"),
        F.when(
            F.count("p") != F.count("g"), F.lit("Predicted and gold lists must have same length")
        ).alias("error"),
    )
    correct = F.col("tp") + F.col("tn")
    total = correct + F.col("fp") + F.col("fn")
    return (
        with_prf(counted)
        .withColumn("correct", correct)
        .withColumn("incorrect", F.col("fp") + F.col("fn"))
        .withColumn("accuracy", ratio(correct, total))
    )


def confidence_distribution(predictions: DataFrame, by: list[str]) -> DataFrame:
    """J8."""
    yes = F.coalesce("is_decision", F.lit(False))
    c = F.coalesce("confidence", F.lit(0.5))
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(yes).alias("decisions"),
        F.count_if(~yes).alias("non_decisions"),
        F.avg(c).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(yes, c)), F.lit(0.0)).alias("avg_decision_confidence"),
        F.coalesce(F.avg(F.when(~yes, c)), F.lit(0.0)).alias("avg_non_decision_confidence"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.count_if(yes & (F.coalesce("confidence", F.lit(0.0)) > 0.8)).alias("high_confidence_decisions"),
        F.count_if(yes & (F.coalesce("confidence", F.lit(0.0)) < 0.5)).alias("low_confidence_decisions"),
    )


def evaluate_tasks(
    pred: DataFrame, gold: DataFrame, match_type: str = "exact", threshold: float | None = None,
    meetings: DataFrame | None = None,
) -> DataFrame:
    """Metrics, quality and counts per predicted meeting that has gold; the others are skipped.

    `meetings` lists the predicted meetings (meeting_id), among them those whose prediction is empty, which count
    as zeros; by default those with a prediction. `semantic` compares `vector` columns, `partial` text ratios, `exact` keys.
    """
    by = ["meeting_id"]
    if match_type == "partial":
        counts = similar_matches(pred, gold, by, "task", "task", threshold or lx.PARTIAL_MATCH_RATIO)
    elif match_type == "semantic":
        counts = similar_matches(pred, gold, by, "vector", "vector", threshold or lx.SEMANTIC_TASK_COSINE, True)
    else:
        counts = exact_matches(pred, gold, by, "task", "task")
    measured = match_metrics(counts).where(F.col("n_gold") > 0).join((pred if meetings is None else meetings).select(*by).distinct(), by)
    quality = extraction_quality(pred, by)
    zeros = {c: 0 for c in quality.columns if c not in by}
    return measured.join(quality, by, "left").fillna(zeros).withColumn("match_type", F.lit(match_type))


def set_evaluation(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct normalised texts against gold positives, per meeting and as a micro total (null meeting).

    Both sides are `(meeting_id, text)`; distinct texts make one full join enough for all three counts.
    """
    def keys(df: DataFrame, flag: str) -> DataFrame:
        return (
            df.select("meeting_id", match_key(F.col("text")).alias("k"))
            .where(F.col("k").isNotNull())
            .distinct()
            .withColumn(flag, F.lit(1))
        )

    both = keys(pred, "p").join(keys(gold, "g"), ["meeting_id", "k"], "full")
    counts = both.rollup("meeting_id").agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"),
        F.count_if(F.col("p").isNotNull() & F.col("g").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull() & F.col("g").isNotNull()).alias("fn"),
        F.grouping("meeting_id").alias("is_total"),
    )
    return with_prf(counts)


def report_lines(results: DataFrame) -> DataFrame:
    """One formatted text per evaluated meeting."""
    # The thousandths are rounded as a double, like in the checking SQL: F.round goes by the decimal text and makes
    # 0.501 of 0.5005, which lies below that half.
    three = lambda c: F.format_string("%.3f", F.round(F.coalesce(c, F.lit(0.0)) * 1000) / 1000)
    return results.select(
        "meeting_id",
        F.concat_ws(
            "\n",
            F.concat(F.col("meeting_id").cast("string"), F.lit(":")),
            F.concat(F.lit("  Gold: "), F.col("n_gold"), F.lit(" tasks")),
            F.concat(F.lit("  Predicted: "), F.col("n_pred"), F.lit(" tasks")),
            F.concat(F.lit("  Precision: "), three("precision")),
            F.concat(F.lit("  Recall: "), three("recall")),
            F.concat(F.lit("  F1-Score: "), three("f1")),
            F.concat(F.lit("  Completeness: "), three("completeness")),
            F.concat(F.lit("  Avg Confidence: "), three("avg_confidence")),
        ).alias("report"),
    )


def cohen_kappa(labels: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Agreement of two annotators on a boolean label, corrected for chance."""
    n = F.count(F.lit(1))
    agree = F.avg((F.col(a) == F.col(b)).cast("double"))
    pa, pb = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    counted = labels.groupBy(*by).agg(n.alias("n"), agree.alias("observed"), pa.alias("_a"), pb.alias("_b"))
    expected = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return (
        counted.withColumn("expected", expected)
        .withColumn(
            "kappa",
            F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0),
        )
        .withColumn("acceptable", F.col("kappa") >= 0.70)
        .drop("_a", "_b")
    )
