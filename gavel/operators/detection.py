"""Decision detection: rules, score fusion, zones and request/answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import signals as sg
from gavel.functions.models import apply_where
from gavel.functions.text import once
from gavel.operators.context import pair_acceptances

SCORES = ["p_decision", "p_commitment", "p_discussion"]
CONTEXT_SCORES = ["ctx_p_decision", "ctx_p_commitment", "ctx_p_discussion"]


def detect_by_rules(sentences: DataFrame, min_words: int = lx.MIN_DECISION_WORDS) -> DataFrame:
    """E1."""
    return (
        sentences.withColumn("is_decision", sg.is_actionable(F.col("text"), min_words))
        .withColumn("confidence", F.when(F.col("is_decision"), 1.0).otherwise(0.0))
        .withColumn("method", F.lit("rule_based"))
    )


def with_features(sentences: DataFrame, include_lets: bool = False) -> DataFrame:
    """Modal, boost, priors and negation. Optional inputs: sentence_type, meeting_type, has_dobj,
    root_tag; a missing one counts as absent."""
    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in sentences.columns else F.lit(None).cast(kind)

    text = F.col("text")
    return (
        sentences.withColumn("modal", sg.modal(text, include_lets))
        .withColumn("modal_boost", sg.modal_boost(F.col("modal"), optional("has_dobj", "boolean")))
        .withColumn(
            "downward_prior",
            sg.downward_prior(text, optional("sentence_type", "string"), optional("meeting_type", "string")),
        )
        .withColumn("tense_prior", sg.tense_prior(text, optional("root_tag", "string")))
        .withColumn("has_negation", sg.has_negation(text))
    )


def score_sentences(sentences: DataFrame, scorer, columns: list[str] = SCORES, text: str = "text") -> DataFrame:
    """Class scores from a caller's model (see `models.per_worker` with `models.CLASS_SCORES`).

    Hard-filtered rows are not sent to the model, since their scores are never used. Run it once on `text` and,
    for context scores, once on `context_text` with `columns=CONTEXT_SCORES`.
    """
    scored = apply_where(sentences, ~sg.is_hard_filtered(F.col("text")), "_s", scorer(F.col(text)))
    picked = [F.col("_s")[field].alias(name) for field, name in zip(SCORES, columns)]
    return scored.select(*sentences.columns, *picked)


def detect(
    sentences: DataFrame,
    mode: str = "rule",
    scores: DataFrame | None = None,
    features: bool = True,
    context: bool = True,
    include_lets: bool = False,
) -> DataFrame:
    """The detector driver.

    `mode="rule"` is E1 alone. `mode="hybrid"` adds the hard filter (E2), class scores (E11, from `scores` on
    (meeting_id, sentence_id) or from columns already present), feature and context fusion (E12, E13), zones
    (E14), the merge (E15) and request/answer pairs (D9).
    """
    if mode == "rule":
        return detect_by_rules(sentences)
    if mode != "hybrid":
        raise ValueError(f"unknown detection mode {mode!r}")

    df = detect_by_rules(sentences)
    if scores is not None:
        wanted = [c for c in SCORES + CONTEXT_SCORES if c in scores.columns]
        df = df.join(scores.select("meeting_id", "sentence_id", *wanted), ["meeting_id", "sentence_id"], "left")
    kind, base = sg.class_scores(*[F.col(c) for c in SCORES])
    df = (
        df.withColumn("hard_filtered", F.when(sg.is_hard_filtered(F.col("text")), True))
        .withColumn("transformer_decision_type", kind)
        .withColumn("transformer_confidence", base)
    )
    final = F.col("transformer_confidence")
    if features:
        df = with_features(df, include_lets)
        final = sg.fuse_features(
            final, F.col("downward_prior"), F.col("tense_prior"), F.col("modal_boost"), F.col("has_negation")
        )
        if context and all(c in df.columns for c in CONTEXT_SCORES):
            ctx_kind, ctx = sg.class_scores(*[F.col(c) for c in CONTEXT_SCORES])
            df = df.withColumn("context_decision_type", ctx_kind).withColumn("context_confidence", ctx)
            final = sg.fuse_context(F.col("context_confidence"), final, F.col("has_negation"))
    return pair_acceptances(merge(once(df, "_final", final)))


def merge(df: DataFrame) -> DataFrame:
    """Hard-filtered rows keep a fixed low result; the rest join the rule and the model verdicts."""
    bypass = F.coalesce(F.col("hard_filtered"), F.lit(False))
    model_columns = [
        c
        for c in (
            "transformer_decision_type", "transformer_confidence", "modal", "modal_boost", "downward_prior",
            "tense_prior", "has_negation", "context_decision_type", "context_confidence",
        )
        if c in df.columns
    ]
    zone = sg.confidence_zone(F.col("_final"))
    accepted = F.col("transformer_decision_type").isin(lx.KEEP_CLASSES) & zone.isin("high", "review")
    merged = (
        df.withColumn("is_decision", ~bypass & (accepted | F.col("is_decision")))
        .withColumn("confidence", F.when(bypass, lx.HARD_FILTER_CONFIDENCE).otherwise(F.col("_final")))
        .withColumn("confidence_zone", F.when(bypass, "low").otherwise(zone))
        .withColumn("requires_manual_review", ~bypass & (zone == "review"))
        .withColumn("method", F.when(bypass, F.col("method")).otherwise(F.lit("hybrid")))
        .drop("_final", *SCORES, *CONTEXT_SCORES)
    )
    return merged.withColumns({c: F.when(~bypass, F.col(c)) for c in model_columns})
