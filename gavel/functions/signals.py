"""Sentence-level predicates and scores for decision detection, and deadline extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.text import any_of, finds, has_any, has_words, let, regex, strip


def is_actionable(text: Column, min_words: int = lx.MIN_DECISION_WORDS) -> Column:
    """Enough words, no non-action opening, an action verb."""
    return (
        finds(text, any_of([lx.DETECTION_VERBS]))
        & ~finds(text, any_of(lx.NON_ACTION_SENTENCES))
        & has_words(text, min_words)
    )


def is_hard_filtered(text: Column) -> Column:
    """E2."""
    return strip(text).rlike(any_of(lx.HARD_FILTERS))


def modal(text: Column, include_lets: bool = False) -> Column:
    """Longest modal phrase present, or null."""
    found = F.coalesce(*[F.when(text.rlike(regex(rf"\b{m}\b")), F.lit(m)) for m, _ in lx.MODALS])
    if include_lets:
        found = F.coalesce(found, F.when(text.rlike(regex(r"\blet's\b")), F.lit("let's")))
    # One alternation first: most sentences hold no modal and skip the ordered search.
    names = [m for m, _ in lx.MODALS] + (["let's"] if include_lets else [])
    return F.when(text.rlike(any_of([r"\b(" + "|".join(names) + r")\b"])), found)


def modal_strength(found: Column) -> Column:
    """Strength of a modal found by `modal`; 0.5 for one without an entry, null for none."""
    chain = None
    for name, strength in [*lx.MODALS, ("let's", lx.LETS_STRENGTH)]:
        step = found == name
        chain = F.when(step, strength) if chain is None else chain.when(step, strength)
    return chain.when(found.isNotNull(), 0.5)


def modal_boost(found: Column, has_object: Column) -> Column:
    """E4 + E5: strength plus the direct-object bonus, at most 1, 0 without a modal."""
    bonus = F.when(F.coalesce(has_object, F.lit(False)), lx.DIRECT_OBJECT_BONUS).otherwise(0.0)
    # `least` skips nulls, so the missing modal is decided first.
    return F.when(found.isNull(), 0.0).otherwise(F.least(modal_strength(found) + bonus, F.lit(1.0)))


def downward_prior(text: Column, sentence_type: Column, meeting_type: Column) -> Column:
    """Suggestion markers override the type prior; status meetings shrink it."""
    base = F.lit(lx.TYPE_PRIORS["general"])
    for kind in ("metric", "consequence", "observation"):
        base = F.when(sentence_type == kind, lx.TYPE_PRIORS[kind]).otherwise(base)
    factor = F.when(meeting_type == "status_review", lx.STATUS_MEETING_FACTOR).otherwise(1.0)
    return F.when(text.rlike(any_of(lx.SUGGESTION_MARKERS)), lx.SUGGESTION_PRIOR).otherwise(base * factor)


def has_negation(text: Column) -> Column:
    """E7."""
    return text.rlike(any_of(lx.NEGATIONS))


def tense_prior(text: Column, root_tag: Column) -> Column:
    """Past words anywhere, progressive words whole, then the root verb's tag."""
    return (
        F.when(text.rlike(any_of(lx.PAST_WORDS)), lx.PAST_PRIOR)
        .when(text.rlike(any_of([r"\b(" + "|".join(lx.PROGRESSIVE_WORDS) + r")\b"])), lx.PROGRESSIVE_PRIOR)
        .when(root_tag.isin("VBD", "VBN"), lx.PAST_PRIOR)
        .when(root_tag == "VBG", lx.PROGRESSIVE_PRIOR)
        .otherwise(1.0)
    )


def is_request(text: Column) -> Column:
    """E9."""
    return text.contains("?") | text.rlike(any_of(lx.REQUESTS))


def is_acceptance(text: Column) -> Column:
    """E10."""
    return text.rlike(any_of(lx.ACCEPTANCES))


def class_scores(p_decision: Column, p_commitment: Column, p_discussion: Column) -> tuple[Column, Column]:
    """(class, probability) of the best of three scores normalised to sum 1; first wins ties.

    Missing scores mean 'discussion' with probability 0, the outcome of a failed classifier call.
    """
    total = p_decision + p_commitment + p_discussion
    best = F.greatest(p_decision, p_commitment, p_discussion)
    kind = (
        F.when(total.isNull(), "discussion")
        .when(p_decision == best, "decision")
        .when(p_commitment == best, "commitment")
        .otherwise("discussion")
    )
    score = F.when(total.isNull(), 0.0).when(total > 0, best / total).otherwise(best)
    return kind, score


def fuse_features(base: Column, prior: Column, tense: Column, boost: Column, negated: Column) -> Column:
    """E12."""
    fused = F.least(base * prior * tense + boost * lx.MODAL_WEIGHT, F.lit(1.0))
    return F.when(negated, lx.NEGATED_CONFIDENCE).otherwise(fused)


def fuse_context(context: Column, fused: Column, negated: Column) -> Column:
    """E13."""
    mixed = F.least(context * lx.CONTEXT_WEIGHT + fused * lx.FEATURE_WEIGHT, F.lit(1.0))
    return F.when(negated, lx.NEGATED_CONFIDENCE).otherwise(mixed)


def confidence_zone(confidence: Column) -> Column:
    """E14."""
    return (
        F.when(confidence >= lx.ZONE_HIGH, "high").when(confidence >= lx.ZONE_REVIEW, "review").otherwise("low")
    )


def is_valid_deadline(text: Column) -> Column:
    """F4."""
    return F.coalesce(
        (F.length(strip(text)) >= 3)
        & ~text.rlike(any_of(lx.INVALID_DEADLINES))
        & text.rlike(any_of([lx.DEADLINE_ANCHORS])),
        F.lit(False),
    )


# Every valid deadline holds one of these; a text without any of them needs no pattern search.
DEADLINE_HINTS = ["day", "tomorrow", "tonight", "end", "next", "q1", "q2", "q3", "q4", *lx.MONTHS]


def deadline(text: Column, date_entities: Column | None = None) -> Column:
    """F3 + F5: first valid entity when entities are given, else the first valid pattern match.

    Patterns are tried one after the other, each only when the ones before gave nothing valid.
    """
    def attempt(patterns: list[str]) -> Column:
        if not patterns:
            return F.lit(None).cast("string")
        match = strip(F.regexp_extract(text, regex(patterns[0]), 0))
        return let(match, lambda m: F.when(is_valid_deadline(m), m).otherwise(attempt(patterns[1:])))

    by_pattern = F.when(let(F.lower(text), lambda low: has_any(low, DEADLINE_HINTS)), attempt(lx.DEADLINES))
    if date_entities is None:
        return by_pattern
    entities = F.transform(date_entities, lambda e: strip(e))
    return F.coalesce(F.get(F.filter(entities, is_valid_deadline), F.lit(0)), by_pattern)


def task_confidence(assignee: Column, due: Column, detection: Column | None = None) -> Column:
    """H1: weighted sum in a fixed order of additions, clamped to [0, 1]."""
    w = lx.CONFIDENCE_WEIGHTS
    has_assignee = F.coalesce(assignee, F.lit("")) != ""
    has_deadline = F.coalesce(due, F.lit("")) != ""
    detected = F.lit(1.0) if detection is None else F.coalesce(detection, F.lit(1.0))
    total = (
        detected * w["detection"]
        + F.when(has_assignee, 0.75).otherwise(0.5) * w["completeness"]
        + F.when(has_assignee, 1.0).otherwise(0.5) * w["assignment"]
        + F.when(has_deadline, 1.0).otherwise(0.6) * w["deadline"]
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def needs_review(confidence: Column) -> Column:
    """H2."""
    return (confidence >= lx.REVIEW_FROM) & (confidence < lx.REVIEW_BELOW)


def is_valid_task(
    confidence: Column, hard_filtered: Column, text: Column, sentence_type: Column, meeting_type: Column
) -> Column:
    """H3: every rejection rule of the validator, negated."""
    return ~(
        (confidence < lx.MIN_TASK_CONFIDENCE)
        | F.coalesce(hard_filtered, F.lit(False))
        | text.rlike(any_of(lx.INVALID_TASK_TEXTS))
        | ((meeting_type == "status_review") & (confidence < lx.MIN_STATUS_MEETING_CONFIDENCE))
        | (sentence_type.isin(lx.TYPED_SENTENCES) & (confidence < lx.MIN_TYPED_SENTENCE_CONFIDENCE))
    )
