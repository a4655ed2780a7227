"""Clusters of decisions inside a meeting, their summaries and tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions import text as tx
from gavel.functions.similarity import cosine, normalized
from gavel.functions.signals import deadline
from gavel.session import cut_lineage



def reach_of(least: float) -> int:
    """Sentences farther apart than this cannot reach the similarity, whatever their cosine is: solve
    1 / (1 + decay * gap) >= least for the gap."""
    return int((1.0 / least - 1.0) / lx.POSITION_DECAY + 1e-9)


def adjusted_similarity(cos: Column, gap: Column, same_action: Column, other_object: Column) -> Column:
    """O1: cosine times position weight times object-mismatch factor; 0 below the cosine gate."""
    weight = F.lit(1.0) / (F.lit(1.0) + F.lit(lx.POSITION_DECAY) * F.abs(gap))
    factor = F.when(F.coalesce(same_action & other_object, F.lit(False)), lx.OBJECT_MISMATCH_FACTOR).otherwise(1.0)
    return F.when(cos < lx.MIN_COSINE, 0.0).otherwise(cos * weight * factor)


def decision_pairs(decisions: DataFrame, least: float = 1.0 - lx.CLUSTER_DISTANCE) -> DataFrame:
    """O1: all pairs of a meeting whose adjusted similarity is at least `least` (positive).

    The similarity bounds the distance of such pairs, so no farther pair is looked at.

    `decisions` is `(meeting_id, sentence_id, vector, action, object)`. Rows meet by an equi-join on
    (meeting, bucket of sentence ids): a row offers itself to its own bucket and the next one, so a meeting of
    any length costs a constant number of comparisons per row.
    """
    reach = reach_of(least)
    width = reach + 1
    bucket = F.floor(F.col("sentence_id") / F.lit(width))
    a = decisions.select(
        "meeting_id", F.explode(F.array(bucket, bucket + 1)).alias("_b"),
        *[F.col(c).alias(f"a_{c}") for c in ("sentence_id", "vector", "action", "object")],
    )
    b = decisions.select(
        "meeting_id", bucket.alias("_b"), *[F.col(c).alias(f"b_{c}") for c in ("sentence_id", "vector", "action", "object")]
    )
    gap = F.col("b_sentence_id") - F.col("a_sentence_id")
    near = a.join(b, ["meeting_id", "_b"]).where((gap > 0) & (gap <= reach))
    cos = near.withColumn("cosine", cosine(F.col("a_vector"), F.col("b_vector")))
    return cos.select(
        "meeting_id", F.col("a_sentence_id").alias("a"), F.col("b_sentence_id").alias("b"), "cosine",
        adjusted_similarity(
            F.col("cosine"), gap, F.col("a_action") == F.col("b_action"), ~F.col("a_object").eqNullSafe(F.col("b_object"))
        ).alias("similarity"),
    ).where(F.col("similarity") >= least).withColumn("distance", 1.0 - F.col("similarity"))


SPAN = 1024  # sentence ids of a stretch that one task clusters
DIGITS = 9  # of mean distances, so that equal ones are equal in whatever order they were summed


def _similarity(pdf: pd.DataFrame) -> np.ndarray:
    """O1 between all rows of a stretch."""
    unit, ids = normalized(np.array(pdf["vector"].tolist(), dtype=float)), pdf["sentence_id"].to_numpy()
    cos = unit @ unit.T
    action, obj = pdf["action"].to_numpy(object), pdf["object"].to_numpy(object)
    known = np.array([a is not None for a in action])
    same = (action[:, None] == action[None, :]) & known[:, None] & known[None, :]
    weight = 1.0 / (1.0 + lx.POSITION_DECAY * np.abs(ids[:, None] - ids[None, :]))
    sim = cos * weight * np.where(same & (obj[:, None] != obj[None, :]), lx.OBJECT_MISMATCH_FACTOR, 1.0)
    sim[cos < lx.MIN_COSINE] = 0.0
    return sim


def merge_nearest(total: np.ndarray, size: np.ndarray, near: np.ndarray, free: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Average linkage by mutually nearest clusters: (the cluster that each one ends in, which have nobody to merge with).

    total: similarities summed over the rows of two clusters; near: whether any two rows of them are near enough to
    merge; free: clusters of which all such neighbours are at hand, which then holds of what they merge into. The mean
    distance of a merged cluster to a third one lies between those of its parts, so what is mutually nearest stays so
    whatever else merges, and may merge at once. Of equal distances the pair with the smaller numbers is nearer.
    """
    n = len(size)
    of, there, size = np.arange(n), np.ones(n, bool), size.astype(float)
    total, near, distance = total.copy(), near.copy(), np.empty_like(total)

    def valid(rows: np.ndarray) -> None:
        distance[rows] = np.round(1.0 - total[rows] / (size[rows, None] * size[None, :]), DIGITS)
        distance[rows] = np.where(near[rows] & there[None, :] & there[rows, None] & (distance[rows] < limit), distance[rows], np.inf)
        distance[rows, rows] = np.inf
        distance[:, rows] = distance[rows].T

    valid(np.arange(n))
    while True:
        nearest = distance.argmin(axis=1)
        open_ = np.isfinite(distance[np.arange(n), nearest]) & there
        ready = free & open_
        i = np.flatnonzero(ready & ready[nearest] & (nearest[nearest] == np.arange(n)) & (np.arange(n) < nearest))
        if not len(i):
            return of, ~open_
        j = nearest[i]
        total[i] += total[j]
        total[:, i] += total[:, j]
        near[i] |= near[j]
        near[:, i] |= near[:, j]
        size[i] += size[j]
        there[j] = False
        to = np.arange(n)
        to[j] = i
        of = to[of]
        valid(np.concatenate([i, j]))


def _cluster_stretch(limit: float, span: int, start: int):
    """One stretch of a meeting: merges what can be judged inside it."""
    reach = reach_of(1.0 - limit)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sentence_id", ignore_index=True)
        low = int(pdf["_stretch"].iloc[0]) * span + start
        first, index = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
        from_, to = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        from_[index], to[index] = pdf["_from"], pdf["_to"]
        sim = _similarity(pdf)
        part = np.zeros((len(first), len(pdf)))
        part[index, np.arange(len(pdf))] = 1
        close = part @ (sim > 1.0 - limit) @ part.T > 0
        whole = (from_ >= low) & (to < low + span)
        open_low, open_high = pdf["_least"].iloc[0] >= low, pdf["_most"].iloc[0] < low + span  # the meeting ends there

        inside = whole & (open_low | (from_ - reach >= low)) & (open_high | (to + reach < low + span))
        free = inside & ~(close & ~whole[None, :]).any(axis=1)
        of, alone = merge_nearest(part @ sim @ part.T, part.sum(axis=1), close, free, limit)
        mine = of[index]
        done = (free & alone)[mine]
        ends = pd.DataFrame({"c": mine, "f": from_[index], "t": to[index]}).groupby("c").agg(f=("f", "min"), t=("t", "max"))
        return pdf.assign(cluster=first[mine], _from=ends["f"].to_numpy()[np.searchsorted(ends.index, mine)], _to=ends["t"].to_numpy()[np.searchsorted(ends.index, mine)], _done=done).drop(columns="_stretch")

    return run


def cluster_decisions(decisions: DataFrame, limit: float = lx.CLUSTER_DISTANCE, span: int = SPAN) -> DataFrame:
    """O2: average-linkage clusters: `(meeting_id, sentence_id, cluster)`, a cluster named by its first sentence.

    The result is that of merging the closest two clusters of the meeting again and again while their mean distance is
    below the limit. It is found by rounds over stretches of `span` sentence ids: in a stretch, mutually nearest
    clusters merge if they and all they might merge with lie inside; where a cluster has nobody left it is done and
    goes. The next round moves the stretches by half. A task holds `span` sentences however long the meeting is; only if
    open clusters can't be judged in either round, because they are as long as a stretch, are stretches doubled.
    Sentences without an id are clusters of their own; the vectors of a meeting are of one length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in decisions.schema}
    rows = decisions.select("meeting_id", "sentence_id", "vector", "action", "object")
    bounds = rows.groupBy(F.col("meeting_id").alias("_meeting")).agg(F.min("sentence_id").alias("_least"), F.max("sentence_id").alias("_most"))
    own = F.col("sentence_id")
    rows = rows.where(own.isNotNull()).join(bounds, F.col("meeting_id").eqNullSafe(F.col("_meeting"))).drop("_meeting").withColumns({"cluster": own, "_from": own.cast("long"), "_to": own.cast("long"), "_done": F.lit(False)})
    open_ = cut_lineage(rows)
    done = decisions.where(F.col("sentence_id").isNull()).select("meeting_id", "sentence_id", F.col("sentence_id").alias("cluster"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema)
    before, moved = None, 0
    while not open_.isEmpty():
        start = moved * span // 2
        stretch = F.floor((own - F.lit(start)) / F.lit(span)).cast("long")
        judged = open_.withColumn("_stretch", stretch).groupBy("meeting_id", "_stretch").applyInPandas(_cluster_stretch(limit, span, start), fields)
        judged = cut_lineage(judged)
        done = done.unionByName(judged.where("_done").select("meeting_id", "sentence_id", "cluster"))
        open_ = judged.where("NOT _done")
        if moved:
            now = open_.agg(F.count("*"), F.count(F.when(F.col("cluster") == own, True))).first()
            span *= 2 if now == before else 1
            before = now
        moved = 1 - moved
    return done.select("meeting_id", F.col("sentence_id").cast(kinds["sentence_id"]).alias("sentence_id"), F.col("cluster").cast(kinds["sentence_id"]).alias("cluster"))


def cluster_arrays(clustered: DataFrame) -> DataFrame:
    """O3: ids, texts and speakers per cluster in sentence order."""
    rows = F.array_sort(F.collect_list(F.struct("sentence_id", "text", "speaker")))
    return clustered.groupBy("meeting_id", "cluster").agg(rows.alias("_r")).select(
        "meeting_id", "cluster",
        F.transform("_r", lambda r: r["sentence_id"]).alias("sentences"),
        F.transform("_r", lambda r: r["text"]).alias("texts"),
        F.transform("_r", lambda r: r["speaker"]).alias("speakers"),
    )


def clean_sentence(text: Column) -> Column:
    """O4."""
    return tx.clean_cluster_sentence(text, lx.CLUSTER_OPENINGS)


def representatives(clustered: DataFrame) -> DataFrame:
    """The longest cleaned sentence of a cluster, one with an action verb first; the earliest of equals."""
    cleaned = clustered.withColumn("summary", clean_sentence(F.col("text")))
    rank = F.struct(
        F.col("summary").rlike(tx.regex(lx.GENERATED_TASK_VERBS)).alias("v"),
        F.length("summary").alias("l"),
        (-F.col("sentence_id")).alias("i"),
    )
    return cleaned.groupBy("meeting_id", "cluster").agg(F.max_by("summary", rank).alias("summary"))


def fallback_assignee(text: Column, speaker: Column) -> Column:
    """A named delegation goes to the addressee; everything else to the speaker; nobody is 'Unknown'."""
    named = F.regexp_extract(text, r"(?U)^(\p{Lu}\w*),\s*(?:can|could)\s+you\b", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(speaker, F.lit("")), F.lit("Unknown"))


def cluster_tasks(clustered: DataFrame) -> DataFrame:
    """One task per cluster: title from the summary, assignee from the first sentence that says who
    (self-assignment or delegation), else the first one, deadline from the summary, else the evidence."""
    says_who = tx.any_of([rf"\b{p}\b" for p in lx.SELF_ASSIGNMENT + lx.DELEGATION])
    evidence = clustered.withColumn("_due", deadline(F.col("text"))).groupBy("meeting_id", "cluster").agg(
        F.min_by(
            fallback_assignee(F.col("text"), F.col("speaker")),
            F.struct((~F.col("text").rlike(says_who)).alias("n"), "sentence_id"),
        ).alias("assignee"),
        F.min_by("_due", F.when(F.col("_due").isNotNull(), F.col("sentence_id"))).alias("_due"),
        F.array_sort(F.collect_list("sentence_id")).alias("evidence_sentences"),
    )
    return representatives(clustered).join(evidence, ["meeting_id", "cluster"]).select(
        "meeting_id", "cluster", F.rtrim("summary", F.lit(".")).alias("title"), "assignee",
        F.coalesce(deadline(F.col("summary")), F.col("_due")).alias("deadline"), "evidence_sentences",
    )


def evidence_rows(tasks: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentence rows behind each task; missing ids are skipped."""
    wanted = tasks.select("meeting_id", "cluster", F.explode("evidence_sentences").alias("sentence_id"))
    return wanted.join(sentences.select("meeting_id", "sentence_id", "speaker", "text"), ["meeting_id", "sentence_id"])
