"""Who does what: root verb, subject and object of a sentence.

Two providers give the same columns (`root_verb, subject, object, root_tag, has_dobj, is_passive`):

* `annotate_by_rules`: a column-expression heuristic (verb list, leading pronoun or addressee, words after
  the verb). Needs no model and no shuffle.
* `annotate_from_parse`: joins and aggregations over a dependency-token table produced by any parser, with
  the full rules for root verbs, subjects, ranked objects and resultative constructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.text import any_of, by_alphabet, finds, let, once, regex, strip

RULE_VERBS = sorted(set(lx.VERB_IMPERATIVES) | {"handle", "share", "need", "have", "get", "make", "be", "go", "think"})
VERB_FORMS = r"\b(" + "|".join(RULE_VERBS) + r")(s|ed|d|ing)?\b"
# Words that end the noun phrase after a verb.
PHRASE_ENDS = (
    r"\b(by|before|after|during|until|since|within|in|on|at|for|with|from|to|of|about|and|but|or|so|because"
    r"|when|if|then|that's|tomorrow|today|tonight|next|this\s+week|please|again|first|too|also|which|who"
    r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
)
SUBJECT_WORD = r"\b(i|we|you|he|she|they|it|everyone|someone|team)(?:'(?:ll|m|re|ve|d|s))?\b"
PASSIVE = r"\b(is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b"


# One match splits a sentence into the text before its first verb form, the verb, its ending, and the words
# after it up to punctuation.
CLAUSE = r"^(.*?)" + VERB_FORMS + r"(?:\s+([^,.;:!?]*))?.*$"
MARK = "\x01"


def annotate_by_rules(sentences: DataFrame) -> DataFrame:
    """C3-C6 by rules. The first verb form is the root; the words after it, up to a stop word or punctuation,
    are the object; a pronoun before the verb, else a leading 'Name,', else the speaker is the subject."""
    text = F.col("text")
    cut = by_alphabet(text, lambda spelled: F.regexp_replace(text, spelled(regex(CLAUSE)), f"$1{MARK}$2{MARK}$3{MARK}$4"))
    pieces = F.split(cut, MARK)
    none = F.lit("")
    head, verb = F.get("_c", F.lit(0)), F.lower(F.get("_c", F.lit(1)))
    form = F.lower(F.get("_c", F.lit(2)))
    phrase = strip(F.regexp_replace(F.get("_c", F.lit(3)), regex(r"\s*" + PHRASE_ENDS + r".*$"), ""))
    pronoun = F.when(verb.isNotNull(), F.regexp_extract(head, any_of([SUBJECT_WORD]), 1))
    addressee = F.regexp_extract(text, r"(?U)^(\p{Lu}\w*),", 1)
    staged = sentences.withColumn("_c", pieces).select(
        "*",
        verb.alias("root_verb"),
        F.nullif(phrase, none).alias("object"),
        F.coalesce(F.nullif(pronoun, none), F.nullif(addressee, none)).alias("_subject"),
        F.when(form.isin("ed", "d"), "VBD").when(form == "ing", "VBG").when(form == "s", "VBZ")
        .when(verb.isNotNull(), "VB").alias("root_tag"),
        finds(text, any_of([PASSIVE])).alias("is_passive"),
    )
    return (
        staged.withColumn("has_dobj", F.col("object").isNotNull())
        .withColumn("subject", default_subject(F.col("_subject"), F.col("is_passive"), F.col("speaker")))
        .drop("_c", "_subject")
    )


def default_subject(subject: Column, is_passive: Column, speaker: Column) -> Column:
    """C4: an active sentence without a subject is about its speaker."""
    return F.coalesce(
        subject, F.when(~F.coalesce(is_passive, F.lit(False)) & (speaker != lx.UNKNOWN_SPEAKER), speaker)
    )


def with_annotations(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Attach a caller's annotation table on (meeting_id, sentence_id) and default missing subjects."""
    wanted = ["root_verb", "subject", "object", "root_tag", "has_dobj", "is_passive"]
    joined = sentences.join(annotations.select("meeting_id", "sentence_id", *wanted), ["meeting_id", "sentence_id"], "left")
    return joined.withColumn(
        "subject", default_subject(F.col("subject"), F.col("is_passive"), F.col("speaker"))
    )


# --- dependency-token tables ---------------------------------------------------------------------------
# tokens(meeting_id, sentence_id, i, text, lemma, pos, tag, dep, head, ent_type); `head` is the i of the
# governing token, the root governs itself.

KEY = ["meeting_id", "sentence_id"]


def _first(value: Column, condition: Column) -> Column:
    """First value in token order among the tokens that meet the condition."""
    return F.min_by(value, F.when(condition, F.col("i")))


def _phrases(tokens: DataFrame, modifiers: list[str], reverse: bool = False) -> DataFrame:
    """Each token with its modifier children in front: 'the new API'. One token's children are collected."""
    children = (
        tokens.where(F.col("dep").isin(modifiers) & (F.col("i") != F.col("head")))
        .groupBy(*KEY, F.col("head").alias("i"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "text")), asc=not reverse).alias("_kids"))
        .select(*KEY, "i", F.array_join(F.transform("_kids", lambda k: k["text"]), " ").alias("_front"))
    )
    return tokens.join(children, [*KEY, "i"], "left").withColumn(
        "phrase", F.concat_ws(" ", F.nullif(F.col("_front"), F.lit("")), F.col("text"))
    ).drop("_front")


def sentence_roots(tokens: DataFrame) -> DataFrame:
    """The root token of each sentence."""
    root = F.col("dep") == "ROOT"
    return tokens.groupBy(*KEY).agg(
        _first(F.col("i"), root).alias("root"),
        _first(F.col("lemma"), root).alias("root_lemma"),
        _first(F.col("pos"), root).alias("root_pos"),
        _first(F.col("tag"), root).alias("root_tag"),
    )


def root_verbs(tokens: DataFrame) -> DataFrame:
    """Lemma of the root verb; a light root hands over to its first verbal complement.

    One aggregate: a sentence keeps its root and its few verbal complements, all other tokens are empty rows in it, and
    no sentence is joined to its own tokens again.
    """
    root, inner = F.col("_root"), F.col("_inner")
    verbal = (F.col("pos") == "VERB") & F.col("dep").isin("xcomp", "ccomp", "advcl")
    slim = tokens.where(F.col("meeting_id").isNotNull() & F.col("sentence_id").isNotNull()).select(
        *KEY,
        F.when(F.col("dep") == "ROOT", F.struct("i", "lemma", "pos", "tag")).alias("_root"),
        F.when(verbal, F.struct("i", "head", "lemma")).alias("_inner"),
    )
    gathered = slim.groupBy(*KEY).agg(F.min_by("_root", root["i"]).alias("_root"), F.collect_list("_inner").alias("_inner"))
    complement = F.array_min(F.filter(inner, lambda c: c["head"] == root["i"]))["lemma"]
    verb = F.when(
        root["pos"].isin("VERB", "AUX"),
        F.when(root["lemma"].isin(lx.LIGHT_ROOTS), F.coalesce(complement, root["lemma"])).otherwise(root["lemma"]),
    )
    return gathered.select(*KEY, verb.alias("root_verb"), root["tag"].alias("root_tag"))


def subjects(tokens: DataFrame) -> DataFrame:
    """C4: nsubj, else npadvmod, else the noun before the first comma that follows one, else a proper noun
    before the root; with compounds and adjectives in front."""
    roots = sentence_roots(tokens).select(*KEY, "root")
    commas = tokens.where(F.col("text") == ",").select(*KEY, (F.col("i") - 1).alias("i"), F.lit(True).alias("_comma"))
    marked = tokens.join(commas, [*KEY, "i"], "left").join(roots, KEY, "left")
    named = F.col("pos").isin("NOUN", "PROPN") | F.col("ent_type").isin("PERSON", "ORG")
    picked = (
        marked.groupBy(*KEY)
        .agg(
            F.coalesce(
                _first(F.col("i"), F.col("dep").isin("nsubj", "nsubjpass")),
                _first(F.col("i"), F.col("dep") == "npadvmod"),
                _first(F.col("i"), F.col("_comma") & named),
                _first(F.col("i"), (F.col("pos") == "PROPN") & (F.col("i") < F.col("root"))),
            ).alias("i"),
            F.coalesce(F.bool_or(F.col("dep") == "nsubjpass"), F.lit(False)).alias("is_passive"),
        )
    )
    phrases = _phrases(tokens, ["compound", "amod"], reverse=True).select(*KEY, "i", F.col("phrase").alias("subject"))
    return picked.join(phrases, [*KEY, "i"], "left").select(*KEY, "subject", "is_passive")


def object_candidates(tokens: DataFrame) -> DataFrame:
    """C5 candidates: objects by dependency, without objects of temporal prepositions."""
    heads = tokens.select(*KEY, F.col("i").alias("head"), F.col("lemma").alias("_head_lemma"))
    rank = F.create_map(*[F.lit(x) for pair in lx.OBJECT_PRIORITY.items() for x in pair])
    return (
        _phrases(tokens, ["det", "amod", "compound"])
        .where(F.col("dep").isin(list(lx.OBJECT_PRIORITY)))
        .join(heads, [*KEY, "head"], "left")
        .where(
            ~((F.col("dep") == "pobj") & F.coalesce(F.col("_head_lemma").isin(lx.OBJECT_TEMPORAL_HEADS), F.lit(False)))
        )
        .select(
            *KEY, "i", "head", "dep",
            F.try_element_at(rank, F.col("dep")).alias("priority"),
            (F.col("pos") == "PRON").alias("is_pronoun"),
            F.col("phrase").alias("text"),
        )
    )


def best_objects(candidates: DataFrame) -> DataFrame:
    """Lowest priority, nouns before pronouns, first in the sentence; a plain min per sentence."""
    return candidates.groupBy(*KEY).agg(
        F.min_by("text", F.struct("priority", "is_pronoun", "i")).alias("object")
    )


def resultative_objects(tokens: DataFrame) -> DataFrame:
    """C6 / D7: 'have X ready' -> X, the subject of the root's complement."""
    roots = sentence_roots(tokens).where(F.col("root_lemma").isin(lx.RESULTATIVE_VERBS))
    complements = (
        tokens.join(roots.select(*KEY, "root"), KEY)
        .where((F.col("head") == F.col("root")) & F.col("dep").isin("ccomp", "acomp"))
        .select(*KEY, F.col("i").alias("head"))
    )
    return (
        _phrases(tokens, ["det", "amod", "compound"])
        .where(F.col("dep") == "nsubj")
        .join(complements, [*KEY, "head"])
        .groupBy(*KEY)
        # every later complement overrides the earlier one; inside a complement the first subject counts
        .agg(F.max_by("phrase", F.struct("head", (-F.col("i")).alias("i"))).alias("resultative"))
    )


def direct_objects(tokens: DataFrame) -> DataFrame:
    """The root's own direct object; only without one, that of a coordinated verb. Temporal objects do
    not count. `has_dobj` is the detector's feature and looks at the root alone."""
    roots = sentence_roots(tokens).select(*KEY, "root")
    conj = (
        tokens.join(roots, KEY)
        .where((F.col("dep") == "conj") & (F.col("head") == F.col("root")))
        .select(*KEY, F.col("i").alias("head"), F.lit(True).alias("_conj"))
    )
    objects = tokens.where(F.col("dep").isin("dobj", "obj")).join(roots, KEY).join(conj, [*KEY, "head"], "left")
    own = F.col("head") == F.col("root")
    return (
        objects.groupBy(*KEY)
        .agg(
            _first(F.col("text"), own).alias("primary_object"),
            F.min_by("text", F.when(F.col("_conj"), F.struct("head", "i"))).alias("_second"),
        )
        .select(
            *KEY,
            "primary_object",
            F.when(F.col("primary_object").isNull(), F.col("_second")).alias("secondary_object"),
            F.col("primary_object").isNotNull().alias("has_dobj"),
        )
    )


TOKEN_FIELDS = ("i", "text", "lemma", "pos", "tag", "dep", "head", "ent_type")


def _phrase_of(t: Column, token: Column, modifiers: list[str], reverse: bool = False) -> Column:
    """A token with its modifiers in front, from the sentence's token array."""
    kids = F.filter(t, lambda c: c["dep"].isin(modifiers) & (c["i"] != c["head"]) & (c["head"] == token["i"]))
    front = F.array_join(F.transform(F.reverse(kids) if reverse else kids, lambda k: k["text"]), " ")
    return F.when(token.isNotNull(), F.concat_ws(" ", F.nullif(front, F.lit("")), token["text"]))


def annotate_from_parse(tokens: DataFrame) -> DataFrame:
    """C3-C6 and `has_dobj` together: one annotation row per sentence, ready for `with_annotations`.

    The tokens of a sentence, a bounded group, are gathered once; all rules are array expressions on them, so the
    whole step takes one exchange and no join.
    """
    t, root = F.col("_t"), F.col("_root")
    head = lambda array: F.get(array, F.lit(0))
    first = lambda rule: head(F.filter(t, rule))
    sentences = tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*TOKEN_FIELDS))).alias("_t"))
    sentences = once(sentences, "_root", first(lambda x: x["dep"] == "ROOT"))
    sentences = once(sentences, "_commas", F.transform(F.filter(t, lambda x: x["text"] == ","), lambda x: x["i"] - 1))

    inner = first(lambda x: (x["pos"] == "VERB") & x["dep"].isin("xcomp", "ccomp", "advcl") & (x["head"] == root["i"]))
    light = root["lemma"].isin(lx.LIGHT_ROOTS)
    verb = F.when(root["pos"].isin("VERB", "AUX"), F.when(light, F.coalesce(inner["lemma"], root["lemma"])).otherwise(root["lemma"]))

    named = lambda x: x["pos"].isin("NOUN", "PROPN") | x["ent_type"].isin("PERSON", "ORG")
    subject = F.coalesce(
        first(lambda x: x["dep"].isin("nsubj", "nsubjpass")), first(lambda x: x["dep"] == "npadvmod"),
        first(lambda x: F.array_contains("_commas", x["i"]) & named(x)), first(lambda x: (x["pos"] == "PROPN") & (x["i"] < root["i"])),
    )

    rank = F.create_map(*[F.lit(x) for pair in lx.OBJECT_PRIORITY.items() for x in pair])
    temporal = lambda c: (c["dep"] == "pobj") & F.exists(t, lambda h: (h["i"] == c["head"]) & h["lemma"].isin(lx.OBJECT_TEMPORAL_HEADS))
    objects = F.filter(t, lambda c: c["dep"].isin(list(lx.OBJECT_PRIORITY)) & ~F.coalesce(temporal(c), F.lit(False)))
    best = F.array_min(F.transform(objects, lambda c: F.struct(F.try_element_at(rank, c["dep"]).alias("p"), (c["pos"] == "PRON").alias("pronoun"), c["i"].alias("i"), c.alias("token"))))

    inside = F.transform(F.filter(t, lambda x: (x["head"] == root["i"]) & x["dep"].isin("ccomp", "acomp")), lambda x: x["i"])
    sentences = once(sentences, "_inside", F.when(root["lemma"].isin(lx.RESULTATIVE_VERBS), inside).otherwise(F.array().cast("array<bigint>")))
    results = F.filter(t, lambda x: (x["dep"] == "nsubj") & F.array_contains("_inside", x["head"].cast("bigint")))
    last = F.array_max(F.transform(results, lambda x: F.struct(x["head"].alias("head"), (-x["i"]).alias("i"), x.alias("token"))))

    noun = ["det", "amod", "compound"]
    phrase = lambda token, modifiers, reverse=False: let(token, lambda k: _phrase_of(t, k, modifiers, reverse))
    return sentences.select(
        *KEY, verb.alias("root_verb"), phrase(subject, ["compound", "amod"], True).alias("subject"),
        F.coalesce(phrase(last["token"], noun), phrase(best["token"], noun)).alias("object"), root["tag"].alias("root_tag"),
        F.coalesce(F.exists(t, lambda x: x["dep"].isin("dobj", "obj") & (x["head"] == root["i"])), F.lit(False)).alias("has_dobj"),
        F.coalesce(F.exists(t, lambda x: x["dep"] == "nsubjpass"), F.lit(False)).alias("is_passive"),
    )
