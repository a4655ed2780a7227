"""Column -> Column text functions: regex helpers, cleaning, sentence types, titles.

Everything here is a built-in Spark expression, so it runs inside the JVM next to the scan. The functions
also work on lambda variables, which lets the turn parser apply them to arrays without exploding first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx

# Python's whitespace, as a trim set.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def regex(pattern: str, ignore_case: bool = True) -> str:
    """Java spelling of a pattern whose word, space and boundary classes are Unicode-aware."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def narrow(pattern: str) -> str:
    """The same pattern with ASCII classes and case, which finds the same in an ASCII text and costs a fraction of it."""
    return pattern.replace("(?iU)", "(?i)", 1).replace("(?U)", "", 1)


def by_alphabet(text: Column, form: Callable[[Callable[[str], str]], Column]) -> Column:
    """`form(spelling)` with the narrow spelling of its patterns where `text`, a column or lambda variable, is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), form(narrow)).otherwise(form(lambda pattern: pattern))


def finds(text: Column, pattern: str) -> Column:
    """`rlike` for a column or lambda variable, in the cheapest spelling that gives the same; a null text gives null."""
    return by_alphabet(text, lambda spelled: text.rlike(spelled(pattern)))


def any_of(patterns: Sequence[str], ignore_case: bool = True) -> str:
    """One alternation for a pattern list, to be searched for: a single pass over the text instead of one per pattern.

    Java tries every branch at every place. Branches bound to the start of the text are therefore tried there only, and
    the others only at places that hold a character one of them can begin with.
    """
    bound = [p for p in patterns if re.match(r"\^[^|]*$|\^[^|(]*\((?:[^()]|\([^()]*\))*\)[^|()]*$", p)]
    free = [p for p in patterns if p not in bound]
    parts = ["^(?:" + "|".join(f"(?:{p[1:]})" for p in bound) + ")"] if bound else []
    if free:
        begins = [beginnings(p) for p in free]
        ahead = "" if None in begins else "(?=[" + "".join(sorted(set().union(*begins))) + "])"
        parts.append(ahead + "(?:" + "|".join(f"(?:{p})" for p in free) + ")")
    return regex("|".join(parts), ignore_case)


def beginnings(pattern: str) -> set[str] | None:
    """The characters (or `\\d`) that a match can begin with, as members of a character class; None if that isn't plain
    to see. Reads boundaries, letters, digits, groups of such branches, and single optional letters."""
    pattern = re.sub(r"^(?:\\b|\^)+", "", pattern)
    if pattern.startswith("("):
        depth, cuts = 0, [0]
        for i, c in enumerate(pattern):
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 1:
                cuts.append(i)
            if depth == 0:
                break
        if pattern[i + 1 : i + 2] in ("?", "*", "{") or pattern.startswith("(?"):
            return None
        cuts.append(i)
        found = [beginnings(pattern[a + 1 : b]) for a, b in zip(cuts, cuts[1:])]
        return None if None in found or "|" in re.sub(r"\([^()]*\)", "", pattern[i + 1 :]) else set().union(*found)
    if "|" in re.sub(r"\([^()]*\)", "", pattern) or not re.match(r"(?:[A-Za-z]|\\d)(?![?*{])", pattern):
        return None
    return {"\\d" if pattern[0] == "\\" else pattern[0]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it several times without repeating its expression tree.

    `element_at` knows its type; `get` asks for it in every row, which walks the body's tree down to its innermost `let`.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read.

    A filter on a projected column is pushed below the projection together with the whole expression, which
    then runs once per mention. A one-element generator keeps the value computed once.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def strip(text: Column, chars: str = SPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def is_bare(text: Column) -> Column:
    """True for a text that begins and ends with visible ASCII, so that nothing can be trimmed from it; else false or null."""
    last = F.substring(text.cast("binary"), -1, 1)
    begins = (text >= F.lit("!")) & (text < F.lit("\x7f"))
    return begins & (last >= F.lit(bytearray(b"!"))) & (last < F.lit(bytearray(b"\x7f")))


def strip_value(text: Column) -> Column:
    """`strip` for a column or lambda variable: a trim set costs far more than a look at both ends, so it is searched only
    where there may be something to trim. An expression would be evaluated several times; bind it with `let` first."""
    return F.when(is_bare(text), text).otherwise(strip(text))


def replace(text: Column, pattern: str, by: str = "", ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, regex(pattern, ignore_case), by)


def words(text: Column) -> Column:
    """Whitespace-separated tokens; a blank text has none."""
    return F.filter(F.split(text, regex(r"\s+", False)), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_words(text: Column, n: int) -> Column:
    """At least `n` words, found without cutting the text."""
    return text.rlike(regex(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S", False))


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed. What is one space already is left as it is.

    Printable ASCII without two spaces in a row has spaces to lose at its ends only.
    """
    def full(t: Column) -> Column:
        return strip(replace(t, r"\s(?:\s+|(?<! ))", " ", False))

    return let(text, lambda t: F.when(t.rlike("[^ -~]|  "), full(t)).otherwise(F.trim(t)))


def has_any(lower: Column, parts: Sequence[str]) -> Column:
    """Plain substring tests: many times cheaper than a regex, so they decide first whether one is needed."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(lower, F.lit(part))
    return found


FILLERS = ["um", "uh", "like"]
PHRASES = [p for p, _ in lx.PHRASE_DICTIONARY]


def _fill(t: Column) -> Column:
    return replace(t, lx.FILLER_WORDS_SPOKEN, " ")


def _expand(t: Column) -> Column:
    def fold(t: Column) -> Column:
        for phrase, standard in lx.PHRASE_DICTIONARY:
            t = replace(t, rf"\b{phrase}\b", standard)
        return t

    return F.when(t.rlike(any_of([rf"\b{p}\b" for p in PHRASES])), fold(t)).otherwise(t)


def drop_spoken_fillers(text: Column) -> Column:
    """Um / uh / like (but not 'like doing') become a space."""
    return let(text, lambda t: F.when(let(F.lower(t), lambda low: has_any(low, FILLERS)), _fill(t)).otherwise(t))


def expand_phrases(text: Column) -> Column:
    """Ordered whole-word dictionary replacement; a text without any phrase is left after cheap tests."""
    return let(text, lambda t: F.when(let(F.lower(t), lambda low: has_any(low, PHRASES)), _expand(t)).otherwise(t))


def clean(text: Column) -> Column:
    """The full cleaning chain. A text that holds neither filler nor phrase is done after its spaces."""
    def rest(t: Column) -> Column:
        touched = let(F.lower(t), lambda low: has_any(low, FILLERS + PHRASES))
        return F.when(touched, collapse(expand_phrases(drop_spoken_fillers(t)))).otherwise(t)

    # Printable ASCII without two spaces in a row: one search for whole words, by ASCII rules, says whether anything is to do.
    spoken = narrow(any_of([r"\b(" + "|".join(FILLERS + PHRASES) + r")\b"]))

    def plain(t: Column) -> Column:
        return F.when(t.rlike(spoken), rest(t)).otherwise(t)

    return let(text, lambda t: F.when(t.rlike("[^ -~]|  "), let(collapse(t), rest)).otherwise(let(F.trim(t), plain)))


def is_stop_sentence(text: Column) -> Column:
    """C11."""
    return let(let(text, strip_value), lambda t: finds(t, any_of(lx.STOP_SENTENCES)))


def sentence_type(text: Column) -> Column:
    """Metric, else observation, else consequence, else general."""
    return (
        F.when(finds(text, any_of(lx.METRIC_SENTENCES)), "metric")
        .when(finds(text, any_of(lx.OBSERVATION_SENTENCES)), "observation")
        .when(finds(text, any_of(lx.CONSEQUENCE_SENTENCES)), "consequence")
        .otherwise("general")
    )


def normalize_text(text: Column) -> Column:
    """Collapsed spaces, repeated sentence punctuation reduced to one mark."""
    return replace(collapse(text), r"([.!?])\1+", "$1", False)


def sanitize_task(text: Column) -> Column:
    """C14: normalised, punctuation stripped at both ends, null below three words."""
    return let(
        strip(normalize_text(text), "'\".,;:!?-"),
        lambda t: F.when(word_count(t) >= 3, t),
    )


def extract_names(text: Column) -> Column:
    """Distinct capitalised words of two or more characters, trailing punctuation removed."""
    capital = F.filter(words(text), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}"))
    return F.array_distinct(F.transform(capital, lambda w: F.rtrim(w, F.lit(",:;.!?"))))


def split_sentences(text: Column) -> Column:
    """Split after sentence punctuation, trim, drop empties."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip_value)
    return F.filter(parts, lambda s: s != "")


def capitalize_first(text: Column) -> Column:
    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def capitalize_word(text: Column) -> Column:
    """First character upper, the rest lower."""
    return let(text, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))


def capitalize_calendar(text: Column) -> Column:
    """Day and month names get a capital; texts without one that lacks it cost a single regex."""
    names = lx.DAYS + lx.MONTHS
    right = "|".join(name.capitalize() for name in names)
    present = regex(rf"\b(?!(?:{right})\b)(?i:" + "|".join(names) + r")\b", False)

    def fold(t: Column) -> Column:
        for name in names:
            t = replace(t, rf"\b{name}\b", name.capitalize())
        return t

    return let(text, lambda t: F.when(t.rlike(present), fold(t)).otherwise(t))


def first_sentence(text: Column) -> Column:
    out = strip(text)
    for mark in (". ", "? ", "! "):
        out = strip(F.substring_index(out, mark, 1))
    return out


def end_with_period(text: Column) -> Column:
    return let(text, lambda t: F.when((t == "") | t.endswith("."), t).otherwise(F.concat(t, F.lit("."))))


def rule_based_title(text: Column) -> Column:
    """A task sentence from raw text by rules alone. A sentence without opening and filler is left as it is."""
    def bare(out: Column) -> Column:
        for opening in lx.CONVERSATIONAL_OPENINGS:
            out = strip(replace(out, opening))
        for filler in lx.TITLE_FILLERS:
            out = strip(replace(out, filler))
        return out

    wordy = any_of(lx.CONVERSATIONAL_OPENINGS + lx.TITLE_FILLERS)
    out = let(first_sentence(text), lambda t: F.when(t.rlike(wordy), bare(t)).otherwise(t))
    out = strip(replace(out, r"\s{2,}", " ", False))
    out = strip(F.rtrim(F.rtrim(out, F.lit("?")), F.lit(".")))
    return end_with_period(capitalize_first(capitalize_calendar(out)))


def clean_cluster_sentence(text: Column, openings: Sequence[str]) -> Column:
    """Prefix removal, fillers, default nouns for bare pronouns, capitals, final period."""
    out = strip(text)
    for opening in openings:
        out = strip(replace(out, opening))
    for filler in lx.TITLE_FILLERS:
        out = strip(replace(out, filler))
    for pronoun, noun in lx.SUMMARY_PRONOUNS:
        out = replace(out, rf"\b{pronoun}\b", noun)
    out = strip(replace(out, r"\s{2,}", " ", False))
    out = strip(F.rtrim(F.rtrim(out, F.lit("?")), F.lit(".")))
    return end_with_period(capitalize_first(capitalize_calendar(out)))


def triplet_title(verb: Column, obj: Column) -> Column:
    """G1 + G2: imperative of the verb plus the object; null without a verb."""
    table = F.create_map(*[F.lit(x) for pair in lx.VERB_IMPERATIVES.items() for x in pair])
    lemma = F.lower(verb)
    imperative = F.coalesce(F.try_element_at(table, lemma), capitalize_word(lemma))
    thing = F.coalesce(strip(obj), F.lit(""))
    title = F.when(thing == "", imperative).otherwise(
        F.concat(imperative, F.lit(" "), capitalize_first(thing))
    )
    return F.when(F.coalesce(verb, F.lit("")) != "", end_with_period(title))


def is_valid_title(title: Column, verb: Column | None = None, obj: Column | None = None) -> Column:
    """At least two words, no question, no trailing number, no weak verb without a real object."""
    trimmed = strip(title)
    base = let(
        words(F.rtrim(trimmed, F.lit("."))),
        lambda ws: (F.size(ws) > 1) & ~F.coalesce(F.element_at(ws, -1), F.lit("")).rlike(r"^\p{Nd}+$"),
    )
    ok = F.coalesce(base, F.lit(False)) & ~trimmed.endswith("?")
    if verb is not None:
        weak = F.coalesce(F.lower(verb).isin(lx.WEAK_TITLE_VERBS), F.lit(False))
        thing = F.coalesce(F.lower(obj), F.lit(""))
        ok = ok & ~(weak & ((thing == "") | thing.isin(lx.EMPTY_OBJECTS)))
    return F.coalesce(ok, F.lit(False))


def is_generated_task(text: Column) -> Column:
    """Gate for generated text."""
    return F.coalesce(
        (word_count(text) >= 3)
        & ~text.rlike(any_of(lx.NON_TASK_SENTENCES))
        & text.rlike(any_of([lx.GENERATED_TASK_VERBS])),
        F.lit(False),
    )


def initials(full_name: Column) -> Column:
    """First and last initial, or the first two letters of a single name, or '?'."""
    return let(
        words(F.coalesce(full_name, F.lit(""))),
        lambda ws: F.when(F.size(ws) == 0, F.lit("?"))
        .when(F.size(ws) == 1, F.upper(F.substring(F.get(ws, F.lit(0)), 1, 2)))
        .otherwise(
            F.upper(
                F.concat(
                    F.substring(F.get(ws, F.lit(0)), 1, 1), F.substring(F.try_element_at(ws, F.lit(-1)), 1, 1)
                )
            )
        ),
    )


def slug(name: Column, fallback: Column) -> Column:
    """Lower, spaces to dashes, everything else dropped; empty results use the fallback."""
    dashed = replace(F.regexp_replace(F.lower(name), " ", "-"), r"[^a-z0-9-]", "", False)
    return F.coalesce(F.nullif(dashed, F.lit("")), fallback)
