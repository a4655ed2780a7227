"""Small tables with every awkward case."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, equal texts, clashing columns."""
    rows = [
        (1, "one two three four five six seven", "en", "src1", 33), (2, "one two three four five six seven", "en", "src1", 33),
        (2, "one two three four five six seven", "en", "src1", 33), (3, "", "en", "src2", 0), (4, None, None, None, None),
        (None, "no id here at all", "de", "src2", 17), (None, None, None, None, None), (5, "  \n\t ", "fr", "src3", 5),
        (6, LONG, "es", "src4", len(LONG)), (7, "single", "en", "src4", 6), (8, f"before {PASSAGE} after", "en", "src5", 0),
        (9, "Ünïcödé ßtraße 漢字 𝄞 and more", "de", "", 10),
    ]
    return with_clashes(spark.createDataFrame(rows, SCHEMA))


def with_clashes(df):
    """Columns that operators might use themselves."""
    for name in ("score", "predicted", "label", "slot", "shard", "key", "fp", "digest", "tokens", "item", "id", "words", "at"):
        df = df.selectExpr("*", f"'mine' AS {name}")
    return df


def empty(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


def same_rows(a, b):
    """Equal as multisets."""
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    return plain(a) == plain(b)


def shingles(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([tuple(words)] if words else [])


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
