"""Piece encoding, tokenizer alignment and phrase mining against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gavel.llm import alignment, blocks, collocations, pieces
from gavel.llm.queries import QUERIES
from tests.llm.data import awkward, empty, same_rows

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = pieces.Vocabulary.read(PIECES)
ENCODER = pieces.Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return VOCABULARY


@pytest.fixture(scope="module")
def encoder():
    return ENCODER


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_encoding_of_random_texts_is_the_librarys(encoder):
    rng, known = random.Random(3), list(encoder.vocabulary.scores)
    pool = "aabbcdeth  ▁ing\tthe\x00é漢𝄞ﬁ.,<s>0123\n²"
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(known) for _ in range(rng.randrange(40)))
        text = " " * rng.choice((0, 0, 0, 17, 40)) + text
        assert ids(encoder.encode(text)) == encoder.lib.encode(text, add_bos=True, add_eos=True), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_is_encoded_as_the_library_does(text):
    assert ids(ENCODER.encode(text)) == ENCODER.lib.encode(text, add_bos=True, add_eos=True)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "ab" * 60_000, "漢" * 50_000, "=-" * 50_000, "the" * 40_000 + "\n"])
def test_very_long_stretches(encoder, text):
    assert ids(encoder.encode(text)) == encoder.lib.encode(text, add_bos=True, add_eos=True)


def test_backtracking_gives_up_pieces():
    """A vocabulary in which the longest piece first is wrong: abc + d, but c + d merges before ab + c."""
    scores = {"a": -9.0, "b": -9.0, "c": -9.0, "d": -9.0, "cd": -1.0, "ab": -2.0, "abc": -3.0}
    vocabulary = pieces.Vocabulary(open(PIECES, "rb").read(), scores, {}, [], sorted("abcd"), {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in scores), "") for p in scores}, "(?s:.+)")
    encoder = pieces.Encoder(vocabulary)
    rng = random.Random(5)
    for text in ["abcd", "abc", "abcabcd"] + ["".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 30))) for _ in range(500)]:
        assert encoder.backtrack(text) == pieces.merged(text, scores), text


def test_encoding_rows(spark, vocabulary):
    docs = awkward(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted((str(r[0]), bytes(r.ids), r.decoded) for r in pieces.encode_texts(docs, vocabulary).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((str(r.doc_id), np.array(found, "<u4").tobytes(), lib.decode(found)))
    assert got == sorted(want)
    assert pieces.encode_texts(empty(spark), vocabulary).collect() == []
    assert same_rows(pieces.encode_texts(docs.repartition(5), vocabulary), pieces.encode_texts(docs.coalesce(1), vocabulary))


def test_encoding_query(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(found).encode()).hexdigest()))
    got = QUERIES["op12_sentencepiece"](spark, SF)
    assert got.dtypes[:2] == [("doc_id", "bigint"), ("n_tokens", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_packed_integers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2**32 - 1, 0, 7], rng.integers(0, 2**32, 1000), rng.integers(0, 300, 5000)):
        assert blocks.unpack(blocks.pack(np.array(values, np.int64))).tolist() == list(values)


FILES = alignment.Files.read(public_tokenizers.path("byte_bpe_50k.json"), PIECES)


def brute_alignment(rows):
    """The contract, token by token."""
    first = Tokenizer.from_str(FILES.byte_level)
    first.encode_special_tokens = True
    sign, names = alignment.byte_of_sign(), {i: t for t, i in first.get_vocab().items()}
    lib, found, count = ENCODER.lib, [], Counter()
    for key, text in rows:
        raw, spans = (" " + (text or "")).encode(), []
        for ids in (first.encode(" " + (text or ""), add_special_tokens=False).ids, lib.encode(text or "")):
            at, own = 0, []
            for i in ids:
                piece = bytes(sign[c] for c in names[i]) if not spans else (bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode())
                own.append((i, at, at + len(piece), piece))
                at += len(piece)
            spans.append(own)
        if not text or any(b"".join(t[3] for t in own) != raw for own in spans):
            spans = [[], []]
        links = [(a[0], b[0]) for a in spans[0] for b in spans[1] if a[1] < b[2] and b[1] < a[2]]
        cuts = sorted({t[2] for t in spans[0]} & {t[2] for t in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t in own if low < t[2] <= cut) for own in spans))
            low = cut
        count.update(set(links))
        found.append((key, len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted((str(k), a, b, g, len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls), h) for k, a, b, g, ls, h in found)


def test_stretches_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "STRETCHES", 300)
    aligner, rng = alignment.Aligner(FILES), random.Random(6)
    pool = [" ", " ", "  ", "\n", "\t", "\x1f", "\x85", "\u00a0", "\u2003", "\u200b", "\u3000", "word", "don't", "'s", "12", "é", "漢", "<|endoftext|>", "!", ".,", ";", "𝄞", "x" * 70]
    texts = [" " + "".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(3000)]
    for a in range(0, len(texts), 100):
        want = [e.ids for e in aligner.first.encode_batch(texts[a : a + 100], add_special_tokens=False)]
        assert [x.tolist() for x in aligner.first_ids(texts[a : a + 100])] == want


def as_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 24])
def test_alignment_by_brute_force(spark, block_bytes):
    rng = random.Random(2)
    pool = ["the", " ", "  ", "\n", "naïve", "漢字", "𝄞", "<s>", "<|endoftext|>", "word", "Ordnung", "123", "▁", ".", "'s", "\x00", "ﬁ", "é"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(i, texts[i % 50]) for i in range(70)] + [(None, None), (None, ""), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(alignment.aligned_documents(docs, FILES, block_bytes=block_bytes, hot=2)) == brute_alignment(rows)


def test_alignment_rows(spark):
    docs = awkward(spark).where("doc_id IS NULL OR doc_id <> 6")
    assert as_rows(alignment.aligned_documents(docs, FILES)) == brute_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert alignment.aligned_documents(awkward(spark), FILES).where("doc_id = 6").first().n_a > 100_000
    assert alignment.aligned_documents(empty(spark), FILES).collect() == []


def test_copies_count_as_documents(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(40)] + [(99, "same other")], "doc_id long, text string")
    got = alignment.aligned_documents(docs, FILES, hot=7)
    assert got.count() == 41 and got.agg(F.max("count_sum")).first()[0] == 41 + 40


def test_alignment_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r[1] or "") < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(alignment.aligned_documents(docs, FILES)) == brute_alignment(rows)
    got = QUERIES["op13_alignment"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), *[(n, "bigint") for n in alignment.MEASURES], ("groups_sha256", "string")]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def brute_phrases(rows, least, share, top):
    """The contract with dictionaries."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes,tile,least,top", [(1, 1, 2, 5), (300, 2, 3, 1000), (1 << 24, 4, 10, 40), (1 << 24, 1024, 2, 1000)])
def test_phrases_by_brute_force(spark, block_bytes, tile, least, top):
    rng = random.Random(block_bytes)
    pool = ["a", "b", "c", "New", "new", "york", "city", "é", "漢", "x\x00y", "\u00a0", "the"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    rows = [(rng.choice(["en", "en", "de", "", None]), "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " \t\n..")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least=least, top=top, block_bytes=block_bytes, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, 50, top)


def test_phrases_that_overlap_themselves(spark):
    docs = spark.createDataFrame([("en", "a a a a a a a a a a a a")], "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_phrases([("en", "a " * 12)], 10, 50, 2000)


def test_tile_counts_by_direct_address_and_by_coordinates():
    rng = np.random.default_rng(4)
    for high, tile, full in ((5, 4, 1), (300, 16, 8), (300, 16, 10**9), (300, 16, 1)):
        first, second = rng.integers(0, high, 4000), rng.integers(0, high, 4000)
        codes, n = collocations.tile_counts(first, second, tile, full)
        want = np.unique(first << 32 | second, return_counts=True)
        assert codes.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()
    assert [len(x) for x in collocations.tile_counts(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_phrase_rows(spark):
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    for least in (1, 2, 10):
        got = sorted(map(tuple, collocations.collocations(docs.where("doc_id IS NULL OR doc_id <> 6"), least=least).collect()))
        assert got == brute_phrases([r for r in rows if len(r[1] or "") < 10_000], least, 50, 2000)
    long = collocations.collocations(docs.where("doc_id = 6"), least=4)  # two words in turn, each pair 4 or 5 times
    assert long.count() == 2000 and long.where("n <> 120000 OR a NOT IN (4, 5) OR l < a OR r < a").isEmpty()
    assert collocations.collocations(empty(spark)).collect() == []
    every = collocations.collocations(docs, least=2, top=None)
    assert every.count() == collocations.collocations(docs, least=2, top=10**6).count() and every.where("rank IS NOT NULL").isEmpty()
