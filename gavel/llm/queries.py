"""Registered queries of this package, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import quality, toxicity
from gavel.llm.alignment import Files, aligned_documents
from gavel.llm.collocations import collocations
from gavel.llm.decontamination import leaks
from gavel.llm.fingerprints import as_text, containment, distinct_shingles, edited_pairs, resemblance
from gavel.llm.html_text import extract_text
from gavel.llm.licenses import scan_licenses
from gavel.llm.mixing import LEVELS, mix, tokens_of
from gavel.llm.pieces import Vocabulary, encode_texts
from gavel.llm.secret_scan import scan_secrets
from gavel.llm.sharding import place
from gavel.llm.simhash_dedup import simhash_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def spans_text(found, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined; they come in the required order."""
    some = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id", *map(count, base), F.sha2(spans_text(F.col("found"), base), 256).alias("base_sha256"),
        spans_text(F.col("found"), (*base, "entropy")).alias("spans"),
    )


@query("op6_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join("blocks", "\n\n").alias("text")
    pages = extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", text)
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query("op9_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


@query("op8_simhash_dedup")
def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


@query("op10_decontamination", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (
  SELECT min(item_id) AS item_id, w, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w
),
ds AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
bs AS (SELECT item_id, n, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(n - 3, 2))) AS p FROM b)),
windows AS (
  SELECT DISTINCT ds.doc_id, bs.item_id, bs.n, ds.p - bs.p + 1 AS a FROM ds JOIN bs USING (s) JOIN d ON d.doc_id = ds.doc_id
  WHERE ds.p - bs.p + 1 >= 1 AND ds.p - bs.p + bs.n <= len(d.w)
),
ws AS (
  SELECT doc_id, item_id, a, s, count(*) AS k
  FROM windows JOIN ds USING (doc_id) WHERE ds.p BETWEEN a AND greatest(a + n - 5, a) GROUP BY ALL
),
bw AS (SELECT item_id, s, count(*) AS k FROM bs GROUP BY ALL),
scored AS (
  SELECT ws.doc_id, ws.item_id, ws.a, sum(least(ws.k, coalesce(bw.k, 0))) AS both_, sum(ws.k) AS own
  FROM ws LEFT JOIN bw ON bw.item_id = ws.item_id AND bw.s = ws.s GROUP BY ALL
),
rated AS (
  SELECT doc_id, item_id, both_::DOUBLE / (own + (SELECT sum(k) FROM bw WHERE bw.item_id = scored.item_id) - both_)::DOUBLE AS similarity FROM scored
)
SELECT doc_id, item_id, max(similarity) AS similarity FROM rated WHERE similarity >= 0.8 GROUP BY ALL
""")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The production mix: weights by domain and language, sources alike, nine tenths of the corpus' tokens, two epochs at most.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 2}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 2, 42


def mix_sql() -> str:
    """The same mix in SQL: shares level by level, then cumulative sums over each leaf's shuffled order."""
    steps, above = [], "SELECT 0 AS root, least(floor(sum(tokens) * 0.9)::BIGINT, sum(tokens) * 2) AS budget FROM leaves"
    steps.append(f"root_ AS ({above})")
    before = "root_"
    for depth, level in enumerate(LEVELS):
        parent = ", ".join(("root", *LEVELS[:depth]))
        weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {"": 1}).items()) + " ELSE 1 END"
        join = " AND ".join(f"c.{x} = p.{x}" for x in ("root", *LEVELS[:depth]))
        columns = ", ".join(f"c.{x}" for x in ("root", *LEVELS[: depth + 1]))
        steps.append(f"""
{level}_c AS (SELECT {parent}, {level}, sum(tokens) * 2 AS cap, {weight} AS w FROM (SELECT 0 AS root, * FROM leaves) GROUP BY ALL),
{level}_o AS (
  SELECT {columns}, c.cap, c.w, p.budget - coalesce(sum(c.cap) OVER (PARTITION BY {columns.rpartition(", ")[0]} ORDER BY c.cap::DOUBLE / c.w, c.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(c.w) OVER (PARTITION BY {columns.rpartition(", ")[0]} ORDER BY c.cap::DOUBLE / c.w, c.{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM {level}_c c JOIN {before} p ON {join}
),
{level}_s AS (
  SELECT *, cap * ws > rest * w AS free, max(CASE WHEN cap * ws > rest * w THEN rest END) OVER (PARTITION BY {parent}) AS r, max(CASE WHEN cap * ws > rest * w THEN ws END) OVER (PARTITION BY {parent}) AS s FROM {level}_o
),
{level}_b AS (SELECT *, CASE WHEN free THEN (r * w) // s ELSE cap END AS b0 FROM {level}_s),
{level}_f AS (
  SELECT {parent}, {level}, (b0 + CASE WHEN free AND row_number() OVER (PARTITION BY {parent}, free ORDER BY {level}) <= r - sum(CASE WHEN free THEN b0 ELSE 0 END) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END) AS budget FROM {level}_b
)""")
        before = f"{level}_f"
    return f"""
WITH docs AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens FROM documents
),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
{", ".join(steps)},
cut AS (
  SELECT l.*, CASE WHEN l.tokens > 0 THEN f.budget // l.tokens ELSE 0 END AS whole, CASE WHEN l.tokens > 0 THEN f.budget % l.tokens ELSE 0 END AS part
  FROM leaves l JOIN source_f f USING (domain, lang, source)
),
placed AS (SELECT d.*, whole, part, md5('42:' || whole || ':' || doc_id) AS k FROM docs d JOIN cut USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM placed),
taken AS (SELECT *, (whole + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END)::BIGINT AS copies FROM summed)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, copies FROM taken WHERE copies > 0
""".replace("\\\\", "\\")


@query("op4_source_mixing", sql=mix_sql())
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", *[F.col(f"_llm_{x}").alias(x) for x in LEVELS], tokens_of(F.col("text")).alias("n_tokens"), F.col("_llm_copies").alias("copies"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; the package that knows is needed by these queries only."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op11_collocations", sql=r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
),
two AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  WHERE NOT EXISTS (FROM f3 t WHERE t.lang = c.lang AND t.w1 = c.w1 AND t.w2 = c.w2 AND 100 * t.f >= 50 * c.f)
    AND NOT EXISTS (FROM f3 t WHERE t.lang = c.lang AND t.w2 = c.w1 AND t.w3 = c.w2 AND 100 * t.f >= 50 * c.f)
),
cuts AS (
  SELECT c.*, x.f AS l1, y.f AS r1, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS s1, u.f AS l2, v.f AS r2, (1000000::HUGEINT * c.f * c.f) // (u.f::HUGEINT * v.f) AS s2
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    JOIN f2 u ON u.lang = c.lang AND u.w1 = c.w1 AND u.w2 = c.w2 JOIN f1 v ON v.lang = c.lang AND v.w1 = c.w3
),
every AS (
  FROM two UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, f, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN n USING (lang) WHERE rank <= 2000
""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), Vocabulary.read(tokenizer_file("piece_bpe_32k.model")))
    return found.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op13_alignment")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Files.read(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return aligned_documents(table(spark, sf_dir, "documents"), files)


@query("op1_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
