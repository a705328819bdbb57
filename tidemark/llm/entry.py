"""Queries over the driver's tables that apply the operators with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, html_text, langid, lexical, license_scan, mixing, pii, quality, simhash_dedup, token_counts, token_io, topk
from .storage import new_path

#: Setting of the session that holds the key of the surrogates.
PII_KEY = "spark.tidemark.pii.key"
#: Setting of the session that holds the folder of the token counts' cache.
COUNT_CACHE = "spark.tidemark.tokens.cache"
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with Arrow batches of the session bounded in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over links of two bits or fewer.

    Null, empty and blank texts have fingerprint zero and are linked like others; every row is
    returned, repeated rows too; texts of any length are read whole; an empty table gives no rows.
    """
    found = simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pii_key(spark: SparkSession) -> bytes:
    """The session's key; where none is set, a random one that holds for the session and is stored nowhere else."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    return spark.conf.get(PII_KEY).encode()


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_entities."""
    return pii.replace_pii(read_table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: a row for each document and item that match, none for a clean document.

    Null and empty texts, and an empty table on either side, have no rows; see ``decontam.contaminated``.
    """
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; see ``mixing.mix``.

    Null and empty texts have size 0 and are never taken; a null source is one source, the last.
    """
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row.

    A null text, or one without a letter, is ``und`` with score 0; a null doc_id is not held out and
    teaches nothing; repeated rows are judged alike; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    rest = "crc32(cast(doc_id as string)) % 3"
    found = langid.fit_identify(docs, f"{rest} <> 1")
    return found.select("doc_id", F.expr(f"coalesce({rest} = 1, false)").alias("held_out"), "lang_pred", "score", "accepted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels, places and score of every row; see ``license_scan.scan_licenses``."""
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best for every vector whose id is divisible by 20; see ``topk.top_k``."""
    return topk.top_k(topk.quantised(read_table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0", 20)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row; see ``html_text.main_text``."""
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files.

    Null and empty texts are the end id alone; null ids come first; repeated rows follow each other;
    an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    path = new_path(spark, "token_ids")
    token_io.write_tokens(docs, path, tokenizer_path())
    return token_io.with_crc32(token_io.read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``quality.fit_score``. A null doc_id is not held out."""
    rest = "crc32(cast(doc_id as string)) % 5"
    found = quality.fit_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), f"{rest} <> 0")
    return found.select("doc_id", F.expr(f"coalesce({rest} = 0, false)").alias("held_out"), "score", F.expr("cast(score >= 0.3 as int)").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank of every group of documents; see ``divergence.divergence``.

    Null text, lang and source are empty strings; an empty table gives no rows.
    """
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; see ``token_counts.count_tokens``.

    The cache is the folder that the session's setting names; where none is named it is a new one in
    the shared folder, so that a run counts all distinct texts itself.
    """
    place = spark.conf.get(COUNT_CACHE, None) or new_path(spark, "token_counts")
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), place)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best documents for every benchmark item; see ``lexical.search``."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_simhash_near_dedup, op2_pii_surrogates, op3_benchmark_decontamination, op4_mixing_sources, op5_language_id,
        op6_license_scan, op7_exact_top_k, op8_html_extraction, op9_token_output, op10_quality_classifier,
        op11_source_divergence, op12_token_counts, op13_lexical_search,
    ]
    return {f.__name__: f for f in ops}


_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), t AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _op6() -> str:
    """The base phrases on the words of a text, and the containment of each template in each window."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"('{label}', {words.split()!r})" for label, words in license_scan.PHRASES.items())
    templates = ", ".join(f"('{t.label}', {sorted(set(t.words.split()))!r}, {t.telling.split()!r}, {len(t.words.split())})" for t in license_scan.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, {lower} AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
p(label, ws) AS (VALUES {phrases}),
hit AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, label, ws, w, unnest(range(1, len(w) - len(ws) + 2)) AS i FROM w, p
    WHERE contains(t, ws[1]) AND len(w) >= len(ws)) x
  WHERE list_slice(w, i, i + len(ws) - 1) = ws
),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY 1),
tpl(label, ws, tell, size) AS (VALUES {templates}),
able AS (
  SELECT doc_id, w, label, ws, tell, size FROM (SELECT doc_id, w, list_distinct(w) AS b FROM w), tpl
  WHERE len(list_intersect(b, ws)) >= ceil(0.8 * len(ws) - 1e-9) AND list_has_all(b, tell)
),
part AS (SELECT doc_id, label, ws, tell, list_distinct(list_slice(w, i, i + size - 1)) AS b FROM (SELECT *, unnest(range(1, greatest(len(w) - size, 0) + 2)) AS i FROM able)),
got AS (SELECT doc_id, label, max(len(list_intersect(b, ws)) / CAST(len(ws) AS DOUBLE)) AS share FROM part
  WHERE len(list_intersect(b, ws)) >= ceil(0.8 * len(ws) - 1e-9) AND list_has_all(b, tell) GROUP BY 1, 2),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hit UNION SELECT doc_id, label FROM got) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM got GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word,
  CAST(base.b AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best.share, CAST(0 AS DOUBLE)) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN size USING (lang) LEFT JOIN (SELECT lang, source, n FROM c) USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS q FROM kept JOIN size USING (lang)),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(gap.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY 1, 2, 3),
t AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY 1, 2, 3, 4),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i, item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """The rest of the queries cannot be written in SQL; tests hold them against brute force."""
    return {"op6_license_scan": _op6(), "op7_exact_top_k": _OP7, "op11_source_divergence": _OP11, "op13_lexical_search": _OP13}
