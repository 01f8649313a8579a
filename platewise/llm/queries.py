"""The registered queries of this subpackage: one per operator, over whole
tables and whole texts, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import quality, toxicity
from platewise.llm.bm25 import search
from platewise.llm.common import table
from platewise.llm.divergence import audit
from platewise.llm.exact_dedup import exact_dedup
from platewise.llm.line_dedup import drop_repeated_lines
from platewise.llm.minhash import near_duplicates
from platewise.llm.mixing import mix
from platewise.llm.pii import find_personal_data
from platewise.llm.sentencepiece_sa import encode_documents
from platewise.llm.sharding import shard_documents
from platewise.llm.warc import archive_pages
from platewise.llm.whitening import whiten


def _held_out(mod: int, remainder: int):
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == remainder).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by compression with two dictionaries."""
    docs = table(spark, sf_dir, "documents")
    judge = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, judge).select("doc_id", _held_out(4, 2), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of documents by the exchange of Golomb-coded fingerprints."""
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes by best-fit decreasing."""
    return shard_documents(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for the whole text of every document
    whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, asked, 10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back through the capture index."""
    return archive_pages(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by suffix-array matching."""
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("row_key")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: patterns, checksums, context."""
    return find_personal_data(table(spark, sf_dir, "documents")).drop("found", "row_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to their sources' target weights by pivotal rounding."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by the bidirectional recurrent network."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, net).select("doc_id", _held_out(5, 0), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by SuperMinHash."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened to 32 components by bidiagonalisation."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language diverge, and their terms."""
    return audit(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them hold."""
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_exact_dedup, op3_sharding, op4_search, op5_warc, op6_sentencepiece, op7_pii, op8_mixing, op9_toxicity,
    op10_minhash, op11_whitening, op12_divergence, op13_line_dedup)}

ORACLE = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept
  FROM n
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op12_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), total AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), cell AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), src AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cell c USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * t.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // (t.n + 2 * t.v))::BIGINT AS q
  FROM src s JOIN kept k USING (lang) JOIN total t USING (lang) LEFT JOIN cell c USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM src a JOIN src b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_line_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS gone FROM k LEFT JOIN r USING (key)) k
GROUP BY k.id, k.doc_id
""",
}
