"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, langid, lexical, license_scan, line_dedup, media, near_dedup, packing, sharding, topk, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels outside the held-out third."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its class of near-duplicates."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts share a shard."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of highest integer inner product for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices in every document, with the fuzzy ones' spans."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out quarter."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document without the lines that at least 3 documents share."""
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in power-of-two pieces, each a sequence of its own."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back, and its features."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest lexical score for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components of all, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_topk": op4_topk,
    "op5_license": op5_license,
    "op6_langid": op6_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_media": op10_media,
    "op11_lexical": op11_lexical,
    "op12_html": op12_html,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op4_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 5""",
    "op11_lexical": r"""
WITH terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
), counts AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
frequencies AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL
), weighted AS (
  SELECT item_id, term, times * CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN frequencies USING (term), whole
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM weighted JOIN counts USING (term) JOIN sizes USING (row), whole WHERE doc_id IS NOT NULL GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20""",
    "op7_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> top, false) AS lose FROM keyed LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lose) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lose), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
}
