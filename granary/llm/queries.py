"""The queries opN_<name>: each applies one operator to its whole table. ORACLE_SQL has DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, fingerprints, line_dedup, ngram_join, packing, pii, quality, quotes, sharding, substring_dedup


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sharding.shuffle_into_shards(docs, 8, seed=42)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return got.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = fingerprints.edited_likeness(docs)
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quotes.link(common.table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "n_quoted", "quote_depth", "parent_turn", "linked", "root_turn", "depth", "position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_fingerprints": op5_fingerprints,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_chat_quotes": op10_chat_quotes,
}

ORACLE_SQL = {
    "op3_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE m * 5 >= 4 * (a.n + b.n - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS doc_id, min(y) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.x)::BIGINT AS n_links FROM r GROUP BY x
""",
    "op6_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p WHERE i + 12 <= len(ws)),
f AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s),
bad AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f USING (s) WHERE f.d < g.doc_id),
k AS (
  SELECT p.doc_id, count(b.i) AS gone, string_agg(CASE WHEN b.i IS NULL THEN p.ws[p.i] END, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN bad b ON b.doc_id = p.doc_id AND b.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
""",
    "op8_line_dedup": r"""
WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM w),
g AS (
  SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS s FROM p
  WHERE i + 2 <= len(ls) AND regexp_matches(array_to_string(ls[i:i + 2], ''), '[^\x20\x09-\x0D]')
), n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM n WHERE k > 1),
k AS (
  SELECT p.doc_id, count(b.i) AS gone, string_agg(CASE WHEN b.i IS NULL THEN p.ls[p.i] END, chr(10) ORDER BY p.i) AS kept
  FROM p LEFT JOIN bad b ON b.doc_id = p.doc_id AND b.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(w.ls)::BIGINT AS n_lines, k.gone::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w JOIN k USING (doc_id)
""",
}
