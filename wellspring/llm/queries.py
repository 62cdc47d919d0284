"""Registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm import (
    conversations, exact_dedup, jaccard, licenses, mixing, neighbour_packing, packing, quality_model, quality_rules, ranked_search, training_order,
    unit_dedup, warc)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_groups(table(spark, folder, "documents"), rule=jaccard.Rule(3, 90, 100), terms="blocks")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="max")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return unit_dedup.drop_repeats(table(spark, folder, "documents"), run_words=unit_dedup.RUN_WORDS)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op10_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return training_order.training_order(table(spark, folder, "documents"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_neighbour_packing(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_packing.pack_neighbours(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(table(spark, folder, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_quality_rules, op3_quality_classifier, op4_warc, op5_license_scan, op6_exact_dedup, op7_mixing, op8_substring_dedup, op9_packing,
    op10_training_order, op11_ranked_search, op12_neighbour_packing, op13_conversation_repair)}

SQL = {
    "op1_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op6_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op7_mixing": mixing.ORACLE,
    "op11_ranked_search": ranked_search.SQL,
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN best IS NULL OR best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
""",
}
