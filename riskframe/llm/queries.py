"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm.common import table
from riskframe.llm.decontam import leak_report
from riskframe.llm.langid import language_report
from riskframe.llm.licenses import license_report
from riskframe.llm.mixing import mix_report
from riskframe.llm.neardup import near_duplicate_report
from riskframe.llm.negatives import embedding_negatives
from riskframe.llm.pii import surrogate_report
from riskframe.llm.quality import quality_report
from riskframe.llm.sharding import shard_report
from riskframe.llm.simhash import simhash_components
from riskframe.llm.spelling import spelling_variants
from riskframe.llm.topk import embedding_top_k
from riskframe.llm.toxicity import toxicity_report


def op1_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_top_k(table(spark, sf_dir, "embeddings"))


def op2_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op3_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


def op7_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_report(table(spark, sf_dir, "documents"))


def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op11_segment_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_negatives(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_cover_tree_top_k": op1_cover_tree_top_k,
    "op2_bagminhash_classes": op2_bagminhash_classes,
    "op3_rule_quality": op3_rule_quality,
    "op4_byte_cnn_language": op4_byte_cnn_language,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_nearest_toxicity": op7_nearest_toxicity,
    "op9_bm25_decontamination": op9_bm25_decontamination,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op10_patience_licenses": op10_patience_licenses,
    "op11_segment_simhash": op11_segment_simhash,
    "op12_shared_list_negatives": op12_shared_list_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

OP1 = """
WITH v AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id,
           CAST(list_sum(list_transform(list_zip(q.c, r.c), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
    FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

OP12 = """
WITH v AS (
    SELECT row_number() OVER () AS uid, vec_id,
           CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.uid, a.vec_id AS anchor_id, r.vec_id, r.uid AS other, a.label = r.label AS same,
           CAST(list_sum(list_transform(list_zip(a.c, r.c), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
    FROM v a JOIN v r ON a.uid <> r.uid WHERE a.vec_id % 100 = 0),
pos AS (
    SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS w
    FROM scored WHERE same),
ranked AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.uid, p.w ORDER BY s.score DESC, s.vec_id, s.other) AS n
    FROM pos p JOIN scored s ON s.uid = p.uid AND NOT s.same
    WHERE p.w <= 5 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE n <= 10
"""

SQL: dict[str, str] = {"op1_cover_tree_top_k": OP1, "op12_shared_list_negatives": OP12}
