"""The thin ``opN_<name>`` queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspan.llm.ann import nearest
from rillspan.llm.exact_dedup import exact_dedup
from rillspan.llm.extraction import main_text
from rillspan.llm.mixing import mix_sources
from rillspan.llm.packing import best_fit_packing
from rillspan.llm.quality import quality_scores
from rillspan.llm.simhash import simhash_groups
from rillspan.llm.substring_dedup import substring_dedup
from rillspan.llm.token_counts import token_counts
from rillspan.llm.toxicity import toxicity_scores


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, closing=1)
    return packed.withColumnRenamed("id", "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)
    return counted.withColumnRenamed("id", "doc_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.col("sha256").alias("text_sha256"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents")).documents()
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return grouped.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.3)
    return scored.withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), query_every=20, k=20)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), carry=("url",)).withColumnRenamed("id", "page_id")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM d)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM again, range(20) r(k)),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS said FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_ann": op8_ann,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op10_substring_dedup": OP10_SQL,
}
