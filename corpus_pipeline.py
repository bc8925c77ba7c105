"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
left, and its decisions take effect.  Its result is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillspan.llm.exact_dedup import unique_documents
from rillspan.llm.mixing import mixed_documents
from rillspan.llm.near_copies import without_near_copies
from rillspan.llm.packing import best_fit_packing
from rillspan.llm.quality import good_documents
from rillspan.llm.queries import table, vocabulary
from rillspan.llm.work import Work


# In all stages null text counts as empty, repeated rows and ties are settled as stated, an empty table gives
# an empty one, and columns of any further name pass through.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; equal texts fare alike, empty ones are scored like others."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, null the smallest, and of rows that repeat that id one."""
    return unique_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id, null the largest.

    Documents link if their SimHash fingerprints over shingles of five words are
    within 24 bits, compared on bit planes, and their shingles' Jaccard
    similarity, checked exactly, is 0.8 or more.  Texts without words are one group.
    """
    return without_near_copies(docs, words=5, num=4, den=5, radius=24)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null one of them, are drawn to their target weights; texts without words are never drawn."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096; one row per piece of a document, at least one each."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: Trained scores, fingerprints and packing have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        made = work.save(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            work.drop(f"stage{n - 1}")
        docs = made
    return docs
