"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for null ids."""
    return F.pmod(F.crc32(id_.cast("string")), F.lit(folds))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held: int,
    max_rows: int,
    max_chars: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows with the smallest hash of the id are taken, so the sample does not
    depend on partitioning.  Texts over ``max_chars`` are left out of training
    (never of scoring), which bounds what reaches the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & (fold(F.col("_id"), folds) != held))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .filter(F.length(F.coalesce("_text", F.lit(""))) <= max_chars)
        .select("_id", "_text", "_label")
        .collect()
    )
    rows.sort(key=lambda r: (str(r[0]), r[1] or "", r[2]))
    return [r[1] or "" for r in rows], [r[2] for r in rows]
