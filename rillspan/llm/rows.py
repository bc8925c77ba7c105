"""Whole rows beside the few columns that an operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc``: a number and all columns of each row, so that no column's name can clash.

    ``docs`` must be a plain scan, whose rows keep their numbers.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))


def columns_of(whole: DataFrame, **columns: str) -> DataFrame:
    """``row`` and the named columns of ``doc``; only these are read."""
    return whole.select("row", *(F.col("doc")[name].alias(alias) for alias, name in columns.items()))


def staying(whole: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose ``row`` is in ``kept``."""
    return whole.join(kept.select("row"), "row", "left_semi").select("doc.*")
