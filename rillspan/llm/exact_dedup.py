"""Exact deduplication with a heavy-hitter split.

Rows with equal normalised text (A-Z lower-cased, null counts as empty) form a
group; the row with the largest id stays, and of repeated rows with that same
id exactly one stays.

1. One pass over the text gives a narrow table (row, id, SHA-256).
2. Misra-Gries counters (``freqItems``, at most ``1 / support`` of them) name
   the digests that may be frequent.  Their exact counts and winning rows are
   then computed with map-side partial aggregation; the verified ones, at most
   ``1 / support`` rows by construction, are broadcast.
3. Rows of a verified frequent digest get their result map-side, without a
   shuffle.  The other digests' winners come from a partially combined
   aggregation and are joined back by digest; none of those groups holds more
   than a ``support`` share of the rows, and none is ever held in memory.

Everything is a built-in DataFrame operation.

Defined results: null text is the empty text; null ids sort below all others
and are handled like them; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspan.llm.rows import columns_of, numbered, staying
from rillspan.llm.work import Work

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    support: float = 0.001,
) -> DataFrame:
    """One row per input row: ``row, id, keep_id, group_size, kept, sha256``.

    ``row_col`` names a column that identifies rows; without it rows are
    numbered as they are read.  ``support`` is the share of rows from which a
    digest is treated as frequent and bounds the broadcast to ``1 / support``
    rows.
    """
    spark = df.sparkSession
    work = Work(spark, "exact-dedup")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    digests = work.save(
        df.select(
            row.alias("row"),
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)).alias("digest"),
        ),
        "digests",
        codec="snappy",
    )
    winner = F.max(F.struct("id", "row"))
    # the counters compare keys as objects, so they need text, not byte arrays
    candidates = (
        digests.select(F.hex("digest").alias("hex"))
        .stat.freqItems(["hex"], support)
        .select(F.explode("hex_freqItems").alias("hex"))
        .select(F.unhex("hex").alias("digest"))
        .distinct()
    )
    least = max(2, math.ceil(digests.count() * support))
    frequent = work.save(
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(winner.alias("winner"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") >= least),
        "frequent",
    )
    marked = digests.join(F.broadcast(frequent), "digest", "left")
    hot = marked.filter(F.col("group_size").isNotNull())
    rest = digests.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    won = rest.groupBy("digest").agg(winner.alias("winner"), F.count("*").alias("group_size"))
    cold = rest.join(won, "digest").select("digest", "row", "id", "winner", "group_size")
    return hot.select(cold.columns).unionByName(cold).select(
        "row",
        "id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("sha256"),
    )


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; ``docs`` must be a plain scan."""
    whole = numbered(docs)
    found = exact_dedup(columns_of(whole, id=id_col, text=text_col), "id", "text", "row", **options)
    return staying(whole, found.filter("kept"))
