"""Connected components of an edge table by alternating large and small stars.

Each round lets every node hand its larger (then its smaller) neighbours to the
smallest node it knows.  Rounds are joins and map-side combined minima, written
to the shared folder; nothing is gathered on the driver but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.work import Work


def _round(edges: DataFrame, work: Work) -> DataFrame:
    """One large and one small star.

    The minima are written before they are joined: so both sides of each join
    are plain shuffles, and adaptive execution can deal a centre with very many
    neighbours to several tasks.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    large = work.save(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
    least = work.save(large.groupBy("a").agg(F.min("b").alias("m")), "lesser")
    handed = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    turned = handed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return turned.unionByName(least.select("a", F.col("m").alias("b")))


def stars(edges: DataFrame, work: Work, most: int = 60, whole: bool = True) -> DataFrame:
    """``a, b``: every node that has links, except each component's smallest, with that smallest.

    Unless ``whole``, the table after ``most`` - 1 rounds is given as it is: its
    nodes are in one component with their partners, but these may differ in one
    component, and a node may have several.
    """
    now = work.save(edges.select("a", "b").filter("a != b").distinct(), "edges0")
    if now.isEmpty():
        return now
    seen = None
    for turn in range(1, most):
        made = work.save(_round(now, work).distinct(), f"edges{turn}")
        work.drop(f"edges{turn - 1}")
        state = made.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = made
        if state == seen:
            return now
        seen = state
    if not whole:
        return now
    raise RuntimeError(f"components did not settle in {most} rounds")
