"""Small tables with the cases that every operator must settle."""

from __future__ import annotations

import re
import uuid

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


#: Nulls in any column, empty, blank and very long texts, ties, repeated rows, odd characters.
ROWS = [
    (1, "The cat sat", "en", "a", "x"),
    (2, "the CAT sat", "en", "a", "y"),
    (2, "the CAT sat", "en", "a", "y"),
    (3, None, None, None, None),
    (4, "", "en", "b", "x"),
    (5, " \t\n", "de", "b", "x"),
    (None, "no id here", "en", "b", "x"),
    (6, "É Σ ς <|endoftext|>   x", "fr", None, "x"),
    (7, "long words " * 9000, "en", "c", "x"),
    (8, "one", "en", "c", "x"),
    (9, "The cat sat", "en", "a", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def stored(spark, tmp_path, rows=ROWS, schema=SCHEMA, parts=3):
    """A written table, as operators get theirs; ``score`` clashes with names of theirs."""
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)
