"""Token counts of whole texts by rank-synchronous array merging.

Texts are read in Arrow batches and cut into words by array operations; distinct
words are looked up in a bounded per-worker cache; those not yet seen are merged
together on ragged numpy arrays (``ragged_bpe``), and the symbols that survive
are counted.  No shuffle; memory follows a fixed character budget,
not the batch or the length of a text.

Defined results: null text is empty (0 bytes, 0 tokens); null ids pass through;
special strings inside a text count as one token each; an empty table gives an
empty result; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row; ``tokenizer`` is a file's path."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillspan.llm.ragged_bpe import encoder

        count_of = encoder(tokenizer, True)
        for batch in batches:
            text = batch.column("text")
            tokens = pa.array(count_of.encode(text.to_pylist()), pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), size, tokens, pc.greater(tokens, limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
