"""SimHash near-duplicates: fingerprints, bit-sliced links, components.

1. Texts (A-Z lower-cased) give shingles of ``words`` words, repeats included;
   a fingerprint bit is set where over half of the shingles' XXH64 have it.
   Fewer words make one shingle of the whole; none make fingerprint zero.
2. Distinct fingerprints are keyed by every choice of ``bands - radius`` of
   ``bands`` bands.  Within ``radius`` differing bits so many are untouched, so
   any two that link share a key: no link is lost.  The number of bands, and so
   the width of a key, grows with the number of fingerprints, which keeps the
   expected number of those that share a key constant.
3. Fingerprints of one key are compared on bit planes (``bitslice``), which
   emits at most one link per member, a spanning star, not all pairs.
4. Components of the links come from alternating stars (``components``).

Copies with one fingerprint are one node, whatever their number.

Defined results: null text is empty; null ids count as larger than all others;
repeated rows are one group; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.components import stars
from rillspan.llm.rows import columns_of, numbered, staying
from rillspan.llm.work import Work

SEED = 42


def fingerprints(texts: list[str | None], words: int, budget: int = 1 << 16) -> np.ndarray:
    """Unsigned 64-bit fingerprints; counters are filled ``budget`` shingles at a time."""
    from xxhash import xxh64_intdigest

    ones = np.zeros((len(texts), 64), np.int64)
    total = np.ones(len(texts), np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            raw = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held[:-1])])
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        held.clear()
        rows.clear()
        size = 0

    for n, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII only, which is what is asked for
        split = (text or "").encode().lower().split()
        if not split:
            continue
        line = b" ".join(split)
        if len(split) <= words:
            spans = [line]
        else:
            lens = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.cumsum(lens + 1) - 1
            first = (ends - lens)[: len(split) - words + 1].tolist()
            spans = [line[a:b] for a, b in zip(first, ends[words - 1 :].tolist(), strict=True)]
        total[n] = len(spans)
        for lo in range(0, len(spans), budget):
            part = spans[lo : lo + budget]
            held.append(np.fromiter([xxh64_intdigest(s, SEED) for s in part], "<u8", len(part)))
            rows.append(n)
            size += len(part)
            if size >= budget:
                flush()
    flush()
    set_ = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def band_keys(bands: int, radius: int) -> list[tuple[int, int]]:
    """Mask and number of every choice of the bands that a link must leave untouched."""
    edges = [round(64 * n / bands) for n in range(bands + 1)]
    masks = [(1 << edges[n + 1]) - (1 << edges[n]) for n in range(bands)]
    return [(sum(chosen), n) for n, chosen in enumerate(combinations(masks, bands - radius))]


def bands_for(rows: int, radius: int, group: int = 32) -> int:
    """The least number of bands whose keys have so many bits that ``group`` of ``rows`` share one, if bits are even."""
    bands = radius + 2
    while rows > group << 64 * (bands - radius) // bands and bands < 63:
        bands += 1
    return bands


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_table(df: DataFrame, words: int) -> DataFrame:
    """``row, id, fp`` of a table with ``row, id, text``; fp is the signed 64-bit value."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = fingerprints(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(fps.view(np.int64))], ["row", "id", "fp"]
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(scan, f"row long, id {kind}, fp long")


def near_links(distinct: DataFrame, radius: int, bands: int) -> DataFrame:
    """``a, b``: links that span every two fingerprints within the radius."""
    if bands <= radius:
        raise ValueError("some band must stay untouched within the radius")
    keys = [F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(mask))), F.lit(n)) for mask, n in band_keys(bands, radius)]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, size = [], [], 0

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = links(keys, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        from rillspan.llm.bitslice import links

        for batch in batches:
            held_k.append(batch.column("key").to_numpy())
            held_f.append(batch.column("fp").to_numpy().view(np.uint64))
            size += batch.num_rows
            if size < 100_000:
                continue
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            whole = int(np.searchsorted(k, k[-1]))  # the last group may go on
            if whole:
                yield done(k[:whole], f[:whole])
            held_k, held_f, size = [k[whole:]], [f[whole:]], len(k) - whole
        if held_k:
            yield done(np.concatenate(held_k), np.concatenate(held_f))

    return keyed.select("key", "fp").mapInArrow(scan, "a long, b long")


def simhash_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    words: int = 5,
    radius: int = 4,
    bands: int | None = None,
) -> DataFrame:
    """``row, id, fp, fingerprint, component_id, kept``: one row per input row.

    ``component_id`` is the smallest id reachable over links; ``kept`` marks one
    row of each component.
    """
    work = Work(df.sparkSession, "simhash")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    narrow = df.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = work.save(fingerprint_table(narrow, words), "fingerprints")
    # nulls sort last; the row number settles repeated ids
    nodes = work.save(
        docs.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")), "nodes"
    )
    star = stars(near_links(nodes.select("fp"), radius, bands or bands_for(nodes.count(), radius)), work)
    rooted = nodes.join(star, nodes["fp"] == star["a"], "left").select("fp", "best", F.coalesce("b", "fp").alias("root"))
    # minima and results are written before they are joined, so that large groups can be dealt to several tasks
    best = work.save(rooted.groupBy("root").agg(F.min("best").alias("first")), "best")
    found = work.save(rooted.select("fp", "root").join(best, "root").select("fp", "first"), "found")
    return docs.join(found, "fp").select(
        "row",
        "id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every group of near-duplicates, with all its columns, whatever their names; ``docs`` must be a plain scan."""
    whole = numbered(docs)
    found = simhash_groups(columns_of(whole, id=id_col, text=text_col), "id", "text", "row", **options)
    return staying(whole, found.filter("kept"))
