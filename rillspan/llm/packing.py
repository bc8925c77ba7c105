"""Bound-certified best-fit packing of token sequences.

Every text becomes token ids plus one closing id; only longer ones are cut into
pieces of ``capacity`` tokens.  Pieces are packed into sequences:

1. Pieces are dealt over partitions of bounded size by a hash of their row.
   Each partition packs its own by best-fit decreasing.
2. Dual-feasible functions give a lower bound on the partition's sequences.  A
   partition that meets its bound is certified; it seals all sequences but the
   emptiest.  A partition with a gap also releases its emptier sequences, more
   of them the larger the gap.
3. Released pieces are exchanged: dealt anew over fewer partitions, which rerun
   best-fit decreasing, until one partition holds them all.

Each round keeps a bounded share of the pieces, so the rounds are logarithmic,
and no partition ever holds more than about ``per_partition`` pieces.

Defined results: null or empty text is one piece holding the closing id;
repeated rows are packed like any others; an empty table gives no pieces; other
columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.work import Work


def pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, closing: int) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every text's pieces."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tail = closing.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillspan.llm.ragged_bpe import encoder

        ids_of = encoder(tokenizer, False)
        for batch in batches:
            keys, text, rows = batch.column("id"), batch.column("text"), []
            groups = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy()) >> 22  # about 4 MB of text at a time
            for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]):
                for n, blob in enumerate(ids_of.encode(text.slice(lo, hi - lo).to_pylist()), lo):
                    ids = memoryview(blob + tail)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((n, k, at // 4, len(part) // 4, zlib.crc32(part)))
            n, *rest = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(n, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest sequences that dual-feasible functions allow for these lengths."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int(count @ size) // capacity)
    # lengths over capacity - e count whole, those under e not at all
    over, total = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    whole = over[capacity - e + 1]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((whole - -middle // capacity).max()))
    # rounding to multiples of 1/k: exact multiples keep their share, others round down over k
    for k in range(1, 33):
        scaled = (k + 1) * size
        share = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(count @ share) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its bin and offset, and per bin its free room; items come longest first."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has room r
    for n, length in enumerate(lengths.tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = capacity, len(free)
            free.append(capacity)
        where[n], offset[n] = bin_, capacity - room
        left = room - length
        free[bin_] = left
        if left:
            by_room[left].append(bin_)
            rooms |= 1 << left
    return where, offset, np.array(free, np.int64)


def _packer(capacity: int, exchange: int, turn: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_uid"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        where, offset, free = best_fit_decreasing(lengths, capacity)
        keep = np.ones(len(free), bool)
        if not last:
            gap = len(free) - lower_bound(lengths, capacity)
            emptiest = np.argsort(-free, kind="stable")[: 1 + exchange * gap]
            keep[emptiest[free[emptiest] > 0]] = False
        pdf["sequence_id"] = (turn << 56) + (int(key[0]) << 28) + where
        pdf["offset"] = offset
        pdf["_sealed"] = keep[where]
        return pdf.drop(columns="_part")

    return run


def pack(
    made: DataFrame,
    work: Work,
    capacity: int,
    per_partition: int = 50_000,
    exchange: int = 8,
) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces; ``made`` must have ``length``.

    ``exchange`` is the number of sequences that a partition releases for each
    sequence above its bound.
    """
    columns = made.columns
    pool, left = made.withColumn("_uid", F.monotonically_increasing_id()), made.count()
    sealed, turn = [], 0
    while True:
        parts = -(-left // per_partition) or 1
        last = parts == 1

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields)
        packed = work.save(
            pool.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(turn)), F.lit(parts)))
            .groupBy("_part")
            .applyInPandas(_packer(capacity, exchange, turn, last), f"{schema}, sequence_id long, offset long, _sealed boolean"),
            f"round{turn}",
        )
        sealed.append(packed.filter("_sealed").select(*columns, "sequence_id", "offset"))
        if last:
            break
        pool = packed.filter("not _sealed").select(*columns, "_uid")
        before, left, turn = left, pool.count(), turn + 1
        if left > before // 2:  # the exchange hardly shrinks the pool: release less
            exchange = max(1, exchange // 2)
        if turn > 40:
            sealed.append(packed.filter("not _sealed").select(*columns, "sequence_id", "offset"))
            break
    out = sealed[0]
    for more in sealed[1:]:
        out = out.unionByName(more)
    return out


def best_fit_packing(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    closing: int = 1,
    per_partition: int = 50_000,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    work = Work(df.sparkSession, "packing")
    made = work.save(pieces(df, tokenizer, id_col, text_col, capacity, closing), "pieces", codec="snappy")
    return pack(made, work, capacity, per_partition)
