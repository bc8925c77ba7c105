"""Removal of repeated passages by fixed-block anchors.

A window is ``window`` consecutive words of one document.  A word goes if some
window that covers it has the same words as a window that starts earlier
(smaller id, or same document and earlier start).

1. Anchors: every document's non-overlapping blocks of half a window, at fixed
   places, are the reference index.  Any two equal windows contain an anchor of
   the one at the same place in the other.
2. Probing: every rolling half-window of every document is looked up in that
   index.  Half-windows equal to an anchor elsewhere are hits.
3. Extension: a hit reaches up to half a window to either side, so windows that
   contain one are compared over their whole length, by a 96-bit identity of
   their words; all but the first of equal windows are repeats.  Runs of repeats
   are the maximal exact repeats, given as word spans.  (Two different windows
   of 10^11 have equal identities with a chance of about 10^-7.)

Rows travel between steps as packed arrays, one per batch of documents and hash
bucket, a few bytes a window.  Within a batch equal half-windows or windows are
settled at once and only one of them is sent, so a passage that a third of all
documents share reaches its bucket once per batch.  The number of buckets
follows the input, as does that of the groups of what only passes a step; no
pairs of occurrences are ever formed.

Defined results: null text has no words; documents of fewer than ``window`` words
keep all; null ids come after all others; repeated rows follow each other in
the order in which they are read; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspan.llm.work import Work

MESSAGE = "bucket long, kind int, batch long, row long, id long, n long, payload binary"
HEADER, PROBE, HITS, LOCAL, WINDOWS, REPEATS, DOCUMENT, WHOLE = range(8)
LAST_ID = np.iinfo(np.int64).max


class WordHashes(dict):
    """64-bit hashes of words, filled as they are met and bounded in size."""

    LIMIT = 600_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word, 0)
        if len(word) <= 64 and len(self) < self.LIMIT:
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) >= WordHashes.LIMIT:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(base)
        out += hashes[k : k + n]
    return out


def _message(**columns) -> pa.RecordBatch:
    n = len(columns["payload"])
    kinds = {"bucket": pa.int64(), "kind": pa.int32(), "batch": pa.int64(), "row": pa.int64(), "id": pa.int64(), "n": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()], list(kinds))


def _grouped(batches: Iterator[pa.RecordBatch], max_words: int, max_docs: int, columns: list[str]):
    """Lists of (words, *columns) of about ``max_words`` words."""
    held, size = [], 0
    for batch in batches:
        others = [batch.column(c) for c in columns]
        texts = batch.column("text")
        for n in range(batch.num_rows):
            words = (texts[n].as_py() or "").encode().split()
            held.append((words, *(c[n].as_py() for c in others)))
            size += len(words) + 1
            if size >= max_words or len(held) >= max_docs:
                yield held
                held, size = [], 0
    if held:
        yield held


def _split(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket number and members, where ``order`` sorts by bucket."""
    if len(order):
        b = bucket[order]
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        for part in np.split(order, cuts):
            yield int(bucket[part[0]]), part


def passing(numbers: list[int], buckets: int) -> list[int]:
    """Buckets below zero for what only passes a step, as many as the others, so that their share does not grow."""
    spread = mixed(np.array(numbers, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    return (-1 - spread.astype(np.int64)).tolist()


def probe_messages(batches, half: int, window: int, buckets: int, max_words: int, max_docs: int):
    for group in _grouped(batches, max_words, max_docs, ["row"]):
        group = [g for g in group if len(g[0]) >= window]
        if not group:
            continue
        rows = np.array([g[1] for g in group], np.int64)
        lens = np.array([len(g[0]) for g in group], np.int64)
        starts = np.cumsum(lens) - lens
        hashes = word_hashes([w for g in group for w in g[0]])
        place = np.arange(len(hashes)) - np.repeat(starts, lens)
        at = np.flatnonzero(place <= np.repeat(lens - half, lens))
        h = mixed(rolling(hashes, half, 0x9E3779B97F4A7C15))[at]
        anchor = place[at] % half == 0
        # anchors first among equals, so that the one that is sent is an anchor if any is
        order = np.lexsort((~anchor, h))
        hs = h[order]
        first = np.concatenate(([True], hs[1:] != hs[:-1]))
        more = np.concatenate((~first[1:], [False])) | ~first
        local = np.sort(at[order[more]]).astype("<u4")
        sent = np.sort(order[first])
        batch = int(rows[0])
        head = struct.pack("<II", len(rows), len(local)) + rows.tobytes() + starts.astype("<u4").tobytes() + local.tobytes()
        names, blobs = passing([batch], buckets), [head]
        bucket = (h[sent] >> np.uint64(40)) % np.uint64(buckets)
        for b, part in _split(np.lexsort((sent, ~anchor[sent], bucket)), bucket):
            who = sent[part]
            pos, low = at[who], h[who]
            gap = np.diff(pos, prepend=0)
            n_anchor = int(anchor[who].sum())
            if n_anchor < len(who):
                gap[n_anchor] = pos[n_anchor]
            names.append(b)
            blobs.append(
                struct.pack("<II", len(who), n_anchor)
                + (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                + (low >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8).tobytes()
                + _gaps_to_bytes(gap)
            )
        yield _message(bucket=names, kind=[HEADER] + [PROBE] * (len(blobs) - 1), batch=[batch] * len(blobs), payload=blobs)


def _gaps_to_bytes(gap: np.ndarray) -> bytes:
    """Each gap as its number of 255s, one byte each, and the rest."""
    whole, rest = np.divmod(gap, 255)
    out = np.full(len(gap) + int(whole.sum()), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def _sums_of_gaps(blob: bytes, at: int) -> np.ndarray:
    """Running sums of the gaps in what follows ``at``."""
    steps = np.frombuffer(blob, np.uint8, offset=at)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _read_probe(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n_anchor = struct.unpack_from("<II", blob)
    low = np.frombuffer(blob, "<u4", m, 8).astype(np.uint64)
    high = np.frombuffer(blob, np.uint8, m, 8 + 4 * m).astype(np.uint64)
    pos = _sums_of_gaps(blob, 8 + 5 * m)
    if n_anchor < m and n_anchor:
        pos[n_anchor:] -= pos[n_anchor - 1]
    return low | high << np.uint64(32), pos, np.arange(m) < n_anchor


def find_hits(table: pa.Table) -> pa.RecordBatch:
    """Per batch the sent positions whose half-window is an anchor elsewhere; headers pass."""
    kinds = table.column("kind").to_numpy()
    if kinds[0] == HEADER:
        return table.combine_chunks().to_batches()[0]
    batches = table.column("batch").to_numpy()
    read = [_read_probe(x.as_py()) for x in table.column("payload")]
    h = np.concatenate([r[0] for r in read])
    pos = np.concatenate([r[1] for r in read])
    anchor = np.concatenate([r[2] for r in read])
    source = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
    order = np.argsort(h, kind="stable")
    hs = h[order]
    start = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    size = np.diff(np.append(start, len(hs)))
    good = (size > 1) & (np.add.reduceat(anchor[order], start) > 0)
    hit = order[np.repeat(good, size)]
    names, blobs = [], []
    for k, part in _split(hit[np.argsort(source[hit], kind="stable")], source):
        names.append(int(batches[k]))
        blobs.append(pos[part].astype("<u4").tobytes())
    return _message(bucket=[0] * len(blobs), kind=[HITS] * len(blobs), batch=names, payload=blobs)


def hits_by_row(table: pa.Table) -> pa.RecordBatch:
    """Join a batch's header and hits: positions within each document that has any."""
    found, rows, starts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
        blob = payload.as_py()
        if kind == HITS:
            found.append(np.frombuffer(blob, "<u4"))
        else:
            n, m = struct.unpack_from("<II", blob)
            rows = np.frombuffer(blob, "<i8", n, 8)
            starts = np.frombuffer(blob, "<u4", n, 8 + 8 * n).astype(np.int64)
            found.append(np.frombuffer(blob, "<u4", m, 8 + 12 * n))
    pos = np.sort(np.concatenate(found)).astype(np.int64)
    doc = np.searchsorted(starts, pos, side="right") - 1
    who, blobs = [], []
    for k, part in _split(np.arange(len(pos)), doc):
        who.append(int(rows[k]))
        blobs.append((pos[part] - starts[k]).astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(blobs, pa.binary())], ["row", "hits"])


def sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def window_messages(batches, half: int, window: int, buckets: int, max_words: int, max_docs: int):
    """Whole documents that have no hit; for the rest their text and their candidate windows."""
    for group in _grouped(batches, max_words, max_docs, ["row", "id", "hits"]):
        plain = [g for g in group if not g[3]]
        if plain:
            yield _message(
                bucket=passing([g[1] for g in plain], buckets), kind=[WHOLE] * len(plain), batch=[0] * len(plain),
                row=[g[1] for g in plain], id=[g[2] for g in plain], n=[len(g[0]) for g in plain], payload=[sha(g[0]) for g in plain],
            )
        group = [g for g in group if g[3]]
        if not group:
            continue
        # in the order that decides which window is first
        group.sort(key=lambda g: (g[2] is None, g[2] or 0, g[1]))
        batch = group[0][1]
        keys, seconds, docs, starts = [], [], [], []
        for k, (words, _, _, hits) in enumerate(group):
            hashes = word_hashes(words)
            n = len(words) - window + 1
            mark = np.zeros(len(words) + 1, np.int64)
            mark[np.frombuffer(hits, "<u4") + 1] = 1
            upto = np.cumsum(mark)
            s = np.flatnonzero(upto[window - half + 1 : window - half + 1 + n] > upto[:n])
            a, b = rolling(hashes, half, 0x9E3779B97F4A7C15), rolling(hashes, half, 0xD1342543DE82EF95)
            keys.append(mixed(mixed(a[s]) + a[s + window - half] * np.uint64(3)))
            seconds.append((mixed(mixed(b[s]) + b[s + window - half] * np.uint64(5)) >> np.uint64(32)).astype(np.uint32))
            docs.append(np.full(len(s), k))
            starts.append(s)
        key, second, doc, start = map(np.concatenate, (keys, seconds, docs, starts))
        order = np.lexsort((second, key))  # stable: first of equals comes first
        first = np.ones(len(order), bool)
        first[1:] = (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])
        again, sent = np.sort(order[~first]), np.sort(order[first])
        names = passing([batch], buckets) * (1 + len(group))
        kinds = [LOCAL] + [DOCUMENT] * len(group)
        rows, ids, ns = [batch] + [g[1] for g in group], [None] + [g[2] for g in group], [0, *range(len(group))]
        blobs = [doc[again].astype("<u2").tobytes() + start[again].astype("<u4").tobytes()] + [b" ".join(g[0]) for g in group]
        row_of = np.array([g[1] for g in group], np.int64)
        id_of = np.array([LAST_ID if g[2] is None else g[2] for g in group], np.int64)
        bucket = key[sent] % np.uint64(buckets)
        for b, part in _split(np.argsort(bucket, kind="stable"), bucket):
            who = sent[part]
            used, first_of, count = np.unique(doc[who], return_index=True, return_counts=True)
            gap = np.diff(start[who], prepend=0)  # the windows lie in order of document and start
            gap[first_of] = start[who][first_of]
            blobs.append(
                struct.pack("<II", len(who), len(used))
                + used.astype("<u2").tobytes() + id_of[used].astype("<i8").tobytes() + row_of[used].astype("<i8").tobytes()
                + count.astype("<u4").tobytes()
                + key[who].astype("<u8").tobytes() + second[who].astype("<u4").tobytes()
                + _gaps_to_bytes(gap)
            )
            names.append(b), kinds.append(WINDOWS), rows.append(None), ids.append(None), ns.append(0)
        yield _message(bucket=names, kind=kinds, batch=[batch] * len(blobs), row=rows, id=ids, n=ns, payload=blobs)


def _read_windows(blob: bytes) -> tuple[np.ndarray, ...]:
    m, u = struct.unpack_from("<II", blob)
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    used, ids, rows, count = take("<u2", u), take("<i8", u), take("<i8", u), take("<u4", u).astype(np.int64)
    key, second = take("<u8", m), take("<u4", m)
    upto, first_of = _sums_of_gaps(blob, at), np.cumsum(count) - count
    before = np.where(first_of > 0, upto[first_of - 1], 0)
    start = upto - np.repeat(before, count)
    return key, second, np.repeat(ids, count), np.repeat(rows, count), start, np.repeat(used, count)


def find_repeats(table: pa.Table) -> pa.RecordBatch:
    """Per batch the sent windows that are not the first of their kind; the rest passes."""
    if table.column("bucket")[0].as_py() < 0:
        return table.combine_chunks().to_batches()[0]
    batches = table.column("batch").to_numpy()
    read = [_read_windows(x.as_py()) for x in table.column("payload")]
    key, second, ids, rows, start, doc = (np.concatenate([r[k] for r in read]) for k in range(6))
    source = np.repeat(np.arange(len(read)), [len(r[0]) for r in read])
    order = np.lexsort((start, rows, ids, second, key))
    later = np.zeros(len(order), bool)
    later[1:] = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1])
    hit = order[later]
    names, blobs = [], []
    for k, part in _split(hit[np.argsort(source[hit], kind="stable")], source):
        names.append(int(batches[k]))
        blobs.append(doc[part].astype("<u2").tobytes() + start[part].astype("<u4").tobytes())
    return _message(bucket=[0] * len(blobs), kind=[REPEATS] * len(blobs), batch=names, payload=blobs)


RESULT = "row long, id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>"


def spans_of(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Mask of the words that these windows cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:n]) > 0


def clean_documents(table: pa.Table, window: int) -> pa.RecordBatch:
    """Remove a batch's repeats from its documents."""
    docs, starts, texts = [], [], []
    for kind, row, id_, n, payload in zip(*(table.column(c) for c in ("kind", "row", "id", "n", "payload")), strict=True):
        kind, blob = kind.as_py(), payload.as_py()
        if kind == DOCUMENT:
            texts.append((n.as_py(), row.as_py(), id_.as_py(), blob))
        else:
            m = len(blob) // 6
            docs.append(np.frombuffer(blob, "<u2", m))
            starts.append(np.frombuffer(blob, "<u4", m, 2 * m).astype(np.int64))
    doc, start = np.concatenate(docs), np.concatenate(starts)
    order = np.argsort(doc, kind="stable")
    doc, start = doc[order], start[order]
    out = []
    for n, row, id_, text in texts:
        words = text.split()
        lo, hi = np.searchsorted(doc, [n, n + 1])
        gone = spans_of(start[lo:hi], len(words), window)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
        spans = [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]
        out.append((row, id_, len(words), int(gone.sum()), sha(kept).hex(), spans))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "id", "n_words", "n_removed", "kept_sha256", "spans"])


def substring_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    window: int = 20,
    bucket_bytes: int = 24 << 20,
    max_words: int = 300_000,
    max_docs: int = 4096,
    scanned: bool = True,
) -> DataFrame:
    """``row, id, n_words, n_removed, kept_sha256, spans`` for every row.

    ``spans`` are the removed word ranges, from 0, both ends included.
    ``bucket_bytes`` of text is the share of one hash bucket; ``max_words`` and
    ``max_docs`` bound a batch.  The texts are read twice; ``scanned`` says that
    the table is a plain scan, whose rows keep their numbers.  Otherwise, unless
    ``row_col`` names a column of unique numbers, it is written out first.
    """
    if window % 2:
        raise ValueError("the window must hold two anchors, so its length must be even")
    half = window // 2
    work = Work(df.sparkSession, "substring-dedup")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = df.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not scanned and not row_col:
        docs = work.save(docs, "input")
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(16, -(-int(size) // bucket_bytes))

    probes = docs.select("row", "text").mapInArrow(lambda it: probe_messages(it, half, window, buckets, max_words, max_docs), MESSAGE)
    answered = work.save(
        probes.groupBy("bucket").applyInArrow(lambda table: pa.Table.from_batches([find_hits(table)]), MESSAGE), "hits"
    )
    work.release()
    hits = answered.groupBy("batch").applyInArrow(lambda table: pa.Table.from_batches([hits_by_row(table)]), "row long, hits binary")
    windows = docs.join(hits, "row", "left").mapInArrow(
        lambda it: window_messages(it, half, window, buckets, max_words, max_docs), MESSAGE
    )
    settled = work.save(
        windows.groupBy("bucket").applyInArrow(lambda table: pa.Table.from_batches([find_repeats(table)]), MESSAGE), "repeats"
    )
    work.drop("hits")
    work.release()
    cleaned = settled.filter(F.col("kind") != WHOLE).groupBy("batch").applyInArrow(
        lambda table: pa.Table.from_batches([clean_documents(table, window)]), RESULT
    )
    whole = settled.filter(F.col("kind") == WHOLE).select(
        "row", "id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
        F.lower(F.hex("payload")).alias("kept_sha256"),
        F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans"),
    )
    return cleaned.unionByName(whole)
