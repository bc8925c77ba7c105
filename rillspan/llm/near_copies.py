"""SimHash near-dedup at a similarity of shingle sets: wide radius, exact check.

Sets at a Jaccard similarity of 0.8 differ in about ten of 64 bits and now and
then in twenty, too many for keys made of untouched bands (``simhash``).  So:

1. A text's set holds the XXH64 (seed 42) of its shingles, as ``simhash`` cuts
   them; its fingerprint has the bits that over half of the set have.  Texts
   with equal sets are one node.
2. Blocks come from a prefix filter: in any one order of all shingles, two sets
   of a similarity of ``num / den`` or more share one of their first
   ``n - ceil(n num / den) + 1``.  Shingles that are common in a sample of the
   texts come last in the order; the sample decides only how large blocks are.
3. Fingerprints of a block are compared on bit planes (``bitslice``) within
   ``radius`` bits.  First each key's members with one of them, another for each
   key; then those still in different components with each other, so large
   groups of copies do not cost all their pairs.  Of these, pairs go whose
   bitmaps of 1024 bits differ in more bits than sets of that similarity can.
4. What is within the radius is verified on the whole sets.
5. Components of the links come from alternating stars (``components``).

A pair links if it is within ``radius`` and reaches the similarity.  At 24 bits
that loses a pair of similarity 0.8 about once in 10^6.

Defined results: null text is empty, and texts without words are one group; null
ids count as larger than all others; repeated rows are one group; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspan.llm.bitslice import near_pairs
from rillspan.llm.components import stars
from rillspan.llm.rows import columns_of, numbered, staying
from rillspan.llm.simhash import SEED
from rillspan.llm.work import Work


def fingerprint(s: np.ndarray, budget: int = 1 << 16) -> int:
    """SimHash of a set: the bits that over half of its members have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), budget):
        part = np.ascontiguousarray(s[at : at + budget], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<u8")[0])


def bitmap(s: np.ndarray, size: int = 1024) -> bytes:
    """The bits that some member of a set hashes to."""
    bits = np.zeros(size, np.uint8)
    bits[(s >> np.uint64(17)) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; fewer words make one shingle of the whole."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    spans = [b" ".join(split[k : k + words]) for k in range(max(1, len(split) - words + 1))]
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in spans), np.uint64, len(spans)))


def common_shingles(docs: DataFrame, words: int, every: int = 10, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several texts of a sample share, and their counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["key"])

    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(scan, "key long")
    counted = drawn.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = counted.orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


def prefix_table(docs: DataFrame, words: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``row, id, node, n, fp, bits, prefix``: equal sets have equal nodes, fingerprints, bitmaps and prefixes."""
    from xxhash import xxh64_intdigest

    keys, counts = common

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                nodes, sizes, prefixes, fps, bitmaps = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, words)
                    often = np.zeros(len(s), np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        often = np.where(keys[at] == s, counts[at], 0)
                    first = len(s) + (-len(s) * num) // den + 1 if len(s) else 0
                    nodes.append(xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    fps.append(fingerprint(s))
                    bitmaps.append(bitmap(s))
                    prefixes.append(s[np.lexsort((s, often))[:first]].view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("id"), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bitmaps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    ["row", "id", "node", "n", "fp", "bits", "prefix"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"row long, id {kind}, node long, n int, fp long, bits binary, prefix array<long>")


def _possible(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets may reach the similarity if this key is the first they share."""
    fits = den * np.minimum(n[x], n[y]).astype(np.int64) >= num * np.maximum(n[x], n[y]).astype(np.int64)
    return fits & ((num + den) * np.minimum(n[x] - pos[x], n[y] - pos[y]).astype(np.int64) >= num * (n[x] + n[y]).astype(np.int64))


def one_for_each(key, node, n, pos, fp, root, bits, num: int, den: int, radius: int):
    """Pairs of each key's members with one of them, which differs from key to key."""
    mixed = (node ^ key).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed, key))
    for x, y in near_pairs(key[order], fp[order].view(np.uint64), radius, heads=True):
        x, y = order[x], order[y]
        stay = _possible(n, pos, x, y, num, den)
        yield x[stay], y[stay]


def all_apart(key, node, n, pos, fp, root, bits, num: int, den: int, radius: int):
    """Pairs of a key's members in different components whose bitmaps allow the similarity."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    apart = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes)
    order = np.flatnonzero(apart)
    for x, y in near_pairs(key[order], fp[order].view(np.uint64), radius):
        x, y = order[x], order[y]
        stay = np.flatnonzero((root[x] != root[y]) & _possible(n, pos, x, y, num, den))
        x, y = x[stay], y[stay]
        # every differing bit stands for a shingle that the two do not share
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        stay = (num + den) * apart <= (den - num) * (n[x].astype(np.int64) + n[y])
        yield x[stay], y[stay]


def candidates(postings: DataFrame, pick, num: int, den: int, radius: int) -> DataFrame:
    """``a, b``: distinct pairs of nodes that ``pick`` takes of each key; postings have ``key, node, n, pos, fp, root, bits``."""
    names = ["key", "node", "n", "pos", "fp", "root", "bits"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node = columns[1]
            for x, y in pick(*columns, num, den, radius):
                if len(x):
                    a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            held.append([*(batch.column(c).to_numpy() for c in names[:-1]), bits])
            size += batch.num_rows
            if size < 100_000:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            if cut:
                yield from done([c[:cut] for c in whole])
            held, size = [[c[cut:] for c in whole]], size - cut
        if size:
            yield from done([np.concatenate(c) for c in zip(*held, strict=True)])

    laid = postings.select(*names).repartition("key").sortWithinPartitions("key", "n", "node")
    return laid.mapInArrow(scan, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets reach the similarity; ``texts`` has ``node, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, words).view(np.int64) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("node"), held], ["node", "said"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = texts.join(asked, "node", "left_semi").select("node", "text").mapInArrow(scan, "node long, said array<long>")
    left, right = (sets.select(F.col("node").alias(c), F.col("said").alias(f"_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    enough = (num + den) * shared >= num * (F.size("_a") + F.size("_b"))
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row", words: int = 5, num: int = 4, den: int = 5, radius: int = 24) -> DataFrame:
    """``row, id, component_id, kept``: groups linked by similarities of ``num / den`` or more.

    ``component_id`` is the smallest id of the group; ``kept`` marks one row of each.
    """
    work = Work(docs.sparkSession, "near")
    narrow = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = work.save(prefix_table(narrow, words, num, den, common_shingles(narrow, words)), "prefixes")
    # nulls sort last; the row number settles repeated ids
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    nodes = work.save(found.groupBy("node").agg(best), "nodes")
    chosen = nodes.select(F.col("best.row").alias("row"))
    each = found.join(chosen, "row", "left_semi").select("node", "n", "fp", F.posexplode("prefix").alias("pos", "key"))
    # most keys have one member, which meets nobody
    members = F.count("*").over(Window.partitionBy("key"))
    shared = work.save(each.withColumn("members", members).filter("members > 1").drop("members"), "shared")
    bits = nodes.select("node", F.col("best.row").alias("row")).join(found.select("row", "bits"), "row").select("node", "bits")
    texts = narrow.join(nodes.select(F.col("best.row").alias("row"), "node"), "row").select("node", "text")

    work.release()
    tried = work.save(candidates(shared.select("*", F.col("node").alias("root"), F.lit(b"\0" * 8).alias("bits")), one_for_each, num, den, radius), "tried")
    links = work.save(verified(tried, texts, words, num, den), "links")
    work.release()
    star = stars(links, Work(docs.sparkSession, "near"))
    near = star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    told = bits.join(near, "node", "left").select("node", "bits", F.coalesce("root", "node").alias("root"))
    rooted = shared.join(told, "node")
    rest = candidates(rooted, all_apart, num, den, radius).join(tried, ["a", "b"], "left_anti")
    more = verified(work.save(rest, "rest"), texts, words, num, den)
    work.release()
    star = stars(star.select("a", "b").unionByName(more), work)

    # as in simhash_groups
    grouped = nodes.join(star, nodes["node"] == star["a"], "left").select("node", "best", F.coalesce("b", "node").alias("root"))
    first = work.save(grouped.groupBy("root").agg(F.min("best").alias("first")), "first")
    settled = work.save(grouped.select("node", "root").join(first, "root").select("node", "first"), "settled")
    return found.select("row", "id", "node").join(settled, "node").select(
        "row", "id", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every group of near copies, with all its columns, whatever their names; ``docs`` must be a plain scan."""
    whole = numbered(docs)
    found = near_copies(columns_of(whole, id=id_col, text=text_col), "id", "text", "row", **options)
    return staying(whole, found.filter("kept"))
