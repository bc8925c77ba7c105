"""Approximate nearest neighbours by inner product on balanced posting lists.

1. Centroids come from balanced k-means on a bounded sample (``sample_rows``).
   Vectors get one more coordinate that lifts them all to the largest norm, so
   the largest inner product is the smallest distance.
2. A neighbour graph over the centroids, in memory on every worker, finds the
   lists of a vector by best-first search.
3. Every vector is indexed in its nearest list and, near a boundary, in further
   lists (at most ``replicas``) that lie in other directions.
4. A query reads the lists whose distance is within a ratio of its nearest
   list's, at most ``width`` of them, but enough to hold twice as many vectors
   as it asks for.  Ratio and width are calibrated on the sample against brute
   force so that about ``recall`` of the true neighbours lie in lists that are
   read; both are as small as the vectors are clustered.
5. Neighbouring lists of together ``group_rows`` vectors are one unit of work; a
   list that is longer is cut into several.  A query goes once to each unit with
   the lists it reads there; units that very many queries read take them in
   batches.  Each unit keeps a query's best; these are merged.

Scores are computed anew in double precision on the original vectors.

Bounds: the centroids, at most ``max_lists`` and one for 16 sampled vectors, are
fitted on ``sample_rows`` vectors.  Every vector is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; shorter vectors are continued by zeros; rows with null
ids take no part; rows that repeat an id and its vector are one candidate; of an
id's several vectors the least asks and the best counts; with fewer candidates
than asked for all are returned; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspan.llm.work import Work


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that makes them equally long, and none of the centroids' weight."""
    return np.hstack([x, np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))[:, None], np.zeros((len(x), 1))])


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 14, settle: int = 6, seed: int = 11) -> np.ndarray:
    """Centroids, with one more coordinate that makes those of large clusters more distant, so that sizes even out.

    The squared distance to a centroid grows by a weight, which is the square of
    that coordinate; it follows the cluster's size over all rounds, and in the
    last ones nothing else moves.
    """
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)]
    weight = np.zeros(k)
    scale = float(squared(x[:512], centre).std()) + 1e-12
    for turn in range(rounds + settle):
        near = np.concatenate([(squared(x[at : at + 4096], centre) + weight).argmin(1) for at in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        step = 0.2 * scale if turn < rounds else 0.1 * scale
        weight += step * np.clip(np.log((size + 0.5) * k / len(x)), -1, 1)
        if turn < rounds:
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return np.hstack([centre, np.sqrt(weight - weight.min())[:, None]])


class Graph:
    """Centroids with a neighbour graph and best-first search over it."""

    def __init__(self, centre: np.ndarray, degree: int = 16):
        self.centre = centre
        k = len(centre)
        degree = min(degree, k - 1)
        self.links = np.zeros((k, max(degree, 1)), np.int64)
        for at in range(0, k, 1024):
            d = squared(centre[at : at + 1024], centre)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            if degree:
                self.links[at : at + len(d)] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        # a ring keeps the graph connected
        self.links = np.hstack([self.links, np.roll(np.arange(k), -1)[:, None]])
        # searches start at the best of a spread of centroids, so that no cluster is out of reach
        self.entry = np.unique(np.linspace(0, k - 1, min(k, 64 + 4 * int(k**0.5))).astype(np.int64))

    def search(self, x: np.ndarray, width: int, beam: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """About the ``width`` nearest centroids of every row, nearest first, and squared distances.

        A search so wide that it would meet about all centroids looks at each once.
        """
        n, k = len(x), len(self.centre)
        width = min(width, k)
        if width * self.links.shape[1] >= k:
            dist = squared(x, self.centre)
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            return order, np.take_along_axis(dist, order, 1)
        held = min(k, max(width, beam))
        seen = np.zeros((n, k), bool)
        seen[:, self.entry] = True
        ids, dist = np.tile(self.entry, (n, 1)), squared(x, self.centre[self.entry])
        every = np.arange(n)
        if ids.shape[1] > held:
            keep = np.argpartition(dist, held - 1, axis=1)[:, :held]
            ids, dist = ids[every[:, None], keep], dist[every[:, None], keep]
        else:
            more = held - ids.shape[1]
            ids, dist = np.hstack([ids, np.zeros((n, more), np.int64)]), np.hstack([dist, np.full((n, more), np.inf)])
        done = np.zeros(ids.shape, bool)
        norm = (x * x).sum(1), (self.centre * self.centre).sum(1)
        while True:
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(1)
            # a row ends when nothing among its nearest is left to expand
            rows = np.flatnonzero(np.isfinite(open_[every, best]))
            if not len(rows):
                break
            at = best[rows]
            done[rows, at] = True
            next_ = self.links[ids[rows, at]]
            fresh = ~seen[rows[:, None], next_]
            seen[rows[:, None], next_] = True
            near = norm[0][rows, None] - 2 * np.einsum("ijk,ik->ij", self.centre[next_], x[rows]) + norm[1][next_]
            d = np.where(fresh, np.maximum(near, 0), np.inf)
            all_d, all_i = np.hstack([dist[rows], d]), np.hstack([ids[rows], next_])
            all_done = np.hstack([done[rows], np.zeros(d.shape, bool)])
            keep = np.argpartition(all_d, held - 1, axis=1)[:, :held]
            take = np.arange(len(rows))[:, None]
            dist[rows], ids[rows], done[rows] = all_d[take, keep], all_i[take, keep], all_done[take, keep]
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return ids[every[:, None], order], dist[every[:, None], order]


class ListIndex:
    """What workers need to place vectors and to choose a query's lists."""

    def __init__(self, x: np.ndarray, most: float, lists: int, replicas: int, closure: float, k: int, recall: float):
        self.most, self.replicas, self.closure = most, replicas, closure
        y = lift(x, most)
        self.graph = Graph(balanced_kmeans(y[:, :-1], min(lists, len(y))))
        self.ratio = 1.0
        self.size = np.zeros(0, np.int64)
        self.width = len(self.graph.centre)
        self._calibrate(x, y, k, recall)

    def places(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of every lifted vector, nearest first, and which of them it is indexed in."""
        centre = self.graph.centre
        ids, dist = self.graph.search(y, 4 * self.replicas)
        ids, dist = ids[:, : 2 * self.replicas], np.sqrt(dist[:, : 2 * self.replicas])
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for c in range(1, ids.shape[1]):
            near = dist[:, c] <= self.closure * dist[:, 0] + 1e-12
            for b in range(c):  # skip a list that lies closer to one already taken than to the vector
                gap = np.sqrt(((centre[ids[:, c]] - centre[ids[:, b]]) ** 2).sum(1))
                near &= ~taken[:, b] | (gap > dist[:, c])
            taken[:, c] = near & (taken.sum(1) < self.replicas)
        return ids, taken

    def _calibrate(self, x: np.ndarray, y: np.ndarray, k: int, recall: float, queries: int = 256) -> None:
        ids, taken = zip(*(self.places(y[at : at + 1024]) for at in range(0, len(y), 1024)), strict=True)
        ids, taken = np.concatenate(ids), np.concatenate(taken)
        pick = np.random.default_rng(5).permutation(len(x))[:queries]
        k = min(k, len(x) - 1)
        if k < 1:
            return
        if len(x) < 2:
            return
        need, place, wanted = [], [], []
        for q in pick:
            score = x @ x[q]
            score[q] = -np.inf
            best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
            d = np.sqrt(squared(lift0(x[q : q + 1]), self.graph.centre)[0])
            rank = np.argsort(np.argsort(d, kind="stable"))
            need.append(np.where(taken[best], d[ids[best]], np.inf).min(1) / (d.min() + 1e-12))
            place.append(np.where(taken[best], rank[ids[best]], len(d)).min(1))
            wanted.append(best)
        # the number of lists is the sharper bound where nothing is clustered, the ratio where some of it is
        self.ratio = float(np.quantile(np.concatenate(need), 1 - (1 - recall) / 4)) * (1 + 1e-9)
        most = int(np.quantile(np.concatenate(place), recall)) + 1
        asked = lift0(x[pick])
        for grown in (1.0, 1.05, 1.1, 1.2, 1.4, 2.0):  # what the search misses is made up for
            self.width = min(len(self.graph.centre), max(2, math.ceil(most * grown)))
            found, dist = self.graph.search(asked, self.width)
            read = np.zeros((len(pick), len(self.graph.centre)), bool)
            near = np.sqrt(dist) <= self.ratio * (np.sqrt(dist[:, :1]) + 1e-12)
            read[np.nonzero(near)[0], found[near]] = True
            if np.mean([(read[n][ids[best]] & taken[best]).any(1).mean() for n, best in enumerate(wanted)]) >= recall - 0.015:
                break

    def probes(self, q: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Lists that each query reads."""
        ids, dist = self.graph.search(lift0(q), self.width)
        dist = np.sqrt(dist)
        for row, d in zip(ids, dist, strict=True):
            row, d = row[np.isfinite(d)], d[np.isfinite(d)]
            held = np.cumsum(self.size[row])
            enough = int(np.searchsorted(held, 2 * k + 2)) + 1
            yield row[: max(enough, int(np.searchsorted(d, self.ratio * (d[0] + 1e-12), side="right")))]

    def grouped(self, rows: np.ndarray, group_rows: int) -> None:
        """Number the units of work: ``unit`` of every list, and how many it has."""
        order = nearby_order(self.graph.centre)
        self.pieces = np.maximum(1, -(-rows // group_rows))
        self.unit = np.zeros(len(rows), np.int64)
        at = held = 0
        for one in order:
            if self.pieces[one] > 1 or held + rows[one] > group_rows:
                at, held = at + (held > 0), 0
            self.unit[one] = at
            held += rows[one]
            if self.pieces[one] > 1:
                at, held = at + self.pieces[one], 0


def nearby_order(centre: np.ndarray) -> np.ndarray:
    """Centroids in an order that keeps near ones together: halved again and again where they spread most."""
    done, todo = [], [np.arange(len(centre))]
    while todo:
        part = todo.pop()
        if len(part) < 3:
            done.append(part)
            continue
        by = np.argsort(centre[part, centre[part].var(0).argmax()], kind="stable")
        todo += [part[by[len(by) // 2 :]], part[by[: len(by) // 2]]]
    return np.concatenate(done)


def lift0(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 2))])


def valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )


def _best(vec: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, rough: np.ndarray):
    """The k best of a shard for one query: rough scores choose, exact ones decide."""
    if len(rough) > k + 1:
        edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        some = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
    else:
        some = np.arange(len(rough))
    some = some[ids[some] != own]
    exact = (vec[some] * query).sum(1)
    order = np.lexsort((ids[some], -exact))[:k]
    return ids[some[order]], exact[order]


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    lists_per_root: float = 4.0,
    max_lists: int = 8192,
    sample_rows: int = 20_000,
    replicas: int = 2,
    closure: float = 1.15,
    recall: float = 0.95,
    group_rows: int = 20_000,
    batch_queries: int = 20_000,
    stats: dict | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: rows whose id is divisible by ``query_every`` ask, all are searched.

    ``stats`` is filled with the number of vectors, queries and vectors read by them.
    """
    spark = df.sparkSession
    work = Work(spark, "ann")
    rows = valid(df, id_col, vec_col)
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    most = rows.agg(F.max(norm)).first()[0]
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).toArrow()
    x = matrix(sample.column("v"))
    lists = max(1, min(max_lists, len(x) // 16, round(lists_per_root * n**0.5)))
    index = ListIndex(x, most, lists, replicas, closure, k, recall)
    del sample, x

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, taken = index.places(lift(matrix(part.column("v")), index.most))
                r, c = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r, c]), pa.array(c == 0), part.column("id").take(pa.array(r)), part.column("v").take(pa.array(r))],
                    ["list", "own", "id", "v"],
                )

    placed = work.save(rows.mapInArrow(place, "list long, own boolean, id long, v array<double>"), "lists")
    counted = placed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()
    held = np.zeros(len(index.graph.centre), np.int64)
    index.size = held.copy()
    for r in counted:
        index.size[r["list"]], held[r["list"]] = r["own"], r["n"]
    # at least some tens of units, so that small tables are searched in parallel too
    index.grouped(held, max(256, min(group_rows, int(held.sum()) // 64)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: list[tuple[int, int, list[int]]] = []
                for row, own in enumerate(index.probes(matrix(part.column("v")), k)):
                    by: dict[int, list[int]] = {}
                    for c in own.tolist():
                        for u in range(index.unit[c], index.unit[c] + index.pieces[c]):
                            by.setdefault(int(u), []).append(c)
                    found += [(row, u, chosen) for u, chosen in by.items()]
                row, unit, chosen = zip(*found, strict=True) if found else ((), (), ())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit, pa.int64()), pa.array(chosen, pa.list_(pa.int64())), part.column("id").take(take), part.column("v").take(take)],
                    ["unit", "lists", "query_id", "q"],
                )

    queries = rows.filter(F.pmod("id", F.lit(query_every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = work.save(queries.mapInArrow(ask, "unit long, lists array<long>, query_id long, q array<double>"), "asked")
    if stats is not None:
        sizes = F.broadcast(spark.createDataFrame([(i, int(n // p)) for i, (n, p) in enumerate(zip(held, index.pieces, strict=True))], "list long, n long"))
        read = asked.select(F.explode("lists").alias("list")).join(sizes, "list").agg(F.sum("n")).first()[0]
        stats.update(vectors=n, queries=queries.count(), read=read, lists=lists, width=index.width)
    batches_of = asked.groupBy("unit").agg(F.ceil(F.count("*") / batch_queries).alias("batches"))
    of_list = F.broadcast(spark.createDataFrame([(i, int(u), int(p)) for i, (u, p) in enumerate(zip(index.unit, index.pieces, strict=True))], "list long, unit long, pieces long"))
    few = F.broadcast(batches_of)  # one row for each unit, at most n / group_rows of them and some tens
    stored = placed.join(of_list, "list").withColumn("unit", F.col("unit") + F.pmod(F.xxhash64("id"), "pieces")).join(few, "unit")
    stored = stored.select("unit", F.explode(F.sequence(F.lit(0), F.col("batches").cast("int") - 1)).alias("turn"), "list", "id", "v")
    sent = asked.join(few, "unit").select("unit", F.pmod(F.xxhash64("query_id"), "batches").cast("int").alias("turn"), "lists", "query_id", "q")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.take(pa.compute.sort_indices(left, [("list", "ascending"), ("id", "ascending")]))
            ids, vec, list_ = left.column("id").to_numpy(), matrix(left.column("v")), left.column("list").to_numpy()
            own, ask_, lists_ = right.column("query_id").to_numpy(), matrix(right.column("q")), right.column("lists").to_pylist()
            for q, chosen in enumerate(lists_):
                chosen = np.sort(np.array(chosen))
                spans = zip(np.searchsorted(list_, chosen, "left").tolist(), np.searchsorted(list_, chosen, "right").tolist(), strict=True)
                rows_ = np.concatenate([np.arange(a, b) for a, b in spans])
                best, exact = _best(vec[rows_], ids[rows_], ask_[q], own[q], k, vec[rows_] @ ask_[q])
                out.append((np.full(len(best), own[q]), best, exact))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    scored = stored.groupBy("unit", "turn").cogroup(sent.groupBy("unit", "turn")).applyInArrow(score, "query_id long, vec_id long, score double")
    # a vector found in several lists has one score; an id given to several vectors keeps its best
    once = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
