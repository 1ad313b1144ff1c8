"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

A vector is lengthened by one component so that the largest inner product becomes the smallest Euclidean distance, then cut into two
halves, each with its own k-means centroids. A cell is a pair of centroids. A query walks the pairs by the sum of its two distances, taken
from a heap, until the cells it has passed hold `depth` of all rows; every row of those cells is then ranked by the exact inner product.

* Centroids and depth are fitted on a bounded sample (`SAMPLE` vectors by hash). Depth is the smallest share of rows at which the sample's
  queries reach `recall` against brute force within the sample, so it follows the data: structureless vectors need a deep walk.
* Equal vectors are one index entry with its k + 1 smallest ids, and equal queries are searched once, so copies cost nothing.
* Work is dealt by (first centroid, part); a first centroid with many rows has several parts of about `PART` rows. A task holds one part
  and streams the queries that visit it.

Defined cases: vectors that are null, zero, of a length other than the commonest, or hold null or non-finite components take no part (as
query or as candidate), nor do rows with a null id; fewer than k candidates give shorter lists; ties go to the smaller id; several rows
with one id and one vector count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import materialise

SAMPLE, PART = 20_000, 8192
ROWS_PER_CELL, MAX_CENTROIDS = 12, 256
LEAST = 1000                                      # rows a walk passes at least
HIT = "query long, rep long, score double"


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class MultiIndex:
    """Two sets of centroids; codes of rows and walks of queries. Small and picklable."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, recall: float, k: int):
        self.dims, self.longest = sample.shape[1], longest
        self.half = (self.dims + 1) // 2
        size = int(np.clip(2 ** round(np.log2(max(1.0, np.sqrt(rows / ROWS_PER_CELL)))), 1, MAX_CENTROIDS))
        x = self.lengthen(sample)
        self.centres = [kmeans(x[:, :self.half], size), kmeans(x[:, self.half:], size)]
        self.share = self.calibrate(sample, recall, k)
        self.depth = max(LEAST, int(np.ceil(self.share * rows)))
        self.sizes = np.zeros((len(self.centres[0]), len(self.centres[1])), np.int64)

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x ** 2).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.lengthen(x)
        return distances(x[:, :self.half], self.centres[0]).argmin(axis=1), distances(x[:, self.half:], self.centres[1]).argmin(axis=1)

    def to_centres(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.hstack([q, np.zeros((len(q), 1))])
        return distances(q[:, :self.half], self.centres[0]), distances(q[:, self.half:], self.centres[1])

    def calibrate(self, sample: np.ndarray, recall: float, k: int, queries: int = 200) -> float:
        """Share of rows that walks must pass for the wanted mean recall of the k nearest within the sample."""
        q = sample[:queries]
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        a, b = self.code(sample)
        one, two = self.to_centres(q)
        order = np.argsort(one[:, a] + two[:, b], axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(sample))[None, :], axis=1)
        near = np.argsort(-scores, axis=1)[:, :min(k, max(1, len(sample) - 1))]
        needed = np.sort(np.take_along_axis(place, near, axis=1).ravel())
        return (needed[min(len(needed) - 1, int(recall * len(needed)))] + 1) / len(sample)

    def walk(self, one: np.ndarray, two: np.ndarray) -> dict[int, list[int]]:
        """First centroid -> second centroids of the cells passed, nearest pair first, until they hold `depth` rows."""
        first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        one, two = one[first].tolist(), two[second].tolist()
        sizes, left = self.sizes[np.ix_(first, second)].tolist(), self.depth
        out: dict[int, list[int]] = {}
        reached = [0] * len(one)                                  # how far each row of the table of pairs has been pushed
        heap = [(one[0] + two[0], 0, 0)]
        while heap and left > 0:
            _, i, j = heapq.heappop(heap)
            if sizes[i][j]:
                out.setdefault(int(first[i]), []).append(int(second[j]))
                left -= sizes[i][j]
            if j + 1 < len(two) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if i + 1 < len(one) and reached[i + 1] == j:
                heapq.heappush(heap, (one[i + 1] + two[j], i + 1, j))
            reached[i] = j + 1
        return out


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): rows that take part, as double arrays without negative zeros."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(column), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    dims = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    return rows.where(F.size("v") == (dims[0]["dims"] if dims else 0))


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95,
            sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, key, column).distinct())
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = materialise(rows.withColumn("p", place).where(F.col("p") <= k + 1).groupBy("v")
                          .agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"))
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n = facts["n"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / n)).orderBy(F.xxhash64("v")).limit(2 * sample)
    got = drawn.select("v").collect() or entries.limit(1).select("v").collect()
    index = MultiIndex(np.array([r["v"] for r in got]), n, float(np.sqrt(facts["m"])), recall, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                one, two = index.code(x)
                yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "v": b.column("v"), "i": pa.array(one, pa.int32()), "j": pa.array(two, pa.int32())})

    coded = materialise(entries.mapInArrow(assign, "rep long, v array<double>, i int, j int"))
    for r in coded.groupBy("i", "j").agg(F.count("*").alias("n")).collect():      # at most MAX_CENTROIDS ** 2 rows
        index.sizes[r["i"], r["j"]] = r["n"]
    parts = np.maximum(1, -(-index.sizes.sum(axis=1) // PART)).tolist()

    asked = rows.where(F.col("id") % every == 0)
    queries = asked.groupBy("v").agg(F.min("id").alias("query"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = index.to_centres(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1))
            ids, vs = b.column("query"), b.column("v")
            at, shard, cells = [], [], []
            for r in range(b.num_rows):
                for i, js in index.walk(one[r], two[r]).items():
                    for part in range(parts[i]):
                        at.append(r)
                        shard.append(i * (1 << 32) + part)
                        cells.append(js)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "kind": pa.array([1] * len(at), pa.int32()), "id": ids.take(pa.array(at)),
                                              "j": pa.array([0] * len(at), pa.int32()), "v": vs.take(pa.array(at)), "cells": pa.array(cells, pa.list_(pa.int32()))})

    visits = queries.mapInArrow(visit, "shard long, kind int, id long, j int, v array<double>, cells array<int>")
    of_row = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("i") + 1)
    stored = coded.select((F.col("i").cast("long") * (1 << 32) + F.pmod(F.xxhash64("rep"), of_row)).alias("shard"), F.lit(0).alias("kind"),
                          F.col("rep").alias("id"), "j", "v", F.lit(None).cast("array<int>").alias("cells"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, index rows (by cell and id) before queries."""
        state: dict = {"shard": None}

        def close_index():
            state["x"] = np.concatenate(state["xs"]) if state["xs"] else np.zeros((0, index.dims))
            state["ids"], state["js"] = (np.concatenate(state[c]) if state[c] else np.zeros(0, np.int64) for c in ("idss", "jss"))
            state["xs"] = None

        def answer(ids, q, cells):
            x, reps, js = state["x"], state["ids"], state["js"]
            if not len(x):
                return None
            starts = np.searchsorted(js, np.arange(index.sizes.shape[1] + 1))
            wanted: dict[int, list[int]] = {}
            for r, own in enumerate(cells):
                for j in own:
                    wanted.setdefault(j, []).append(r)
            scores = np.full((len(q), len(x)), -np.inf)
            for j, own in wanted.items():
                if starts[j] < starts[j + 1]:
                    scores[own, starts[j]:starts[j + 1]] = q[own] @ x[starts[j]:starts[j + 1]].T
            most = min(k + 1, len(x))
            least = np.partition(scores, len(x) - most, axis=1)[:, len(x) - most]
            r, c = np.nonzero((scores >= least[:, None] - 1e-12) & (scores > -np.inf))
            exact = np.einsum("ij,ij->i", q[r], x[c])
            order = np.lexsort((reps[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k + 1
            return pa.RecordBatch.from_pydict({"query": pa.array(ids[r[keep]], pa.int64()), "rep": pa.array(reps[c[keep]], pa.int64()),
                                               "score": pa.array(exact[keep], pa.float64())})

        for b in batches:
            if not b.num_rows:
                continue
            shards, kinds = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            ids, js = b.column("id").to_numpy(), b.column("j").to_numpy()
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            cells = b.column("cells")
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if shards[s] != state["shard"]:
                    state = {"shard": shards[s], "xs": [], "idss": [], "jss": []}
                if kinds[s] == 0:
                    for name, part in (("xs", x), ("idss", ids), ("jss", js)):
                        state[name].append(part[s:e].copy())
                    continue
                if state["xs"] is not None:
                    close_index()
                for at in range(s, e, 256):
                    to = min(e, at + 256)
                    out = answer(ids[at:to], x[at:to], cells.slice(at, to - at).to_pylist())
                    if out is not None:
                        yield out

    both = stored.unionByName(visits).repartition("shard").sortWithinPartitions("shard", "kind", "j", "id")
    hits = both.mapInArrow(search, HIT)
    best = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "rep"))).alias("h"))   # (k + 1) x parts visited
    best = best.select("query", F.explode(F.slice("h", 1, k + 1)).alias("h")).select("query", (-F.col("h.s")).alias("score"), F.col("h.rep").alias("rep"))
    found = (best.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("h"))
             .select("query", F.slice("h", 1, k + 1).alias("h")))
    members = asked.select("v", F.col("id").alias("query_id")).join(queries, "v").select("query", "query_id")
    listed = members.join(found, "query").select("query_id", F.slice(F.filter("h", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("h"))
    return listed.select("query_id", F.posexplode("h").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
