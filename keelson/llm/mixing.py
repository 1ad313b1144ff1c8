"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources (a membership pattern) are interchangeable, so they are aggregated first. A small network
then routes words: pattern -> each of its sources -> the source's quota. Each further copy of a pattern costs more (convex repetition
costs 0, 1, 3, ... per word), up to `max_copies`, so repeats are used only where fresh words run out. Successive cheapest paths solve it
on the driver: the network has one node per pattern and source, both taken to be few.

A pattern's share of words is taken from a tape: its documents in a seeded hash order, once per copy. The document at the cut is taken in
part, so that quotas are met to the word. The cut is found by aggregating 12 bits of the hash at a time; nothing is sorted as a whole.

Defined cases: null text has size 0; a null source is a source of its own, after all others; a document without sources (empty or null
set) takes part with 0 words; rows with the same id, text and sources tie and are taken in a fixed order among themselves; an empty table
gives an empty result; texts of any length are counted whole; extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import WORD, packed, unpacked
from keelson.session import materialise

BITS, LEVELS = 12, 3
BROADCAST_PATTERNS = 20_000                       # more patterns than this are joined by a shuffle
MAX_COPIES = 3


def targets_by_weight(sizes: dict[str | None, int], weights=(1, 2, 3), most: int = MAX_COPIES) -> dict[str | None, Fraction]:
    """Exact targets: sources in code point order (null last) weigh 1, 2, 3 and so on again; no target exceeds `most` times its source,
    and what is cut off is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, target = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


class Flow:
    """Cheapest flow by successive cheapest paths with potentials; capacities and costs are integers."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []                          # to, capacity left, cost; the reverse edge is at index ^ 1
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for to, at, cap, c in ((b, a, capacity, cost), (a, b, 0, -cost)):
            self.out[at].append(len(self.edges))
            self.edges.append([to, cap, c])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * len(self.out)
        while True:
            far, back = [None] * len(self.out), [-1] * len(self.out)
            far[source], heap = 0, [(0, source)]
            while heap:
                d, at = heapq.heappop(heap)
                if d > far[at]:
                    continue
                for e in self.out[at]:
                    to, cap, cost = self.edges[e]
                    if cap and (far[to] is None or d + cost + potential[at] - potential[to] < far[to]):
                        far[to], back[to] = d + cost + potential[at] - potential[to], e
                        heapq.heappush(heap, (far[to], to))
            if far[sink] is None:
                return
            potential = [p + d if d is not None else p for p, d in zip(potential, far, strict=True)]
            path, at = [], sink
            while at != source:
                path.append(back[at])
                at = self.edges[back[at] ^ 1][0]
            pushed = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= pushed
                self.edges[e ^ 1][1] += pushed


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], max_copies: int = MAX_COPIES) -> dict[tuple, dict[str | None, int]]:
    """Words each pattern gives to each of its sources: as much of the quotas as can be filled, with the fewest repeats."""
    ps, ss = list(patterns), list(quotas)
    flow = Flow(2 + len(ps) + len(ss))
    place = {s: 2 + len(ps) + i for i, s in enumerate(ss)}
    arcs = {}
    for i, p in enumerate(ps):
        for copy in range(max_copies):
            flow.add(0, 2 + i, patterns[p], copy * (copy + 1) // 2)
        for s in p:
            if s in place:
                arcs[i, s] = flow.add(2 + i, place[s], max_copies * patterns[p])
    for s in ss:
        flow.add(place[s], 1, quotas[s])
    flow.run(0, 1)
    out: dict[tuple, dict[str | None, int]] = {p: {} for p in ps}
    for (i, s), e in arcs.items():
        out[ps[i]][s] = flow.edges[e ^ 1][1]
    return out


def whole_targets(targets: dict[str | None, Fraction]) -> dict[str | None, int]:
    """Targets in whole words with the same sum, by largest remainder."""
    down = {s: t.numerator // t.denominator for s, t in targets.items()}
    spare = round(sum(targets.values())) - sum(down.values())
    for s in sorted(targets, key=lambda s: (down[s] - targets[s], s is None, s or ""))[:spare]:
        down[s] += 1
    return down


def mix(docs: DataFrame, sources, weights=(1, 2, 3), max_copies: int = MAX_COPIES, seed: int = 17, key: str = "doc_id",
        text: str = "text") -> DataFrame:
    """`docs` with mix_size (words), mix_taken (words the mix takes, repeats counted) and mix_sources, an array of
    (source, size, target) for each of its sources.

    `sources` is a column: the array of the sources a document belongs to.
    """
    spark = docs.sparkSession
    work = packed(docs, key=F.col(key), text=F.col(text), _sources=F.coalesce(F.array_sort(F.array_distinct(sources)), F.array().cast("array<string>")),
                  mix_size=F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    work = work.withColumn("_p", F.to_json("_sources")).withColumn("_h", F.xxhash64(F.lit(seed), "key", "text", "_p")).drop("text")
    small = materialise(work.select("_sources", "_p", "_h", "mix_size"))
    names = {}
    patterns = {}
    for r in small.groupBy("_p").agg(F.sum("mix_size").alias("n"), F.first("_sources").alias("s")).collect():
        names[tuple(r["s"])] = r["_p"]
        patterns[tuple(r["s"])] = r["n"]
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_by_weight(sizes, weights, max_copies)
    if len(patterns) and any(len(p) > 1 for p in patterns):       # overlapping sources share their words: together no more than there are
        scale = Fraction(sum(patterns.values()), max(1, sum(sizes.values())))
        targets = {s: t * scale for s, t in targets.items()}
    routed = route(patterns, whole_targets(targets), max_copies)

    def small_side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(patterns) <= BROADCAST_PATTERNS else df

    rows = [(names[p], n, sum(routed[p].values()) // n if n else 0, sum(routed[p].values()) % n if n else 0,
             [(s, sizes[s], float(targets[s])) for s in p]) for p, n in patterns.items()]
    plan = spark.createDataFrame(rows, "_p string, _n long, _full long, _rest long, mix_sources array<struct<source: string, size: long, "
                                       "target: double>>")
    digit = [F.shiftrightunsigned("_h", 64 - BITS * (k + 1)).bitwiseAND(F.lit((1 << BITS) - 1)) for k in range(LEVELS)]

    # the cut of each pattern: digits of the hash below which documents get one copy more, and the words used before
    cut = plan.where("_rest > 0").select("_p", F.lit(0).cast("long").alias("_before"), "_rest")
    for k in range(LEVELS):
        inside = small.select("_p", "_h", "mix_size").join(small_side(cut), "_p")
        for i in range(k):
            inside = inside.where(digit[i] == F.col(f"_d{i}"))
        own = [f"_d{i}" for i in range(k + 1)]
        sums = inside.withColumn(f"_d{k}", digit[k]).groupBy("_p", *own, "_before", "_rest").agg(F.sum("mix_size").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("_p").orderBy(f"_d{k}"))            # 2 ** BITS rows a pattern
        cut = materialise(sums.withColumn("_after", F.col("_before") + upto).withColumn("_start", F.col("_after") - F.col("w"))
                          .where("_start < _rest and _after >= _rest").select("_p", *own, F.col("_start").alias("_before"), "_rest"))

    edge = cut.select("_p", *[F.col(f"_d{i}").alias(f"_c{i}") for i in range(LEVELS)], "_before")
    placed = work.join(small_side(plan), "_p").join(small_side(edge), "_p", "left")
    here = F.struct(*digit)
    there = F.struct(*[F.col(f"_c{i}") for i in range(LEVELS)])
    side = F.when(F.col("_c0").isNull() | (here > there), 1).when(here < there, -1).otherwise(0)
    placed = placed.withColumn("_side", side)
    base = F.col("_full") * F.col("mix_size")
    plain = placed.where("_side != 0").withColumn("mix_taken", base + F.when(F.col("_side") < 0, F.col("mix_size")).otherwise(0))
    # documents that share all these digits with the cut: one in 2 ** 36 of a pattern, besides repeated rows
    order = Window.partitionBy("_p").orderBy("_h", "mix_size", "key").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.where("_side = 0").withColumn("_used", F.col("_before") + F.coalesce(F.sum("mix_size").over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("_rest") - F.col("_used")))
    split = at_cut.withColumn("mix_taken", base + more)
    kept = [c for c in docs.columns if c.lower() not in ("mix_size", "mix_taken", "mix_sources")]
    both = plain.unionByName(split, allowMissingColumns=True)
    return both.select(*unpacked(both, kept), "mix_size", "mix_taken", "mix_sources")
