"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits of word shingles; a bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Linking: two texts link when their fingerprints differ in at most `distance` = 3 bits.

* Equal fingerprints are one entry with its smallest id, so exact copies never meet each other.
* The 64 bits are cut into four blocks of 16. Two entries that link agree on one of them, so each entry goes to four buckets. The bucket's
  bits are part of the shuffle key, so no bucket is a large share of the entries unless these share 16 bits.
* In a bucket the entries are sorted by Gray rank and grouped by threes, level by level. A node holds the bits its members share (mask
  and pattern). Pairs of nodes go down from the top with the differences of shared bits added up along the way; a pair with more than
  three is dropped with all its members, and a pair that cannot exceed three is linked without looking inside.
* Near copies (`keep_first(near=True)`): texts of 0.8 or more on five-word shingles differ in about ten of 64 bits. Candidates agree on one of eight
  blocks and differ in at most 14 bits, and in at most 28 of 128 with a second word; the index finds them in buckets of a 256th of
  the entries. Every link is then confirmed by the exact Jaccard similarity of the texts, so nothing below 0.8 is removed. The work inside buckets
  grows with the square of the entries (README has the figures); beyond ten million texts take fewer, longer blocks.
* A task emits a spanning set of its links (each entry to the smallest of its local group), never all pairs; `components` joins them.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle; texts of any
length are read whole; repeated rows are repeated in the result; rows with a null id get their component but are never its name unless all
ids in it are null; an empty table gives an empty result; extra columns are ignored (`near_duplicates`) or kept (`keep_first`).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import add_columns, components, packed
from keelson.session import materialise

DISTANCE, BLOCKS, FAN = 3, 4, 3
#: Candidates for near copies of 0.8 and more on five-word shingles: bits that may differ of the 64 of the index, blocks, and bits of all 128.
WIDE_DISTANCE, WIDE_BLOCKS, WIDE_TOTAL = 14, 8, 28
SHINGLE, SIMILARITY = 5, 0.8
BROADCAST_BYTES = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(hashes: np.ndarray) -> int:
    """64 bits, unsigned: a bit is set if it is set in over half of the hashes."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        total += np.unpackbits(hashes[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle. Words and shingles are found in the UTF-8 bytes, where white space and A-Z are single bytes."""
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER)) if text else []
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([h(b" ".join(words), 42)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:len(words) - shingle].tolist()]
    return np.array([h(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, unsigned; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(df: DataFrame, column: str = "text", shingle: int = 3, wide: bool = False) -> DataFrame:
    """`df` with _fp, the fingerprint as a signed long, and, if `wide`, _fp2: 64 bits more from remixed hashes."""
    out = T.StructType([T.StructField(c, T.LongType()) for c in (["_fp", "_fp2"] if wide else ["_fp"])])

    def compute(texts: list) -> list[list]:
        one, two = [], []
        for t in texts:
            h = shingle_hashes(t, shingle)
            one.append(signed(majority(h)))
            if wide:
                h = (h ^ (h >> np.uint64(29))) * MIX
                two.append(signed(majority(h ^ (h >> np.uint64(32)))))
        return [one, two][:len(out)]

    return add_columns(df, column, out, lambda: compute)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def local_links(bucket: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, chunk: int = 1 << 18,
                second: np.ndarray | None = None, total: int = WIDE_TOTAL, compared: list[int] | None = None) -> np.ndarray:
    """For each entry the number of the first entry of its group, links being within buckets only.

    bucket: sorted labels; fps: unsigned, in Gray order within a bucket. With `second` (64 bits more of each entry), a link also needs at
    most `total` differing bits in both together, and no node is linked without looking inside. `compared` gathers the numbers of nodes and
    entries that were compared pair by pair.
    """
    n = len(fps)
    root = np.arange(n)

    def top(i: np.ndarray) -> np.ndarray:
        while True:
            up = root[i]
            if (up == i).all():
                return i
            root[i] = root[up]
            i = root[i]

    def link(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = top(a), top(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            low, high = low[open_], high[open_]
            np.minimum.at(root, high, low)
            a, b = low, high

    # levels[0] is the entries; each level above groups up to FAN neighbours of one bucket
    levels = [{"start": np.arange(n), "end": np.arange(1, n + 1), "both": fps, "any": fps, "bucket": bucket, "first": np.arange(n)}]
    while len(levels[-1]["bucket"]) > 1 and (levels[-1]["bucket"][1:] == levels[-1]["bucket"][:-1]).any():
        below = levels[-1]
        size = len(below["bucket"])
        new = np.r_[True, below["bucket"][1:] != below["bucket"][:-1]]
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        cut = np.flatnonzero((np.arange(size) - begin) % FAN == 0)
        levels.append({"start": cut, "end": np.r_[cut[1:], size], "both": np.bitwise_and.reduceat(below["both"], cut),
                       "any": np.bitwise_or.reduceat(below["any"], cut), "bucket": below["bucket"][cut], "first": below["first"][cut]})
    for lev in levels:
        lev["mask"] = ~(lev["both"] ^ lev["any"])                 # bits that all members share
        lev["last"] = np.r_[lev["first"][1:], n] - 1
    stack = [(len(levels) - 1, np.arange(len(levels[-1]["bucket"])), np.arange(len(levels[-1]["bucket"])))]
    while stack:
        k, a, b = stack.pop()
        step = chunk // (FAN * FAN) if k else chunk
        if len(a) > step:                                         # one part at a time goes down, so little waits at each level
            stack.append((k, a[step:], b[step:]))
            a, b = a[:step], b[:step]
        lev = levels[k]
        if compared is not None:
            compared.append(len(a))
        shared = lev["mask"][a] & lev["mask"][b]
        apart = np.bitwise_count((lev["both"][a] ^ lev["both"][b]) & shared).astype(np.int64)
        a, b, shared, apart = (x[apart <= distance] for x in (a, b, shared, apart))
        sure = (apart + np.bitwise_count(~shared) <= distance) & (k > 0 and second is None)
        if sure.any():                                            # no two members can differ in more: all of both nodes are one group
            for x, y in ((a, a), (a, b)):
                x, y = x[sure], y[sure]
                width = lev["last"][y] - lev["first"][y] + 1
                link(np.repeat(lev["first"][x], width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lev["first"][y], width))
        a, b = a[~sure], b[~sure]
        if k == 0:
            if second is not None:
                close = np.bitwise_count(fps[a] ^ fps[b]).astype(np.int64) + np.bitwise_count(second[a] ^ second[b]) <= total
                a, b = a[close], b[close]
            link(a, b)
            continue
        below = levels[k - 1]
        wa, wb = lev["end"][a] - lev["start"][a], lev["end"][b] - lev["start"][b]
        count = wa * wb
        if not count.sum():
            continue
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(wb, count)
        x, y = np.repeat(lev["start"][a], count) + nth // width, np.repeat(lev["start"][b], count) + nth % width
        keep = x <= y if k > 1 else x < y
        x, y = x[keep], y[keep]
        if k == 1:                                                # entries already in one group need no test
            differ = top(below["first"][x]) != top(below["first"][y])
            x, y = x[differ], y[differ]
        stack.append((k - 1, x, y))
    return top(np.arange(n))


def leaders(group: np.ndarray, fps: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each entry the leader of its group: the member whose words are nearest to the majority of the group's bits (ties: the first).

    Copies that were each changed apart from one text are nearer to it than to each other; it, or one close to it, leads.
    """
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    apart = np.zeros(len(group), dtype=np.int64)
    for words in (fps, second):
        bits = np.unpackbits(np.ascontiguousarray(words[order]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > sizes[:, None]
        centre = np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]
        apart += np.bitwise_count(words[order] ^ np.repeat(centre, sizes))
    best = np.lexsort((order, apart, np.repeat(np.arange(len(starts)), sizes)))
    out = np.empty(len(group), dtype=np.int64)
    out[order] = np.repeat(order[best[starts]], sizes)
    return out


def close_to(i: int, label: np.ndarray, fps: np.ndarray, second: np.ndarray, group: np.ndarray, distance: int, total: int) -> np.ndarray:
    """Entries of the bucket of i that are of another group and close to it in one and both words."""
    low, high = np.searchsorted(label, label[i], "left"), np.searchsorted(label, label[i], "right")
    apart = np.bitwise_count(fps[low:high] ^ fps[i]).astype(np.int64)
    return low + np.flatnonzero((apart <= distance) & (apart + np.bitwise_count(second[low:high] ^ second[i]) <= total) & (group[low:high] != group[i]))


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets `others` (not empty) have a Jaccard similarity of SIMILARITY or more to the sorted set `one`."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return common >= SIMILARITY * (len(one) + sizes - common)


def choices(blocks: int = BLOCKS, agree: int = 1) -> list[int]:
    """Masks of the blocks that agree, one per way to choose `agree` of them."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(masks, agree)]


def dealt(entries: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """(c, bits, _fp, `columns`): entries in the buckets of their blocks, each bucket whole in a partition and in Gray order."""
    rows = entries.select("_fp", *columns, F.posexplode(F.array(*[F.lit(signed(m)) for m in choices(blocks)])).alias("c", "m"))
    rows = rows.select("c", F.col("_fp").bitwiseAND(F.col("m")).alias("bits"), "_fp", *columns)
    gray = F.col("_fp")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    # sorting compares signed longs; flipping the top bit gives the unsigned order of ranks
    return rows.repartition("c", "bits").withColumn("rank", gray.bitwiseXOR(F.lit(-(1 << 63)))).sortWithinPartitions("c", "bits", "rank").drop("rank")


def by_buckets(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Labels of the buckets, then _fp and `columns`, of whole buckets with `least` rows or more together."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "bits", "_fp", *columns)))
        if held and (batch is None or sum(len(h[0]) for h in held) >= least):
            own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            c, bits = own[:2]
            upto = len(c)
            if batch is not None:                                 # the last bucket may go on in the next batch
                upto = int(np.flatnonzero((c == c[-1]) & (bits == bits[-1]))[0])
            held = [tuple(x[upto:] for x in own)]
            if upto:
                label = np.cumsum(np.r_[True, (c[1:upto] != c[:upto - 1]) | (bits[1:upto] != bits[:upto - 1])])
                yield label, c[:upto], *(x[:upto] for x in own[2:])


def fp_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(entries: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, wide: bool = False) -> DataFrame:
    """(a, b): links that connect all entries (column _fp, distinct) within `distance` bits that agree on a block, directly or through others.

    If `wide`, links also need at most WIDE_TOTAL differing bits in _fp and _fp2 together, and a is the leader of its group.
    """
    columns = ["_fp2"] if wide else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, _, own, *more in by_buckets(batches, columns, 100_000):
            second = more[0].view(np.uint64) if more else None
            group = local_links(label, own.view(np.uint64), distance, second=second)
            if second is not None:
                group = leaders(group, own.view(np.uint64), second)
            tied = np.flatnonzero(group != np.arange(len(own)))
            yield fp_pairs(own[group[tied]], own[tied])

    return dealt(entries, columns, blocks).mapInArrow(run, "a long, b long")


def odd_candidates(flagged: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(_fp): odd entries of `flagged` (_fp, _fp2, odd, g) that have a candidate in another group, and these candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, _, own, second, odd, group in by_buckets(batches, ["_fp2", "odd", "g"], 100_000):
            seen = np.zeros(len(own), dtype=bool)
            for i in np.flatnonzero(odd):
                near = close_to(i, label, own.view(np.uint64), second.view(np.uint64), group, distance, WIDE_TOTAL)
                seen[near] = True
                seen[i] |= len(near) > 0
            yield pa.RecordBatch.from_pydict({"_fp": pa.array(own[seen], pa.int64())})

    return dealt(flagged, ["_fp2", "odd", "g"], blocks).mapInArrow(run, "_fp long").distinct()


def odd_links(flagged: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(a, b): confirmed links of odd entries with candidates of other groups; `flagged` has their shingles (h), which are compared in the bucket."""
    masks = [np.uint64(m) for m in choices(blocks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, c, own, second, odd, group, h in by_buckets(batches, ["_fp2", "odd", "g", "h"], 4000):
            fps, full = own.view(np.uint64), np.array([len(x) > 0 for x in h])
            for i in np.flatnonzero(odd & full):
                near = close_to(i, label, fps, second.view(np.uint64), group, distance, WIDE_TOTAL)
                near = near[full[near] & ~(odd[near] & (near < i))]           # of two odd ones, the first
                for m in masks[:c[i]]:                                        # once, in the first block on which they agree
                    near = near[((fps[near] ^ fps[i]) & m) != 0]
                if len(near):
                    near = near[similar(h[i], [h[j] for j in near])]
                    yield fp_pairs(np.full(len(near), own[i]), own[near])

    return dealt(flagged, ["_fp2", "odd", "g", "h"], blocks).mapInArrow(run, "a long, b long")


def shingle_sets(texts: list) -> list[list]:
    return [[np.unique(shingle_hashes(t, SHINGLE)).view(np.int64).tolist() for t in texts]]


def sets_of(wanted: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """(want, h): sorted shingle hashes of the fingerprints `wanted` (_fp), each standing for the text of its smallest id."""
    first = materialise(marked.join(wanted, "_fp", "left_semi").groupBy("_fp").agg(F.min("_id").alias("_id")).withColumnRenamed("_fp", "want"))
    side = F.broadcast(first) if first.count() * 32 <= BROADCAST_BYTES else first
    texts = with_fingerprints(rows.join(side, F.col("key").eqNullSafe(F.col("_id"))).select("want", "text"), "text", SHINGLE).where("_fp = want")
    out = T.StructType([T.StructField("h", T.ArrayType(T.LongType()))])
    return materialise(add_columns(texts.groupBy("want").agg(F.min("text").alias("text")), "text", out, lambda: shingle_sets).select("want", "h"))


def confirmed(pairs: DataFrame, marked: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts have a Jaccard similarity of SIMILARITY or more over shingles of SHINGLE words.

    marked: (_id, _fp); rows: (key, text).
    """
    sets = sets_of(pairs.select(F.col("a").alias("_fp")).union(pairs.select("b")).distinct(), marked, rows)
    both = (pairs.join(sets.select(F.col("want").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("want").alias("b"), F.col("h").alias("y")), "b"))
    x, y = F.size("x"), F.size("y")
    possible = F.least(x, y) >= SIMILARITY * F.greatest(x, y)
    common = F.size(F.array_intersect("x", "y"))
    return materialise(both.where(possible & (common >= SIMILARITY * (x + y - common))).select("a", "b"))


def near_copies(marked: DataFrame, rows: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(a, b): links of fingerprints, all confirmed on the texts, that connect the near copies among the index's candidates.

    The index gives links from the leader of each of its groups. Where one of them fails on the texts, its entry meets all its candidates that
    the confirmed links have not yet brought into its group; their shingles are compared inside the bucket.
    """
    entries = materialise(marked.select("_fp", "_fp2").distinct())
    stars = materialise(links(entries, distance, blocks, True).where("a != b").distinct())
    good = confirmed(stars, marked, rows)
    odd = materialise(stars.join(good, ["a", "b"], "left_anti").select(F.col("b").alias("_fp")).distinct().withColumn("odd", F.lit(True)))
    groups = components(good).select(F.col("node").alias("_fp"), F.col("component").alias("g"))
    flagged = materialise(entries.join(odd, "_fp", "left").join(groups, "_fp", "left").withColumns({"odd": F.coalesce("odd", F.lit(False)), "g": F.coalesce("g", "_fp")}))
    sets = sets_of(materialise(odd_candidates(flagged, distance, blocks)), marked, rows)
    more = odd_links(flagged.join(sets.withColumnRenamed("want", "_fp"), "_fp"), distance, blocks)
    return good.union(materialise(more.distinct()))


def classes(marked: DataFrame, key: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS, edges: DataFrame | None = None) -> DataFrame:
    """(_fp, _root, component_id): for each fingerprint of `marked` its group, and the smallest `key` of the group."""
    entries = materialise(marked.groupBy("_fp").agg(F.min(key).alias("_id")))
    groups = components(links(entries, distance, blocks) if edges is None else edges)
    named = entries.join(groups, F.col("_fp") == F.col("node"), "left").select("_fp", "_id", F.coalesce("component", "_fp").alias("_root"))
    first = named.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return named.join(first, "_root").select("_fp", "_root", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", column: str = "text", near: bool = False) -> DataFrame:
    """`df` with one row of each group: the one with the smallest key, and of its repeated rows the one with the least text and JSON form.

    Groups link as in `near_duplicates`; if `near`, they are near copies of SIMILARITY on shingles of SHINGLE words, candidates from the
    index, confirmed on the texts.
    """
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("text"))
    shingle = SHINGLE if near else 3
    marked = materialise(with_fingerprints(rows, "text", shingle, near).withColumnRenamed("key", "_id").drop("text"))
    groups = classes(marked, "_id", edges=near_copies(marked, rows, WIDE_DISTANCE, WIDE_BLOCKS) if near else None)
    kept = materialise(marked.join(groups, "_fp").where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("_id", "_fp", "_root")
                       .agg(F.count("*").alias("n")))
    # a group keeps one fingerprint of its first key; rows that have just that fingerprint and key are its candidates
    one = kept.groupBy("_root").agg(F.min(F.struct("_id", "_fp", "n")).alias("k")).select("k.*")
    rows = with_fingerprints(packed(df, key=F.col(key), text=F.col(column)), "text", shingle)
    rows = rows.join(one, rows["_fp"].eqNullSafe(one["_fp"]) & rows["key"].eqNullSafe(one["_id"])).select("row", "key", "text", rows["_fp"], "n")
    repeated = rows.where("n > 1").groupBy("_fp", "key").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return rows.where("n = 1").select("row").union(repeated.select("row")).select("row.*")


def near_duplicates(df: DataFrame, key: str = "doc_id", column: str = "text", shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id), one row per row of `df`; component_id is the smallest key reachable over links."""
    marked = materialise(with_fingerprints(df.select(key, column), column, shingle).select(key, "_fp"))
    text = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return marked.join(classes(marked, key, distance), "_fp").select(key, text.alias("fingerprint"), "component_id")
