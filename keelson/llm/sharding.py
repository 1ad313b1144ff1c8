"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a number from 0 to N - 1. A keyed permutation of these numbers is the shuffle: its value modulo the number of shards is the
shard, and its quotient the slot. Shard and slot of a number, and the number at a shard and slot, follow from (N, shards, seed) alone, so a
reader finds a row without a lookup table. Shard sizes differ by one row at most.

* Row numbers: rows are dealt into key ranges and sorted there; the ranges' sizes give each its first number. The number is the rank
  of the row by (key, crc32, hash, size), so it does not depend on the partitioning. Rows equal in all of these are told apart by their place in
  the input, so that a key that repeats is spread over several ranges.
* Permutation: `ROUNDS` balanced Feistel rounds on the least even number of bits that holds N. A result of N or more is permuted again
  until it is below N: this stays a permutation, and takes under four steps on average.

Only the number of rows per range (one long a partition) reaches the driver. The numbered rows are stored once before their ranges are
counted, so a range that is worked out anew cannot change the numbers.

Groups (equal texts) are not held together: this law keeps row counts equal. Defined cases: null texts have size 1 and the crc32 of no
bytes, 0; null keys come first; repeated rows get their own slots; an empty table gives an empty result; extra columns are kept, those
named as a result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import add_columns, fresh
from keelson.session import materialise

ROUNDS, SEED, LAW = 6, 20240229, "rows"
PLACE_BITS = 33                                   # of monotonically_increasing_id
RESULTS = {"size", "text_crc32", "law", "row_number", "shard", "slot"}
PLACED = T.StructType([T.StructField("row_number", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round's function: 64-bit finaliser of two multiplications and shifts."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(key)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0 .. n - 1, and its inverse, on arrays."""

    def __init__(self, n: int, seed: int = SEED):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [int(k) for k in mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed & (1 << 64) - 1)]

    def once(self, x: np.ndarray, back: bool) -> np.ndarray:
        high, low = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                high, low = low ^ (mixed(high, key) & self.mask), high
            else:
                high, low = low, high ^ (mixed(low, key) & self.mask)
        return (high << np.uint64(self.half)) | low

    def walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(numbers, dtype=np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("number outside the permutation")
        x = self.once(x, back)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self.once(x[out], back)
        return x

    def apply(self, numbers: np.ndarray) -> np.ndarray:
        return self.walk(numbers, False)

    def invert(self, numbers: np.ndarray) -> np.ndarray:
        return self.walk(numbers, True)


def place(numbers, n_rows: int, n_shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shards and slots of row numbers."""
    p = Permutation(n_rows, seed).apply(numbers)
    return (p % np.uint64(n_shards)).astype(np.int32), (p // np.uint64(n_shards)).astype(np.int64)


def row_at(shards, slots, n_rows: int, n_shards: int, seed: int = SEED) -> np.ndarray:
    """Row numbers that stand at shards and slots."""
    at = np.asarray(slots, dtype=np.uint64) * np.uint64(n_shards) + np.asarray(shards, dtype=np.uint64)
    return Permutation(n_rows, seed).invert(at)


def numbered(df: DataFrame, order: list[str], mark: str, partitions: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """`df` with `mark` (long), and the first row number of each partition: `row_numbers` turns a mark into the rank by `order`."""
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the place in the input tells rows apart that are equal in `order`
    dealt = df.withColumn(mark, F.monotonically_increasing_id()).repartitionByRange(width, *order, mark).sortWithinPartitions(*order, mark)
    # now the upper bits are the range, the lower 33 the place in it
    stored = materialise(dealt.drop(mark).withColumn(mark, F.monotonically_increasing_id()))
    sizes = stored.groupBy(F.shiftright(mark, PLACE_BITS).alias("part")).count().collect()          # one row a partition
    counts = np.zeros(max((r["part"] for r in sizes), default=0) + 2, dtype=np.int64)
    for r in sizes:
        counts[r["part"] + 1] = r["count"]
    return stored, np.cumsum(counts)


def row_numbers(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return starts[marks >> PLACE_BITS] + (marks & ((1 << PLACE_BITS) - 1))


def sharded(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED, keep_text: bool = False,
            partitions: int | None = None) -> DataFrame:
    """`docs` with size, text_crc32, law, row_number, shard and slot; the text is dropped before any shuffle unless `keep_text`."""
    if n_shards < 1:
        raise ValueError("at least one shard")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in RESULTS - {key.lower(), text.lower()}])
    mark, digest = fresh(kept, "mark"), fresh(kept, "digest")
    filled = F.coalesce(F.col(text), F.lit(""))
    sized = kept.withColumns({"size": (F.octet_length(filled) + 1).cast("long"), "text_crc32": F.crc32(filled).cast("long"), digest: F.xxhash64(text)})
    rows, starts = numbered(sized if keep_text else sized.drop(text), [key, "text_crc32", digest, "size"], mark, partitions)
    total = int(starts[-1])

    def make():
        def compute(marks: list) -> list[np.ndarray]:
            numbers = row_numbers(np.array(marks, dtype=np.int64), starts)
            return [numbers, *place(numbers, total, n_shards, seed)]
        return compute

    return add_columns(rows.drop(digest).withColumn("law", F.lit(LAW)), mark, PLACED, make).drop(mark)


def write_shards(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED, rows_per_file: int = 1_000_000) -> None:
    """Parquet files in folders shard=0 .. of `path`, with slots in order inside a file; a task holds runs of `rows_per_file` slots."""
    rows = sharded(docs, n_shards, key, text, seed, keep_text=True)
    run = fresh(rows, "run")
    rows = rows.withColumn(run, F.floor(F.col("slot") / rows_per_file))
    rows.repartition("shard", run).sortWithinPartitions("shard", "slot").drop(run).write.partitionBy("shard").parquet(path)
