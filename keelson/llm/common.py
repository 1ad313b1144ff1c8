"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.session import materialise, prepare

#: A word is a run of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_ROWS = "1000"


def ready(spark: SparkSession) -> SparkSession:
    """Session options of the engine, and Arrow batches small enough that a thousand very long texts fit in a worker."""
    prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col, mod: int):
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(col.cast("string")) % mod


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so: internal columns never meet the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, **own) -> DataFrame:
    """The columns `own`, and all columns of `df` as one struct `row`: `select("row.*")` gives them back, whatever their names."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(df: DataFrame, columns: list[str], **changed) -> list:
    """Select list of the fields `columns` of `row`, with new values for those in `changed`."""
    return [changed[c].alias(c) if c in changed else df["row"].getField(c).alias(c) for c in columns]


def add_columns(df: DataFrame, column: str, out: T.StructType, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """`df` with the fields of `out` computed from one column, batch by batch in Arrow.

    `make()` runs once per task and gives a function from the list of the column's values to one list per field. Fields replace
    columns of the same name.
    """
    names = {f.name.lower() for f in out.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + out.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            values = compute(b.column(column).to_pylist())
            arrays = [b.column(f.name) for f in kept]
            arrays += [pa.array(v, type=arrow.field(f.name).type) for v, f in zip(values, out.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(t.type) for a, t in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b) of one orderable type: (node, component), the smallest node of each group.

    Alternates large-star and small-star steps: both only group by a node and join the node's smallest neighbour back, so a hub is
    aggregated before it is shuffled and its rows can be split in the join. Each round cuts lineage with a checkpoint. The links are
    final when neither step changes them; only two numbers reach the driver per round.
    """
    pairs = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u != v").distinct()
    pairs = materialise(pairs)

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(both: DataFrame, large: bool) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    before = signature(pairs)
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True)
        pairs = materialise(star(large, False))
        after = signature(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
