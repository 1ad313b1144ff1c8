"""Exact order statistics without a one-task sort.

Values are first folded to one row per distinct value, then cut into ranges of (keys, value) whose bounds Spark samples from the data, so
ranges hold about as many rows each however narrow or skewed the values are. Prefix sums run twice: over the range totals (a bounded number
of rows per key) and inside each range, so no task ever sorts a whole group. Quantiles, empirical CDFs, AUC, average precision, top-k
shares and ranks all follow from them. Any ordered type will do; infinities and NaN take their place in Spark's order (NaN last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.session import materialise


def bucket_of(value: Column) -> Column:
    """Monotone bucket number of a finite double, 256 per power of two; equal values always share a bucket."""
    magnitude = F.floor((F.log2(F.abs(value)) + 1100.0) * 256.0).cast("int") + 1
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * magnitude)


def prefix_sums(folded: DataFrame, keys: list[str], value: str, measures: list[str], descending: bool = False) -> DataFrame:
    """Add `<m>_before` (all values strictly ahead) and `<m>_total` (whole group) for each measure.

    `folded` must hold one row per (keys, value). It is stored once with the range of each row: two branches read it, and the sampled
    bounds must be the same for both.
    """
    direction = F.desc if descending else F.asc
    rows = materialise(folded.repartitionByRange(*keys, value).withColumn("_b", F.spark_partition_id()))
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(m).alias(m) for m in measures])
    everything = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ahead = everything.orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(m).over(everything).alias(f"{m}_total") for m in measures])
    joined = rows.join(offsets, [*keys, "_b"])
    inside = (W.partitionBy(*keys, "_b").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, -1))
    return joined.select(
        *folded.columns, *[f"{m}_total" for m in measures],
        *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before") for m in measures])


def fold(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """One row per distinct value with its count `n` (and further sums)."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], min_n: int = 1) -> DataFrame:
    """(keys, n, quantiles): exact quantiles with linear interpolation, as an array in the order of `probs`."""
    ranked = prefix_sums(fold(df, keys, value), keys, value, ["n"]).where(F.col("n_total") >= min_n)
    p = F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in probs) + ")")
    positions = F.transform(p, lambda x: x * (F.col("n_total") - 1))
    wanted = F.array_distinct(F.flatten(F.transform(positions, lambda x: F.array(F.floor(x), F.ceil(x)))))
    hits = F.filter(wanted, lambda i: (i >= F.col("n_before")) & (i < F.col("n_before") + F.col("n")))
    picked = ranked.withColumn("_i", F.explode(hits)).select(*keys, F.col("n_total").alias("n"), F.col(value).alias("_v"), "_i")
    grouped = picked.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    at = F.transform(p, lambda x: _interpolate(F.col("_m"), x * (F.col("n") - 1)))
    return grouped.select(*keys, "n", at.alias("quantiles"))


def _interpolate(order_stats: Column, position: Column) -> Column:
    lo = F.element_at(order_stats, F.floor(position))
    hi = F.element_at(order_stats, F.ceil(position))
    return lo + (hi - lo) * (position - F.floor(position))


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "v") -> DataFrame:
    """Wide to long, dropping NULLs."""
    pairs = ", ".join(f"'{c}', {c}" for c in values)
    return (df.select(*ids, *values)
            .selectExpr(*ids, f"stack({len(values)}, {pairs}) AS ({name}, {value})").where(F.col(value).isNotNull()))
