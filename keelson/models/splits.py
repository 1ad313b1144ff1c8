"""Deterministic splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import min_present


def time_split(df: DataFrame, year: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds `split` by inclusive year ranges; rows outside every range are dropped."""
    chain = None
    for name, (lo, hi) in ranges.items():
        hit = F.col(year).between(lo, hi)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return df.withColumn("split", chain).where("split is not null")


def forecast_split(rows: DataFrame, train_end: str, calib_end: str, test_end: str) -> DataFrame:
    """Split by target date, with the origin bounded too so no target leaks into a later model's inputs."""
    t, o = F.col("target_end"), F.col("origin")
    d = lambda x: F.lit(x).cast("date")
    split = (F.when(t <= d(train_end), "train").when((t <= d(calib_end)) & (o <= d(train_end)), "calib")
             .when((t > d(calib_end)) & (t <= d(test_end)) & (o <= d(calib_end)), "test"))
    return rows.withColumn("split", split).where("split is not null")


def hash_percent(key: Column) -> Column:
    """0..99 from the md5 of the key (same number in any engine)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def group_split(df: DataFrame, key: str, train: int = 70, validation: int = 15) -> DataFrame:
    """70/15/15 by group, so no group is in two splits."""
    p = hash_percent(F.col(key))
    return df.withColumn("split", F.when(p < train, "train").when(p < train + validation, "validation").otherwise("test"))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows with the smallest keyed hash: a seeded sample without replacement (top-n per partition, then merged)."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(order, key).limit(n)


def cross_section(df: DataFrame, year: int, features: list[str], k: int = 6) -> DataFrame:
    """Latest row per company within a year, with at least k features known."""
    rest = [c for c in df.columns if c != "cik"]
    last = (df.where(F.year("as_of") == year).groupBy("cik").agg(F.max_by(F.struct(*rest), F.struct("as_of", "accn")).alias("r"))
            .select("cik", "r.*"))
    return min_present(last, features, k)
