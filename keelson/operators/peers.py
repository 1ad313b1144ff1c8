"""Peer percentile tables and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.functions.numeric import clip, finite
from keelson.operators import pit, ranking, ratios
from keelson.operators.snapshot import snapshot

MIN_PEERS = 15
PROBS = [i / 100 for i in range(101)]
STALE_AFTER = 500
PEER_FEATURES = ratios.FEATURES


def peer_dataset(facts: DataFrame, companies: DataFrame, dates: DataFrame) -> DataFrame:
    """Features of every company at each date (one row per company and date with a balance sheet <= 500 days old)."""
    asofs = pit.asof_grid(companies, dates)
    snap = snapshot(facts, asofs, max_age=STALE_AFTER)
    feats = ratios.bank_features(ratios.compute_features(ratios.without_filing(snap)))
    meta = companies.select("cik", dims.sector_for_sic("sic").alias("sector"), dims.is_bank("sic").alias("bank"))
    out = feats.join(meta, "cik")
    bank_only = {c: F.when(F.col("bank"), F.col(c)) for c in ratios.BANK_FEATURES}
    return out.withColumns(bank_only).select("cik", "as_of", "period_end", "sector", "bank", *PEER_FEATURES, *ratios.BANK_FEATURES)


def peer_groups(sector: Column, bank: Column) -> Column:
    """Every company is in ALL and its sector; banks also form their own group."""
    return F.array_compact(F.array(F.lit("ALL"), sector, F.when(bank, F.lit("BANKS"))))


def peer_tables(feats: DataFrame, min_n: int = MIN_PEERS) -> DataFrame:
    """(as_of, group, feature, n, quantiles[101]) rounded to six places; bank features only inside BANKS."""
    long = ranking.melt(feats, ["as_of", "sector", "bank"], PEER_FEATURES + ratios.BANK_FEATURES)
    long = (long.withColumn("v", finite("v"))
            .select("as_of", F.explode(peer_groups(F.col("sector"), F.col("bank"))).alias("group"), "feature", "v")
            .where(~F.col("feature").isin(ratios.BANK_FEATURES) | (F.col("group") == "BANKS")))
    q = ranking.quantiles(long, ["as_of", "group", "feature"], "v", PROBS, min_n)
    return q.withColumn("quantiles", F.transform("quantiles", lambda x: F.bround(x, 6)))


def with_table_date(df: DataFrame, as_of: str, tables: DataFrame, pit_only: bool = False,
                    name: str = "table_date") -> DataFrame:
    """Newest table date on or before as_of, else the earliest one (NULL instead when pit_only).

    The dates are one array (one entry per table, not per row), read as a scalar subquery.
    """
    dates = tables.agg(F.array_sort(F.collect_set("as_of"))).scalar()
    newest = F.array_max(F.filter("_dates", lambda d: d <= F.col(as_of)))
    chosen = newest if pit_only else F.coalesce(newest, F.array_min("_dates"))
    return df.withColumn("_dates", dates).withColumn(name, chosen).drop("_dates")


def invert(quantiles: Column, value: Column) -> Column:
    """Share of peers below value: midpoint of the positions before and after it, clipped to [0, 1]."""
    below = F.size(F.filter(quantiles, lambda q: q < value))
    upto = F.size(F.filter(quantiles, lambda q: q <= value))
    return clip((below + upto) / 2.0 / (F.size(quantiles) - 1), 0.0, 1.0)


def percentiles(values: DataFrame, tables: DataFrame) -> DataFrame:
    """values: (..., table_date, own_group, feature, value). Looks in the own group first, then in ALL."""
    t = tables.select(F.col("as_of").alias("table_date"), F.col("group"), "feature", "n", "quantiles")
    own = t.select("table_date", F.col("group").alias("own_group"), "feature", F.col("n").alias("_n1"),
                   F.col("quantiles").alias("_q1"))
    market = t.where(F.col("group") == "ALL").select("table_date", "feature", F.col("n").alias("_n2"),
                                                     F.col("quantiles").alias("_q2"))
    joined = (values.join(own, ["table_date", "own_group", "feature"], "left")
              .join(market, ["table_date", "feature"], "left"))
    usable = F.col("value").isNotNull()
    return joined.select(
        *values.columns,
        F.when(usable, invert(F.coalesce("_q1", "_q2"), F.col("value"))).alias("pct"),
        F.when(usable & F.col("_q1").isNotNull(), F.col("own_group"))
        .when(usable & F.col("_q2").isNotNull(), F.lit("ALL")).alias("peer_group"),
        F.when(usable, F.coalesce("_n1", "_n2", F.lit(0))).otherwise(0).alias("peer_n"))
