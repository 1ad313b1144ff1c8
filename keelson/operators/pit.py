"""Bitemporal fact resolution.

A fact has a period (start, end) and a knowledge date (filed). A company's rows are bounded by the calendar once
(a) repeated reports of one value are folded to their first filing and (b) as-of dates are made distinct; both happen
with partial aggregation before any shuffle on the company. Joins carry the as-of year next to the company, so a
company holding a large share of all rows is spread over its years, and every later aggregation groups by
(cik, yr, ...) and reuses that partitioning.

Where many items are read at once (snapshots), a period's versions are laid out as columns instead (`states`): one row per period and
knowledge date with what was known from then until the next one, so an as-of date meets one row per period, not one per item and version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERIOD = ["cik", "item", "start", "end"]
FACT_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "10-KT", "10-KT/A"]
DATE_LO, DATE_HI = "1990-01-01", "2100-01-01"


def sane_dates(facts: DataFrame) -> DataFrame:
    """Drop typo'd dates: end and filed must lie in the plausible range, start may also be missing."""
    lo, hi = F.lit(DATE_LO).cast("date"), F.lit(DATE_HI).cast("date")
    return facts.where(F.col("end").between(lo, hi) & F.col("filed").between(lo, hi)
                       & (F.col("start").isNull() | F.col("start").between(lo, hi)))


def fact_filter(facts: DataFrame, min_filed: str = "2009-01-01") -> DataFrame:
    return facts.where(F.col("form").isin(FACT_FORMS) & (F.col("filed") >= F.lit(min_filed).cast("date")))


def first_filed(facts: DataFrame, with_accn: bool = True) -> DataFrame:
    """One row per distinct reported value of a period and tag rank, with its first filing.

    Without the accession number the buffer is fixed-width, which keeps the aggregation hash-based.
    """
    keys = ["cik", "item", "rank", "start", "end", "val"]
    if not with_accn:
        return facts.groupBy(*keys).agg(F.min("filed").alias("filed"))
    return (facts.groupBy(*keys).agg(F.min(F.struct("filed", "accn")).alias("f"))
            .select(*keys, "f.filed", "f.accn"))


def versions(facts: DataFrame) -> DataFrame:
    """One value per period, tag rank and knowledge date (the larger one, should a day carry two)."""
    return facts.groupBy(*PERIOD, "rank", "filed").agg(F.max("val").alias("val"))


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Hash-partition by the keys into `tasks` (the session's shuffle partitions), exempt from runtime coalescing: the join that
    follows multiplies rows, so partition sizes measured before it would be misleading."""
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that hold about `rows` rows of df each, at least the session's shuffle partitions: a task's memory stays the same as tables grow."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def preference(rank: Column, filed: Column) -> Column:
    """Sortable number: better (lower) rank first, then the later filing."""
    return ((F.lit(255) - rank).cast("long") * F.lit(1 << 20)
            + F.datediff(filed, F.lit("1900-01-01").cast("date")).cast("long"))


def with_years(facts: DataFrame, years: Column, reach_days: Column | None = None) -> DataFrame:
    """Repeat a fact for each as-of year it can matter in: from its filing on, up to its reach where one is given."""
    last = F.lit(9999) if reach_days is None else F.coalesce(F.year(F.date_add(F.col("end"), reach_days)), F.lit(9999))
    return (facts.withColumns({"_years": years, "_last": last})
            .withColumn("yr", F.explode(F.filter("_years", lambda y: (y >= F.year("filed")) & (y <= F.col("_last")))))
            .drop("_years", "_last"))


def asof_dates(asofs: DataFrame) -> DataFrame:
    """Distinct (cik, as_of) with the as-of year used for partitioning."""
    return asofs.select("cik", "as_of").distinct().withColumn("yr", F.year("as_of"))


def years_of(asofs: DataFrame) -> Column:
    """Distinct as-of years as one array (scalar subquery: a handful of numbers, no join)."""
    return asofs.agg(F.array_sort(F.collect_set(F.year("as_of")))).scalar()


def resolve(pairs: DataFrame, *keys: str) -> DataFrame:
    """Fold the versions known at an as-of date to one value per period: best rank, then latest filing."""
    pref = preference(F.col("rank"), F.col("filed"))
    return pairs.groupBy(*keys, "item", "start", "end").agg(
        F.max_by("val", pref).alias("val"), F.max(pref).alias("pref"))


def states(facts: DataFrame, items: list[str], tasks: int) -> DataFrame:
    """(cik, start, end, filed, until, v_<item>, f_<item>): the items' values of a period as known from `filed` until before `until`
    (NULL: to the end), with the preference of the version they come from (NULL: none yet). Spread by company.
    """
    item, one = F.col("item"), F.lit(1).cast("long")
    bit = F.coalesce(*[F.when(item == i, F.lit(1 << k).cast("long")) for k, i in enumerate(items)])
    wide = (facts.where(item.isin(items)).groupBy("cik", "start", "end", "rank", "filed")
            .agg(F.bit_or(bit).alias("has"), *[F.max(F.when(item == i, F.col("val"))).alias(f"v_{i}") for i in items]))
    days = W.partitionBy("cik", "start", "end").orderBy("filed", "rank")
    known = days.rowsBetween(W.unboundedPreceding, 0)
    pref = preference(F.col("rank"), F.col("filed"))
    cols = [F.lead("filed").over(days).alias("until")]
    for k, i in enumerate(items):
        mine = F.when(F.shiftright("has", k).bitwiseAND(one) == 1, pref)
        cols += [F.max_by(f"v_{i}", mine).over(known).alias(f"v_{i}"), F.max(mine).over(known).alias(f"f_{i}")]
    return (spread(wide, "cik", tasks=tasks).select("cik", "start", "end", "filed", *cols)
            .where(F.col("until").isNull() | (F.col("filed") < F.col("until"))))


def known_at(as_of: str = "as_of") -> Column:
    """Condition on a state and an as-of date: the state was the current one."""
    return (F.col("filed") <= F.col(as_of)) & (F.col("until").isNull() | (F.col(as_of) < F.col("until")))


def rank_of(pref: Column) -> Column:
    return (F.lit(255) - F.shiftright(pref, 20)).cast("int")


def filed_of(pref: Column) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), pref.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))


def known_as_of(facts: DataFrame, asofs: DataFrame) -> DataFrame:
    """Facts public at each (cik, as_of), one value per (item, start, end)."""
    probes = asof_dates(asofs)
    known = spread(with_years(versions(sane_dates(facts)), years_of(asofs)), "cik", "yr")
    pairs = known.join(spread(probes, "cik", "yr"), ["cik", "yr"]).where(F.col("filed") <= F.col("as_of"))
    return (resolve(pairs, "cik", "yr", "as_of")
            .select("cik", "as_of", "item", "start", "end", rank_of(F.col("pref")).alias("rank"),
                    filed_of(F.col("pref")).alias("filed"), "val"))


def asof_grid(companies: DataFrame, dates: DataFrame) -> DataFrame:
    """A short list of as-of dates for every company. The list is data (one column `as_of`), never one row per fact;
    it is folded into one array and exploded per company, so no join is needed."""
    days = dates.agg(F.array_sort(F.collect_set("as_of"))).scalar()
    return companies.select("cik", F.explode(days).alias("as_of"))
