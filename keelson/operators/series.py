"""Per-period series from resolved facts: instant, annual and discrete-quarter values, trailing twelve months.

Inputs are resolved rows (`keys` + item, start, end, val and, for ties, pref or rank). Groups are one item of one company
at one as-of date, so their size is bounded by the number of reporting periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUARTER_DAYS = (75, 105)
ANNUAL_DAYS = (340, 390)
NEAR_DAYS = 20
EPOCH = "1900-01-01"


def day_number(c: Column) -> Column:
    return F.datediff(c, F.lit(EPOCH).cast("date")).cast("long")


def duration() -> Column:
    return F.datediff("end", "start")


def is_annual() -> Column:
    return F.coalesce(duration().between(*ANNUAL_DAYS), F.lit(False))


def tie_key(rank: Column) -> Column:
    """Within one period end: best rank, then the earliest start (an instant, without start, counts as earliest)."""
    return ((F.lit(255) - rank).cast("long") * F.lit(1 << 20)
            + (F.lit(1 << 19) - F.coalesce(day_number(F.col("start")) + 1, F.lit(0))))


def _per_end(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    return rows.groupBy(*keys, "item", "end").agg(F.max_by("val", tie_key(rank)).alias("val"))


def instant_series(resolved: DataFrame, keys: list[str], rank: Column | None = None) -> DataFrame:
    return _per_end(resolved, keys, F.col("rank") if rank is None else rank)


def annual_series(resolved: DataFrame, keys: list[str], rank: Column | None = None) -> DataFrame:
    return _per_end(resolved.where(is_annual()), keys, F.col("rank") if rank is None else rank)


def quarterly_series(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Discrete quarters: reported directly, else the step between consecutive cumulative values sharing a start."""
    chain = W.partitionBy(*keys, "item", "start").orderBy("end")
    step_days = F.datediff("end", F.lag("end").over(chain))
    rows = (resolved.where(F.col("start").isNotNull())
            .withColumn("direct", F.when(duration().between(*QUARTER_DAYS), F.col("val")))
            .withColumn("derived", F.when(step_days.between(*QUARTER_DAYS), F.col("val") - F.lag("val").over(chain))))
    # direct beats derived; among equals the earliest start wins
    order = (F.lit(1 << 19) - day_number(F.col("start"))) + F.when(F.col("direct").isNotNull(), F.lit(1 << 20)).otherwise(0)
    value = F.coalesce("direct", "derived")
    per_end = (rows.where(value.isNotNull()).groupBy(*keys, "item", "end").agg(F.max_by(value, order).alias("val")))
    return drop_near_duplicates(per_end, keys)


def drop_near_duplicates(series: DataFrame, keys: list[str]) -> DataFrame:
    """52/53-week calendars: of two ends within 20 days keep the later."""
    nxt = F.lead("end").over(W.partitionBy(*keys, "item").orderBy("end"))
    return (series.withColumn("gap", F.datediff(nxt, "end"))
            .where(F.col("gap").isNull() | (F.col("gap") > NEAR_DAYS)).drop("gap"))


def with_rolling_year(quarters: DataFrame, keys: list[str]) -> DataFrame:
    """year_sum: the last four quarters' total where they span 240..300 days."""
    w = W.partitionBy(*keys, "item").orderBy("end")
    span = F.datediff("end", F.lag("end", 3).over(w))
    return quarters.withColumn(
        "year_sum", F.when(span.between(240, 300), F.lag("val", 3).over(w) + F.lag("val", 2).over(w)
                           + F.lag("val", 1).over(w) + F.col("val")))


def latest_value(val: Column, end: Column, on_or_before: Column, max_age: int | Column) -> Column:
    """Aggregate: value at the newest end <= on_or_before, NULL when that end is older than max_age days."""
    seen = F.when(end <= on_or_before, end)
    newest = F.max(seen)
    return F.when(F.datediff(F.max(on_or_before), newest) <= max_age, F.max_by(val, seen))


def near_value(val: Column, end: Column, target: Column, tolerance: int = 50) -> Column:
    """Aggregate: value at the newest end <= target + tolerance if that end is within the tolerance of the target."""
    seen = F.when(end <= F.date_add(target, tolerance), end)
    close = F.abs(F.datediff(F.max(seen), F.max(target))) <= tolerance
    return F.when(close, F.max_by(val, seen))


def regular_run(quarters: DataFrame, keys: list[str]) -> DataFrame:
    """Most recent run of consecutive quarters (gaps 75..105 days): gaps and islands, keep the last island."""
    w = W.partitionBy(*keys).orderBy("end")
    gap = F.datediff("end", F.lag("end").over(w))
    brk = F.coalesce(~gap.between(*QUARTER_DAYS), F.lit(False)).cast("int")
    runs = quarters.withColumn("run", F.sum(brk).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (runs.withColumn("last_run", F.max("run").over(W.partitionBy(*keys)))
            .where(F.col("run") == F.col("last_run")).drop("run", "last_run"))
