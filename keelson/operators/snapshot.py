"""Snapshot: balance-sheet and trailing-twelve-month values known at an as-of date, and one year earlier.

Facts become states (`pit.states`): one row per period and knowledge date, all items side by side. The as-of side first learns its
period end from TotalAssets alone; with it, every window a formula reads is known: balances and annual flows take the rows at two ends,
quarters the rows within REACH days (three items keep their whole history, as their last quarters are taken at any age). All joins are on
the company, so one shuffle of states and as-of dates serves them all, in as many tasks as the as-of dates ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.functions.numeric import let, mean_of, theil_sen
from keelson.operators import pit, series

KEYS = ["cik", "as_of"]
ASOFS_PER_TASK = 10_000
NEAR = 50              # days a flow's end may lie from its target
REACH = 840            # 365 + 50 tolerance + 300 span + 105 derivation step + 20 near-duplicate gap
AHEAD = 75
STOCK_TOLERANCE = 45
FLOAT_TOLERANCE = 400
WHOLE_HISTORY = ["Revenue", "OperatingCashFlow", "CapEx"]


def period_ends(totals: DataFrame, probes: DataFrame, max_age: int | None) -> DataFrame:
    """Newest TotalAssets end on or before each as-of date among the facts filed by then. totals: (cik, end, filed)."""
    first = totals.groupBy("cik", "end").agg(F.min("filed").alias("filed"))
    found = (F.col("filed") <= F.col("as_of")) & (F.col("end") <= F.col("as_of"))
    if max_age is not None:
        found = found & (F.datediff("as_of", "end") <= max_age)
    return probes.join(first, "cik").where(found).groupBy(*KEYS).agg(F.max("end").alias("period_end"))


def snapshot(facts: DataFrame, asofs: DataFrame, max_age: int | None = None) -> DataFrame:
    """One wide row per (cik, as_of) with period_end, v_<Item>, p_<Item>, recent quarters and their trends.

    max_age drops as-of dates whose newest balance sheet is older.
    """
    facts = pit.sane_dates(facts)
    tasks = pit.tasks_for(asofs, ASOFS_PER_TASK) | 1               # odd, other than that of the facts: the shuffle of their states is kept
    probes = pit.spread(asofs.select(*KEYS).distinct(), "cik", tasks=tasks)
    stocks = pit.states(facts, dims.STOCK_ITEMS, tasks)
    flows = pit.states(facts, dims.FLOW_ITEMS, tasks)
    located = period_ends(stocks.where(F.col("f_TotalAssets").isNotNull()), probes, max_age)

    # a shuffle behind each part makes it a stage of its own: one task's memory is that of one part, and located is computed once
    merged = located = pit.spread(located, *KEYS, tasks=tasks)
    for part in (balances(stocks, located), annual_flows(flows, located), quarter_flows(flows, located)):
        merged = merged.unionByName(pit.spread(part, *KEYS, tasks=tasks), allowMissingColumns=True)
    last = lambda c: F.max(c)  # noqa: E731                          # one row at most has it
    cols = []
    for side in ("v", "p"):
        cols += [F.coalesce(last(f"{side}a_{i}"), last(f"{side}q_{i}")).alias(f"{side}_{i}") for i in dims.FLOW_ITEMS]
        cols += [last(f"{side}_{i}").alias(f"{side}_{i}") for i in dims.STOCK_ITEMS]
    cols += [F.first(f"q_{i}", ignorenulls=True).alias(f"q_{i}") for i in WHOLE_HISTORY]
    order = [f"{s}_{i}" for i in dims.FLOW_ITEMS + dims.STOCK_ITEMS for s in "vp"] + [f"q_{i}" for i in WHOLE_HISTORY]
    return fill_derived(merged.groupBy(*KEYS, "period_end").agg(*cols).select(*KEYS, "period_end", *order))


def newest(item: str, last_day: Column, days: int) -> Column:
    """Aggregate: value at the newest end in the `days` days up to last_day; within one end, by rank and start (`series.tie_key`)."""
    key = F.shiftleft(series.day_number(F.col("end")), 28) + series.tie_key(pit.rank_of(F.col(f"f_{item}")))
    inside = F.col("end").between(F.date_sub(last_day, days), last_day) & F.col(f"f_{item}").isNotNull()
    return F.max_by(f"v_{item}", F.when(inside, key))


def balances(stocks: DataFrame, located: DataFrame) -> DataFrame:
    """Newest balance at most a tolerance before the period end (and before the day a year earlier)."""
    pe = F.col("period_end")
    tolerance = {i: FLOAT_TOLERANCE if i == "PublicFloat" else STOCK_TOLERANCE for i in dims.STOCK_ITEMS}
    sides = {"v": F.date_add(pe, 5), "p": F.date_add(F.date_sub(pe, 365), 5)}
    wanted = F.lit(False)
    for day in sides.values():
        for days in sorted(set(tolerance.values())):
            there = F.lit(False)
            for i in (i for i in dims.STOCK_ITEMS if tolerance[i] == days):
                there = there | F.col(f"f_{i}").isNotNull()
            wanted = wanted | (F.col("end").between(F.date_sub(day, days), day) & there)
    rows = located.join(stocks, "cik").where(pit.known_at() & wanted)
    return rows.groupBy(*KEYS, "period_end").agg(
        *[newest(i, day, tolerance[i]).alias(f"{s}_{i}") for s, day in sides.items() for i in dims.STOCK_ITEMS])


def annual_flows(flows: DataFrame, located: DataFrame) -> DataFrame:
    """Reported annual values whose end lies near the period end (and near the day a year earlier)."""
    pe = F.col("period_end")
    sides = {"va": F.date_add(pe, NEAR), "pa": F.date_add(F.date_sub(pe, 365), NEAR)}
    wanted = F.lit(False)
    for day in sides.values():
        wanted = wanted | F.col("end").between(F.date_sub(day, 2 * NEAR), day)
    rows = located.join(flows.where(series.is_annual()), "cik").where(pit.known_at() & wanted)
    return rows.groupBy(*KEYS, "period_end").agg(
        *[newest(i, day, 2 * NEAR).alias(f"{s}_{i}") for s, day in sides.items() for i in dims.FLOW_ITEMS])


def quarter_flows(flows: DataFrame, located: DataFrame) -> DataFrame:
    """Sums of the four quarters that end near the period end (and a year earlier), and the quarters of three items.

    The rules are those of `series.quarterly_series` and `with_rolling_year`, here for all items of a row side by side.
    """
    items, pe, end = dims.FLOW_ITEMS, F.col("period_end"), F.col("end")
    keys = [*KEYS, "period_end"]
    values = [F.col(f"v_{i}") for i in items]
    slim = flows.where(F.col("start").isNotNull()).select("cik", "start", "end", "filed", "until", *values)
    near = (end <= F.date_add(pe, AHEAD)) & (end >= F.date_sub(pe, REACH))
    read = [F.col(f"v_{i}") if i in WHOLE_HISTORY else F.when(near, F.col(f"v_{i}")).alias(f"v_{i}") for i in items]
    pairs = (located.join(slim, "cik").where(pit.known_at()).select(*keys, "start", "end", *read)
             .where(F.coalesce(*values).isNotNull()))

    before = W.partitionBy(*keys, "start").orderBy("end").rowsBetween(W.unboundedPreceding, -1)
    direct = series.duration().between(*series.QUARTER_DAYS)
    cols = {}
    for i in items:
        v = F.col(f"v_{i}")
        step = F.datediff(end, F.last(F.when(v.isNotNull(), end), ignorenulls=True).over(before))
        gain = F.when(step.between(*series.QUARTER_DAYS), v - F.last(v, ignorenulls=True).over(before))
        cols[f"v_{i}"] = F.when(direct & v.isNotNull(), v).otherwise(gain)
    order = F.lit(1 << 19) - series.day_number(F.col("start")) + F.when(direct, F.lit(1 << 20)).otherwise(0)
    per_end = (pairs.select(*keys, "start", "end", *[c.alias(n) for n, c in cols.items()])
               .groupBy(*keys, "end").agg(*[F.max_by(f"v_{i}", F.when(F.col(f"v_{i}").isNotNull(), order)).alias(f"v_{i}") for i in items]))

    rows = per_end.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("end", *[f"v_{i}" for i in items]))).alias("rows"))
    rows = rows.withColumn("recent", F.filter("rows", lambda r: r["end"] >= F.date_sub("period_end", REACH)))
    one = lambda source, i: F.filter(
        F.transform(source, lambda r: F.struct(r["end"].alias("end"), r[f"v_{i}"].alias("val"))), lambda r: r["val"].isNotNull())
    rows = rows.select(*keys, *[one("recent", i).alias(f"r_{i}") for i in items], *[one("rows", i).alias(f"q_{i}") for i in WHOLE_HISTORY])
    rows = rows.select(*keys, *[spaced(f"{s}_{i}").alias(f"{s}_{i}") for s, names in (("r", items), ("q", WHOLE_HISTORY)) for i in names])
    return rows.select(*keys, *[year_sum(f"r_{i}", day).alias(f"{s}_{i}") for s, day in (("vq", pe), ("pq", F.date_sub(pe, 365))) for i in items],
                       *[F.when(F.size(f"q_{i}") > 0, F.col(f"q_{i}")).alias(f"q_{i}") for i in WHOLE_HISTORY])


def spaced(quarters: str) -> Column:
    """`series.drop_near_duplicates` on a sorted array of (end, val)."""
    following = lambda k: F.get(quarters, k + 1)["end"]
    return F.filter(quarters, lambda q, k: F.coalesce(F.datediff(following(k), q["end"]) > series.NEAR_DAYS, F.lit(True)))


def year_sum(quarters: str, target: Column) -> Column:
    """Total of the last four quarters where they span a year and the newest end <= target + NEAR lies within NEAR days of the target."""
    def total(qs):
        at = lambda k: F.get(qs, F.size(qs) - k)
        newest_end = at(1)["end"]
        fits = (F.size(qs) >= 4) & (F.abs(F.datediff(newest_end, target)) <= NEAR) & F.datediff(newest_end, at(4)["end"]).between(240, 300)
        return F.when(fits, at(4)["val"] + at(3)["val"] + at(2)["val"] + at(1)["val"])

    return let(F.filter(quarters, lambda q: q["end"] <= F.date_add(target, NEAR)), total)


def fill_derived(df: DataFrame) -> DataFrame:
    """Liabilities from the balance identity, gross profit from revenue less cost, where not reported."""
    fills = {}
    for side in ("v", "p"):
        fills[f"{side}_TotalLiabilities"] = F.coalesce(
            f"{side}_TotalLiabilities", F.col(f"{side}_LiabilitiesAndEquity") - F.col(f"{side}_StockholdersEquity"))
        fills[f"{side}_GrossProfit"] = F.coalesce(
            f"{side}_GrossProfit", F.col(f"{side}_Revenue") - F.col(f"{side}_CostOfRevenue"))
    return df.withColumns(fills)


def negative_cash_quarters():
    """Of the last four operating-cash quarters, how many are negative after capex (missing capex = 0)."""
    ocf = F.slice(F.reverse("q_OperatingCashFlow"), 1, 4)
    entries = F.coalesce(F.col("q_CapEx"), F.expr("array()").cast("array<struct<end:date,val:double>>"))
    count = let(F.map_from_entries(entries), lambda capex: F.size(F.filter(
        ocf, lambda o: o["val"] - F.coalesce(F.try_element_at(capex, o["end"]), F.lit(0.0)) < 0)))
    return F.when(F.size("q_OperatingCashFlow") >= 4, count.cast("double"))


def revenue_slope():
    """Theil-Sen slope of the last eight revenue quarters, relative to their mean size."""
    last8 = F.reverse(F.slice(F.reverse("q_Revenue"), 1, 8))
    scaled = let(F.transform(last8, lambda o: o["val"]), lambda v: F.try_divide(
        theil_sen(v), F.nullif(mean_of(F.transform(v, lambda x: F.abs(x))), F.lit(0.0))))
    return F.when(F.size("q_Revenue") >= 4, scaled)
