"""Hand-computed point-in-time cases on a tiny fact set."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson.operators import pit, ratios, series
from keelson.operators.snapshot import snapshot

SCHEMA = "cik bigint, item string, rank tinyint, start date, end date, val double, filed date, accn string"
D = dt.date.fromisoformat


def fact(item, end, val, filed, start=None, rank=0, cik=1):
    return (cik, item, rank, D(start) if start else None, D(end), float(val), D(filed), f"{item}-{filed}")


def base():
    rows = []
    for item, now, before in [("TotalAssets", 1000, 900), ("TotalLiabilities", 600, 500), ("StockholdersEquity", 400, 400),
                              ("CurrentAssets", 300, 280), ("CurrentLiabilities", 200, 140)]:
        rows += [fact(item, "2023-12-31", now, "2024-02-15"), fact(item, "2022-12-31", before, "2023-02-15")]
    rows.append(fact("RetainedEarnings", "2023-12-31", 250, "2024-02-15"))
    for item, now, before in [("Revenue", 1200, 1000), ("NetIncome", 120, 80)]:
        rows += [fact(item, "2023-12-31", now, "2024-02-15", "2023-01-01"), fact(item, "2022-12-31", before, "2023-02-15", "2022-01-01")]
    rows.append(fact("OperatingIncome", "2023-12-31", 150, "2024-02-15", "2023-01-01"))
    for end, val, filed in [("2023-03-31", 30, "2023-05-01"), ("2023-06-30", 70, "2023-08-01"), ("2023-09-30", 100, "2023-11-01"),
                            ("2023-12-31", 160, "2024-02-15")]:
        rows.append(fact("OperatingCashFlow", end, val, filed, "2023-01-01"))
    return rows


def features(spark, rows, *days):
    facts = spark.createDataFrame(rows, SCHEMA)
    asofs = spark.createDataFrame([(1, D(d)) for d in days], "cik bigint, as_of date")
    out = ratios.compute_features(ratios.without_filing(snapshot(facts, asofs)))
    return {r["as_of"].isoformat(): r for r in out.collect()}


def test_ratios(spark):
    r = features(spark, base(), "2024-03-01")["2024-03-01"]
    assert r["period_end"] == D("2023-12-31")
    assert r["net_margin"] == pytest.approx(0.1) and r["current_ratio"] == pytest.approx(1.5)
    assert r["liabilities_assets"] == pytest.approx(0.6) and r["revenue_yoy"] == pytest.approx(0.2)
    assert r["d_current_ratio"] == pytest.approx(-0.5)
    assert r["altman_z2"] == pytest.approx(6.56 * 0.1 + 3.26 * 0.25 + 6.72 * 0.15 + 1.05 * (400 / 600))


def test_quarters_from_cumulative(spark):
    known = pit.known_as_of(spark.createDataFrame(base(), SCHEMA), spark.createDataFrame([(1, D("2024-03-01"))], "cik bigint, as_of date"))
    q = series.quarterly_series(known.where("item = 'OperatingCashFlow'"), ["cik", "as_of"]).orderBy("end").collect()
    assert [r["val"] for r in q] == [30, 40, 30, 60]


def test_no_look_ahead(spark):
    r = features(spark, base(), "2024-01-31")["2024-01-31"]
    assert r["period_end"] == D("2022-12-31") and r["net_margin"] == pytest.approx(0.08)


def test_restated_value_counts_only_after_its_filing(spark):
    r = features(spark, base() + [fact("NetIncome", "2023-12-31", 60, "2024-06-01", "2023-01-01")], "2024-03-01", "2024-07-01")
    assert r["2024-03-01"]["net_margin"] == pytest.approx(0.10) and r["2024-07-01"]["net_margin"] == pytest.approx(0.05)


def test_missing_is_null_not_zero(spark):
    r = features(spark, [fact("TotalAssets", "2023-12-31", 1000, "2024-01-15")], "2024-02-01")["2024-02-01"]
    assert r["period_end"] == D("2023-12-31") and r["net_margin"] is None and r["altman_z2"] is None


def test_later_facts_never_change_an_earlier_row(spark):
    later = [fact("Revenue", "2023-12-31", 5, "2024-09-01", "2023-01-01"), fact("TotalAssets", "2024-03-31", 7, "2024-09-01")]
    a, b = (features(spark, rows, "2024-03-01")["2024-03-01"] for rows in (base(), base() + later))
    assert a == b


def test_value_that_returns_keeps_its_first_filing(spark):
    rows = [fact("TotalAssets", "2023-12-31", v, f) for v, f in [(10, "2024-01-01"), (12, "2024-02-01"), (10, "2024-03-01")]]
    facts = pit.first_filed(spark.createDataFrame(rows, SCHEMA))
    known = pit.known_as_of(facts, spark.createDataFrame([(1, D("2024-06-01"))], "cik bigint, as_of date")).first()
    assert facts.count() == 2 and known["val"] == 12


def test_better_tag_rank_beats_a_later_filing(spark):
    rows = [fact("Revenue", "2023-12-31", 100, "2024-02-01", "2023-01-01"), fact("Revenue", "2023-12-31", 90, "2024-05-01", "2023-01-01", rank=1)]
    known = pit.known_as_of(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, D("2024-06-01"))], "cik bigint, as_of date")).first()
    assert known["val"] == 100 and known["rank"] == 0 and known["filed"] == D("2024-02-01")


def test_age_limit_gives_the_same_rows_as_a_later_filter(spark):
    facts = spark.createDataFrame(base(), SCHEMA)
    days = [(1, D(d)) for d in ("2023-03-01", "2024-01-31", "2024-03-01", "2025-06-01")]
    asofs = spark.createDataFrame(days, "cik bigint, as_of date")
    cut = {(r["as_of"], r["v_Revenue"], r["p_TotalAssets"]) for r in snapshot(facts, asofs, max_age=400).collect()}
    full = {(r["as_of"], r["v_Revenue"], r["p_TotalAssets"]) for r in snapshot(facts, asofs).where(F.datediff("as_of", "period_end") <= 400).collect()}
    assert cut == full and len(cut) == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_not_shuffled_one_by_one(spark, tmp_path):
    """Quarters are spread by company; the facts made from them meet no shuffle on (company, item, ...) (F13 to F30)."""
    from keelson.plans import views
    facts = views.facts(spark, "/root/testdata/sf0.001")
    assert not [line for line in plan_of(facts).splitlines() if "Exchange" in line and "item#" in line]
    snap = snapshot(facts, spark.createDataFrame([(1, D("2000-06-30"))], "cik bigint, as_of date"))
    assert not [line for line in plan_of(snap).splitlines() if "Exchange" in line and "item#" in line]


def test_tasks_grow_with_the_rows(spark):
    assert pit.tasks_for(spark.range(1000), 100) == 10 and pit.tasks_for(spark.range(10), 100) == 4


def test_states_give_the_resolved_values(spark):
    """Side-by-side states equal the resolution of every fact on its own, on facts with ties, odd dates and several tags."""
    import random
    rnd = random.Random(3)
    rows = []
    for _ in range(600):
        end = D("2020-03-31") + dt.timedelta(days=91 * rnd.randint(0, 9) + rnd.choice([0, 0, 1, -12]))
        start = rnd.choice([None, end - dt.timedelta(days=90), D(f"{end.year}-01-01")])
        rows.append(fact(rnd.choice(["Revenue", "CapEx", "Cash"]), end.isoformat(), float(rnd.randint(0, 50)),
                         (end + dt.timedelta(days=rnd.choice([-5, 30, 30, 200]))).isoformat(), start and start.isoformat(), rank=rnd.choice([0, 0, 1])))
    facts = spark.createDataFrame(rows, SCHEMA)
    asofs = spark.createDataFrame([(1, D("2020-01-01") + dt.timedelta(days=rnd.randint(0, 1200))) for _ in range(40)], "cik bigint, as_of date").distinct()
    known = pit.known_as_of(facts, asofs).where("item in ('Revenue', 'Cash')")
    expected = {(r["as_of"], r["item"], r["start"], r["end"], r["val"], r["rank"], r["filed"]) for r in known.collect()}
    pairs = pit.states(facts, ["Revenue", "Cash"], 3).join(asofs, "cik").where(pit.known_at())
    found = set()
    for i in ("Revenue", "Cash"):
        got = pairs.where(F.col(f"f_{i}").isNotNull()).select("as_of", "start", "end", F.col(f"v_{i}").alias("v"), pit.rank_of(F.col(f"f_{i}")).alias("r"),
                                                              pit.filed_of(F.col(f"f_{i}")).alias("k"))
        found |= {(r["as_of"], i, r["start"], r["end"], r["v"], r["r"], r["k"]) for r in got.collect()}
    assert found == expected and len(expected) > 500
