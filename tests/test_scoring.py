"""Scoring invariants: attribution, renormalised weights, caps, bands, guard-rails."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson.operators import factors as fx
from keelson.operators import market, signals

AS_OF = dt.date(2025, 6, 30)


def feats(spark, **over):
    vals = {"altman_z2": 3.0, "piotroski_f": 7.0, "revenue_yoy": 0.1, "net_margin": 0.15, "current_ratio": 1.6, "debt_equity": 0.4, "fcf_margin": 0.12,
            "negative_equity": 0.0, "equity_assets": None, "securities_loss_equity": None, "deposit_growth": None, "loans_deposits": None, "bank_roa": None, **over}
    schema = "cik bigint, as_of date, sector string, bank boolean, " + ", ".join(f"{k} double" for k in vals)
    return spark.createDataFrame([(1, AS_OF, "Information Technology", False, *vals.values())], schema)


def tables(spark):
    keys = ["altman_z2", "revenue_yoy", "net_margin", "current_ratio", "debt_equity", "fcf_margin"]
    return spark.createDataFrame([(dt.date(2025, 1, 1), "ALL", k, 500, [i / 100 for i in range(101)]) for k in keys],
                                 "as_of date, `group` string, feature string, n bigint, quantiles array<double>")


def run(spark, events=(), freshness=1.0, **over):
    schema = "cik bigint, date date, type string, label string, penalty double, cap double"
    ev = spark.createDataFrame(list(events), schema)
    load = fx.event_load(ev, F.lit(AS_OF))
    base = feats(spark, **over)
    pen = fx.event_penalty(base, load)
    facs = fx.financial_factors(base, tables(spark)).unionByName(fx.events_factor(pen))
    fresh = spark.createDataFrame([(1, AS_OF, k, freshness if k == "financial" else 1.0) for k in fx.PILLARS], "cik bigint, as_of date, pillar string, freshness double")
    pillars = fx.pillar_scores(facs, fresh)
    return facs, pillars, fx.composite(pillars, pen)


def test_attribution_adds_up(spark):
    facs, pillars, health = run(spark)
    check = fx.attribution_check(fx.impacts(facs, pillars), health).first()
    assert check["gap"] <= 0.02


def test_missing_pillars_renormalise(spark):
    _, pillars, health = run(spark)
    total = fx.effective_weights(pillars).agg(F.sum("effective_weight")).first()[0]
    assert total == pytest.approx(1.0, abs=1e-3) and health.first()["confidence"] < 0.75


def test_bankruptcy_caps_the_score(spark):
    h = run(spark, [(1, dt.date(2025, 6, 1), "BANKRUPTCY", "Bankruptcy", 100.0, 10.0)])[2].first()
    assert h["score"] <= 10 and h["override"].startswith("capped")


def test_no_data_is_insufficient(spark):
    empty = {k: None for k in ("altman_z2", "piotroski_f", "revenue_yoy", "net_margin", "current_ratio", "debt_equity", "fcf_margin", "negative_equity")}
    h = run(spark, freshness=0.0, **empty)[2].first()
    assert h["score"] is None and h["band"] == "INSUFFICIENT_DATA"


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (85, 60, 45, 30, 10)], "s int").select(fx.health_band(F.col("s")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["STRONG", "STABLE", "WATCH", "WEAK", "CRITICAL"]


def test_distress_zone_guard_rail(spark):
    row = run(spark, altman_z2=0.5)[0].where("key = 'altman_z2'").first()
    assert row["score"] <= 20 and "distress zone" in row["note"]


def prices(spark, ticker, rate, n=80):
    first = dt.datetime(2025, 6, 27) - dt.timedelta(weeks=n - 1)
    return [(ticker, first + dt.timedelta(weeks=i), (1 + rate) ** i) for i in range(n)]


def test_weekly_returns_excess_and_staleness(spark):
    rows = prices(spark, "A", 0.01) + prices(spark, "ETF", 0.005)
    weekly = spark.createDataFrame(rows, "ticker string, bar timestamp, close double")
    daily = weekly.limit(0)
    asofs = spark.createDataFrame([("A", "ETF", AS_OF), ("A", "ETF", AS_OF + dt.timedelta(days=30))], "ticker string, benchmark string, as_of date")
    m = market.market_metrics(daily, weekly, asofs).collect()
    assert len(m) == 1
    assert m[0]["return_12m"] == pytest.approx(1.01 ** 52 - 1) and m[0]["drawdown_52w"] == pytest.approx(0)
    assert m[0]["excess_12m"] == pytest.approx((1.01 ** 52 - 1) - (1.005 ** 52 - 1))


def test_signals_are_ordered_by_severity_then_date(spark):
    rows = [(1, AS_OF, "A", "LOW", "Stat", None, "a"), (1, AS_OF, "B", "CRITICAL", "Rule", dt.date(2025, 1, 1), "b"), (1, AS_OF, "C", "HIGH", "Rule", dt.date(2025, 1, 1), "c"),
            (1, AS_OF, "D", "HIGH", "Rule", dt.date(2025, 3, 1), "d")]
    df = spark.createDataFrame(rows, "cik bigint, as_of date, code string, severity string, kind string, date date, message string")
    assert [r["code"] for r in signals.ordered(df).orderBy("position").collect()] == ["B", "D", "C", "A"]
