"""Factor scores, pillars and the composite health score. One row per (cik, as_of, pillar, key) until pillars fold them.

Parts are rounded half-even where they are stored (factor and pillar scores 2 places, effective weights and impacts 4), so
50 + sum(impact) reproduces the raw score to about 0.01. Sums run over integer counts of the last stored place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.numeric import clip
from keelson.operators import peers

# ---- fixed values: pillar weights, factor weights and directions ---------------------------------------------
PILLARS = {"financial": 0.30, "market": 0.20, "news": 0.20, "workforce": 0.15, "events": 0.15}
PILLAR_LABELS = {"financial": "Financial stability", "market": "Market behaviour", "news": "News sentiment",
                 "workforce": "Workforce", "events": "Events & governance"}
GENERAL_FACTORS = [
    ("altman_z2", "Altman Z''-score", 0.20, True, "num"), ("piotroski_f", "Piotroski F-score", 0.15, True, "nine"),
    ("revenue_yoy", "Revenue growth (YoY, TTM)", 0.15, True, "pct"), ("net_margin", "Net margin (TTM)", 0.15, True, "pct"),
    ("current_ratio", "Current ratio", 0.10, True, "times"),
    ("debt_equity", "Long-term debt / equity", 0.10, False, "times"),
    ("fcf_margin", "Free-cash-flow margin (TTM)", 0.15, True, "pct")]
BANK_FACTORS = [
    ("equity_assets", "Equity / total assets", 0.25, True, "pct"),
    ("securities_loss_equity", "Unrealised securities loss / equity", 0.25, False, "pct"),
    ("deposit_growth", "Deposit growth (YoY)", 0.15, True, "pct"),
    ("loans_deposits", "Loans / deposits", 0.10, False, "times"),
    ("bank_roa", "Return on assets (TTM)", 0.15, True, "pct")]
BANDS = [(70, "STRONG"), (55, "STABLE"), (40, "WATCH"), (25, "WEAK")]
MIN_CONFIDENCE = 0.40
DECAY = 180.0
FACTOR_COLUMNS = ["cik", "as_of", "pillar", "key", "label", "kind", "weight", "value", "score", "pct", "peer_group", "note"]


def display_value(value: Column, fmt: Column) -> Column:
    def shown(pattern, scale, places):
        return F.format_string(pattern, F.rint(value * scale * 10 ** places) / 10 ** places)   # half-even, like the stored text

    return (F.when(value.isNull(), None).when(fmt == "pct", shown("%.1f%%", 100, 1)).when(fmt == "times", shown("%.2fx", 1, 2))
            .when(fmt == "nine", shown("%.0f/9", 1, 0)).when(fmt == "signed", shown("%+.2f", 1, 2)).otherwise(shown("%.2f", 1, 2)))


def health_band(score: Column) -> Column:
    out = F.when(score.isNull(), "INSUFFICIENT_DATA")
    for limit, name in BANDS:
        out = out.when(score >= limit, name)
    return out.otherwise("CRITICAL")


def risk_band(p: Column) -> Column:
    return F.when(p < 0.01, "LOW").when(p < 0.03, "MODERATE").when(p < 0.10, "ELEVATED").when(p.isNotNull(), "HIGH")


def confidence_text(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.55, "moderate").otherwise("low")


def filing_freshness(as_of: Column, period_end: Column) -> Column:
    months = F.datediff(as_of, period_end) / 30.4
    return F.when(period_end.isNull(), 0.0).when(months <= 15, 1.0).when(months <= 24, 0.5).otherwise(0.25)


def review_freshness(as_of: Column, quarter_end: Column) -> Column:
    years = F.datediff(as_of, quarter_end) / 365.25
    return clip(1.0 - 0.2 * F.greatest(F.lit(0.0), years - 1), 0.2, 1.0)


def _emit(df: DataFrame, pillar: str, rows: list[dict]) -> DataFrame:
    """One output row per factor description; absent fields are NULL."""
    def field(r, name, kind):
        v = r.get(name)
        v = F.lit(v) if not isinstance(v, Column) else v
        return v.cast(kind).alias(name)

    structs = [F.struct(*[field(r, n, "double" if n in ("weight", "value", "score", "pct") else "string")
                          for n in FACTOR_COLUMNS[3:]]) for r in rows]
    return df.select("cik", "as_of", F.lit(pillar).alias("pillar"), F.inline(F.array(*structs)))


def factor_values(feats: DataFrame) -> DataFrame:
    """(cik, as_of, table_date, own_group, key, label, weight, higher, fmt, value): the bank or the general factor set of a company."""
    def specs(rows):
        return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(lab).alias("label"), F.lit(w).alias("weight"),
                                  F.lit(hi).alias("higher"), F.lit(fmt).alias("fmt"), F.col(k).alias("value"))
                         for k, lab, w, hi, fmt in rows])

    chosen = F.when(F.col("bank"), specs(BANK_FACTORS)).otherwise(specs(GENERAL_FACTORS))
    return feats.select("cik", "as_of", "table_date", F.when(F.col("bank"), "BANKS").otherwise(F.col("sector")).alias("own_group"),
                        "negative_equity", F.inline(chosen))


def guarded_score(key: Column, value: Column, score: Column, negative_equity: Column) -> Column:
    """Guard-rails: a missing percentile takes the cap."""
    def cap(limit):
        return F.least(F.coalesce(score, F.lit(float(limit))), F.lit(float(limit)))

    return (F.when((key == "piotroski_f") & value.isNotNull(), value / 9 * 100)
            .when((key == "altman_z2") & (value < 1.1), cap(20)).when((key == "current_ratio") & (value < 1.0), cap(30))
            .when((key == "debt_equity") & (negative_equity == 1.0), F.lit(0.0))
            .when((key == "securities_loss_equity") & (value > 0.5), cap(15))
            .when((key == "deposit_growth") & (value < -0.10), cap(30)).otherwise(score))


def guard_note(key: Column, value: Column, score: Column, negative_equity: Column) -> Column:
    return (F.when((key == "altman_z2") & (value < 1.1), "distress zone (Z'' < 1.1): capped at 20")
            .when((key == "current_ratio") & (value < 1.0), "below 1.0: capped at 30")
            .when((key == "debt_equity") & (negative_equity == 1.0), "negative shareholders' equity")
            .when((key == "securities_loss_equity") & (value > 0.5), "unrealised losses exceed 50% of equity: capped at 15")
            .when((key == "deposit_growth") & (value < -0.10), "deposits fell more than 10%: capped at 30")
            .when(score.isNull(), "not computable from filed data"))


def financial_factors(feats: DataFrame, tables: DataFrame) -> DataFrame:
    """feats: one row per (cik, as_of) with sector, bank, negative_equity and every factor column."""
    dated = factor_values(peers.with_table_date(feats, "as_of", tables))
    looked = peers.percentiles(dated.withColumn("feature", F.col("key")), tables)
    raw = F.when(F.col("higher"), 100 * F.col("pct")).otherwise(100 * (1 - F.col("pct")))
    ne = F.col("negative_equity")
    scored = looked.withColumn("_s", guarded_score(F.col("key"), F.col("value"), raw, ne))
    return scored.select(
        "cik", "as_of", F.lit("financial").alias("pillar"), "key", "label", F.lit("Stat").alias("kind"), "weight", "value",
        F.bround("_s", 2).alias("score"), F.bround("pct", 4).alias("pct"), "peer_group",
        guard_note(F.col("key"), F.col("value"), F.col("_s"), ne).alias("note"))


def logistic(x: Column, scale: float) -> Column:
    return 100 / (1 + F.exp(-x / scale))


def market_factors(metrics: DataFrame) -> DataFrame:
    """metrics: (cik, as_of, return/excess 6m and 12m, vol_90d, drawdown_52w)."""
    ex6, ex12 = F.coalesce("excess_6m", "return_6m"), F.coalesce("excess_12m", "return_12m")
    vol, dd = F.col("vol_90d"), F.col("drawdown_52w")
    stat = {"kind": "Stat"}
    return _emit(metrics, "market", [
        {"key": "excess_return_6m", "label": "6-month return", "weight": 0.30, "value": ex6,
         "score": F.bround(logistic(ex6, 0.15), 2), **stat},
        {"key": "excess_return_12m", "label": "12-month return", "weight": 0.20, "value": ex12,
         "score": F.bround(logistic(ex12, 0.20), 2), **stat},
        {"key": "volatility_90d", "label": "90-day realised volatility (annualised)", "weight": 0.25, "value": vol,
         "score": F.bround(clip((0.80 - vol) / (0.80 - 0.15) * 100, 0.0, 100.0), 2), **stat},
        {"key": "drawdown_52w", "label": "Drawdown from 52-week high", "weight": 0.25, "value": dd,
         "score": F.bround(clip((1 - dd / 0.6) * 100, 0.0, 100.0), 2), **stat}])


def news_factors(stats: DataFrame) -> DataFrame:
    """stats: news_stats rows; fewer than five headlines give no factors."""
    level, trend, neg = F.col("level"), F.col("trend"), F.col("neg_share")
    ml = {"kind": "ML"}
    return _emit(stats.where(F.col("articles") >= 5), "news", [
        {"key": "news_sentiment_level", "label": "Recency-weighted news sentiment (90 days)", "weight": 0.60,
         "value": F.bround(level, 4), "score": F.bround(clip(50 * (1 + level), 0.0, 100.0), 2), **ml},
        {"key": "news_sentiment_trend", "label": "Sentiment trend (last 30d vs prior 60d)", "weight": 0.25,
         "value": F.bround(trend, 4), "score": F.bround(clip(50 + 100 * trend, 0.0, 100.0), 2), **ml},
        {"key": "negative_story_share", "label": "Share of strongly negative stories", "weight": 0.15,
         "value": F.bround(neg, 4), "score": F.bround(clip(100 * (1 - 2 * neg), 0.0, 100.0), 2), **ml}])


def event_load(events: DataFrame, as_of: Column) -> DataFrame:
    """Events aged 0..365 days at as_of with their decay weight. events: (cik, date, type, penalty, cap)."""
    age = F.datediff(as_of, F.col("date"))
    return (events.withColumn("as_of", as_of).withColumn("age", age).where(F.col("age").between(0, 365))
            .withColumn("decay", F.exp(-F.col("age") / DECAY)))


def workforce_factors(employee: DataFrame, load: DataFrame) -> DataFrame:
    """employee: (cik, as_of, index, trend); companies without an index have no workforce factors."""
    layoffs = (load.where(F.col("type").isin("RESTRUCTURING", "LAYOFFS")).groupBy("cik", "as_of")
               .agg(F.sum("decay").alias("_d")))
    df = employee.join(layoffs, ["cik", "as_of"], "left")
    decayed = F.coalesce("_d", F.lit(0.0))
    rows = _emit(df, "workforce", [
        {"key": "employee_sentiment", "label": "Employee Sentiment Index", "weight": 0.30, "value": F.col("index"),
         "score": F.bround(clip(50 * (1 + F.col("index")), 0.0, 100.0), 2), "kind": "ML"},
        {"key": "employee_sentiment_trend", "label": "Employee sentiment trend (4 quarters)", "weight": 0.15,
         "value": F.col("trend"), "score": F.bround(clip(50 + 400 * F.col("trend"), 0.0, 100.0), 2), "kind": "Stat"},
        {"key": "layoff_events_12m", "label": "Layoff / restructuring events (12 months, decayed)", "weight": 0.30,
         "value": F.bround(decayed, 3), "score": F.bround(clip(100 - 30 * decayed, 0.0, 100.0), 2), "kind": "Rule"}])
    return rows.where((F.col("key") != "employee_sentiment_trend") | F.col("value").isNotNull())


def event_penalty(base: DataFrame, load: DataFrame) -> DataFrame:
    """(cik, as_of, total, events, cap) over the events with a penalty; companies without one have total 0."""
    hit = load.where(F.col("penalty") > 0)
    agg = hit.groupBy("cik", "as_of").agg(F.sum(F.col("penalty") * F.col("decay")).alias("total"),
                                          F.count(F.lit(1)).alias("events"), F.min("cap").alias("cap"))
    return (base.select("cik", "as_of").distinct().join(agg, ["cik", "as_of"], "left")
            .select("cik", "as_of", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("events", F.lit(0)).alias("events"),
                    "cap"))


def contributing_events(load: DataFrame) -> DataFrame:
    """Events with a penalty, their decayed penalty and their rank in the company, the largest first."""
    order = W.partitionBy("cik", "as_of").orderBy(F.desc("decayed_penalty"), F.desc("date"), "label", "accn")
    return (load.where(F.col("penalty") > 0).withColumn("decayed_penalty", F.bround(F.col("penalty") * F.col("decay"), 2))
            .withColumn("rank", F.row_number().over(order)))


def event_notes(contributing: DataFrame, first: int = 4) -> DataFrame:
    """(cik, as_of, note): what the largest events of a company took off."""
    entry = F.concat("label", F.lit(" ("), F.col("date").cast("string"), F.lit("): -"), F.format_string("%.1f", "decayed_penalty"))
    return (contributing.where(F.col("rank") <= first).groupBy("cik", "as_of").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("text")))).alias("n"))
            .select("cik", "as_of", F.array_join(F.transform("n", lambda x: x["text"]), "; ").alias("note")))


def events_factor(penalty: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The penalty factor; its note names the largest events (from `event_notes`)."""
    if notes is not None:
        penalty = penalty.join(notes.withColumnRenamed("note", "largest"), ["cik", "as_of"], "left")
    return _emit(penalty, "events", [
        {"key": "material_events", "label": "Material-event penalty (12 months, decayed)", "weight": 1.0,
         "value": F.bround("total", 2), "score": F.bround(clip(100 - F.col("total"), 0.0, 100.0), 2), "kind": "Rule",
         "note": F.when(F.col("events") == 0, "no material adverse events in the last 12 months").otherwise(F.col("largest") if notes is not None else F.lit(None).cast("string"))}])


def units(x: Column, places: int) -> Column:
    """A value already rounded to `places` as an integer count of its last place, so sums and ties are exact."""
    return F.rint(x * 10 ** places).cast("long")


def pillar_scores(factors: DataFrame, freshness: DataFrame) -> DataFrame:
    """freshness: (cik, as_of, pillar, freshness) for every pillar of every company, present or not.

    The workforce pillar's coverage is the share of its full weight, with the review factors scaled by their freshness.
    """
    w, s = units(F.col("weight"), 2), units(F.col("score"), 2)
    have = F.col("score").isNotNull()
    review = F.col("key").startswith("employee")
    zero = F.lit(0).cast("long")
    g = factors.groupBy("cik", "as_of", "pillar").agg(
        F.sum(w).alias("_w"), F.sum(F.when(have, w)).alias("_a"), F.sum(F.when(have, w * s)).alias("_ws"),
        F.coalesce(F.sum(F.when(review, w)), zero).alias("_rev"), F.coalesce(F.sum(F.when(~review, w)), zero).alias("_other"))
    j = freshness.join(g, ["cik", "as_of", "pillar"], "left")
    share = F.coalesce(F.col("_a") / F.col("_w"), F.lit(0.0))
    coverage = (F.when(F.col("pillar") == "workforce",
                       F.coalesce((F.col("_other") + F.col("_rev") * F.col("freshness")) / 100.0, F.lit(0.0)))
                .otherwise(share * F.col("freshness")))
    weight = F.expr("CASE pillar " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in PILLARS.items()) + " END")
    return j.select("cik", "as_of", "pillar", weight.alias("weight"),
                    (F.rint(F.col("_ws") / F.col("_a")) / 100.0).alias("score"),
                    (F.rint(coverage * 10000.0) / 10000.0).alias("coverage"), F.col("_a").alias("available_weight"))


def composite(pillars: DataFrame, caps: DataFrame) -> DataFrame:
    """caps: (cik, as_of, cap). One row per company: confidence, raw score, capped and rounded score, band."""
    e, s = units(F.col("effective_weight"), 4), units(F.col("score"), 2)
    g = effective_weights(pillars).groupBy("cik", "as_of").agg(
        (F.sum(units(F.col("weight"), 2) * units(F.col("coverage"), 4)) / 1e6).alias("_c"),
        (F.sum(F.when(F.col("score").isNotNull(), e * s)) / 1e6).alias("_raw"))
    j = g.join(caps.select("cik", "as_of", "cap"), ["cik", "as_of"], "left")
    enough = F.col("_raw").isNotNull() & (F.col("_c") >= MIN_CONFIDENCE)
    capped = F.col("cap").isNotNull() & (F.col("_raw") > F.col("cap"))
    final = F.when(enough, F.rint(F.when(capped, F.col("cap")).otherwise(F.col("_raw"))).cast("int"))
    out = j.select("cik", "as_of", final.alias("score"), (F.rint(F.col("_c") * 1000.0) / 1000.0).alias("confidence"),
                   (F.rint(F.col("_raw") * 100.0) / 100.0).alias("raw_score"),
                   F.when(~enough, "confidence below 0.40: too little public data for a reliable score")
                   .when(capped, F.format_string("capped at %.0f", F.col("cap"))).alias("override"))
    return out.withColumn("band", health_band(F.col("score")))


def effective_weights(pillars: DataFrame) -> DataFrame:
    """Weights renormalised over the available pillars (five rows per company)."""
    w = units(F.col("weight"), 2)
    total = F.sum(F.when(F.col("score").isNotNull(), w)).over(W.partitionBy("cik", "as_of"))
    return pillars.withColumn("effective_weight", F.when(F.col("score").isNotNull() & (total > 0),
                                                         F.rint(w * 10000.0 / total) / 10000.0).otherwise(0.0))


def impacts(factors: DataFrame, pillars: DataFrame) -> DataFrame:
    """Additive attribution: effective weight x share of the pillar's available weight x (score - 50)."""
    eff = effective_weights(pillars).select("cik", "as_of", "pillar", "effective_weight", "available_weight")
    j = factors.join(eff, ["cik", "as_of", "pillar"])
    exact = (units(F.col("effective_weight"), 4) * units(F.col("weight"), 2) * (units(F.col("score"), 2) - 5000)
             / (F.col("available_weight") * 100))
    impact = F.when(F.col("score").isNotNull() & F.col("available_weight").isNotNull(), F.rint(exact) / 10000.0).otherwise(0.0)
    return j.withColumn("impact", impact).drop("available_weight")


def attribution_check(with_impacts: DataFrame, health: DataFrame) -> DataFrame:
    s = with_impacts.groupBy("cik", "as_of").agg((F.lit(50.0) + F.sum("impact")).alias("rebuilt"))
    return (health.where("raw_score is not null").join(s, ["cik", "as_of"])
            .select("cik", "as_of", "raw_score", "rebuilt", (F.abs(F.col("raw_score") - F.col("rebuilt"))).alias("gap")))
