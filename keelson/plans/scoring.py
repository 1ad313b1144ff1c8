"""Factor, pillar, composite, signal and whole-universe report queries.

Company inputs come from different proxy tables, so the links are fixed by number: ticker = cik % 5, outlet = source number + 1,
reviews = firm number. Each source is read at its own newest date and carried to the scoring date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from keelson.functions import dims, text
from keelson.functions.numeric import clip
from keelson.operators import events as ev
from keelson.operators import factors as fx
from keelson.operators import market, news, peers, ratios, signals
from keelson.operators import reviews as rv
from keelson.operators.snapshot import snapshot
from keelson.plans import market as pm
from keelson.plans import peers as pp
from keelson.plans import reviews as pr
from keelson.plans import text as pt
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.pointintime import AS_OF, register_asof_views
from keelson.plans.registry import query
from keelson.session import materialise, shared

_D = f"DATE '{AS_OF}'"


def lit_date(d=AS_OF):
    return F.lit(d).cast("date")


# ------------------------------------------------------------------ inputs
def company_market(spark, sf):
    """Newest metrics of the company's ticker, carried to the scoring date."""
    asofs = pm.ticker_asofs(spark, sf).where(F.col("as_of") == pm.AS_OF)
    m = market.market_metrics(pm.bars(spark, sf), pm.bars(spark, sf, 21600), asofs).drop("as_of")
    ticker = F.element_at(F.array(*[F.lit(t) for t in pm.TICKERS]), (F.col("cik") % 5 + 1).cast("int"))
    return views.companies(spark, sf).select("cik", ticker.alias("ticker")).join(m, "ticker").withColumn("as_of", lit_date())


def company_news(spark, sf):
    return news.news_stats(pt.at_date(pt.articles(spark, sf))).withColumn("as_of", lit_date())


def employee(spark, sf):
    idx = rv.usable_quarters(rv.quarterly_index(pr.firm_reviews(spark, sf)))
    t = rv.index_trend(idx)
    end = F.last_day(F.make_date(F.substring("quarter", 1, 4).cast("int"), F.substring("quarter", 6, 1).cast("int") * 3, F.lit(1)))
    return t.select("cik", F.bround("index", 4).alias("index"), "trend", "quarter",
                    fx.review_freshness(lit_date(pr.AS_OF), end).alias("freshness"), lit_date().alias("as_of"))


#: Days from the scoring date to the newest date of the headlines, which are carried back by them.
NEWS_SHIFT = (dt.date.fromisoformat(pt.AS_OF) - dt.date.fromisoformat(AS_OF)).days


def news_event_rows(spark, sf):
    """Merged events of de-duplicated headlines that are known at the scoring date; a filing of the same kind nearby takes their penalty."""
    known = news.known_news(pt.at_date(news.deduplicate(pt.articles(spark, sf))))
    found = news.news_events(known).withColumn("date", F.date_sub("date", NEWS_SHIFT))
    merged = news.merge_events(found, views.events(spark, sf))
    return merged.select("cik", "date", "type", "label", F.col("origin").alias("source"), "severity", "penalty", F.lit(None).cast("double").alias("cap"),
                         F.get("evidence", F.lit(0)).alias("accn"))


def anomaly_scores(feats):
    return feats.where(F.col("as_of") == AS_OF).withColumn("statement_anomaly", F.when(F.col("beneish_m") > -1.0, 0.97).otherwise(0.5))


def anomaly_event_rows(spark, sf):
    e = signals.statement_anomaly_events(anomaly_scores(pp.stored_dataset(spark, sf)), views.filings(spark, sf))
    return e.select("cik", "date", "type", "label", F.lit("financial_anomaly model").alias("source"), "severity", "penalty", "cap", F.lit("ev:statement-anomaly").alias("accn"))


def event_rows(spark, sf):
    """All events of the Events pillar: filings, merged news and the statement anomaly."""
    filed = views.events(spark, sf).select("cik", F.col("filed").alias("date"), F.col("event").alias("type"), "label", "source",
                                           "severity", "penalty", "cap", "accn")
    return filed.unionByName(news_event_rows(spark, sf)).unionByName(anomaly_event_rows(spark, sf))


def load(spark, sf):
    return shared(spark, f"load:{sf}", lambda: materialise(fx.event_load(event_rows(spark, sf), lit_date())))


view("scored_news_p", f"""SELECT cik, 'ev:news-' || substr(sha1(coalesce(url, title)), 1, 10) AS evidence, CAST(published_at AS DATE) - {NEWS_SHIFT} AS date, e.type AS type,
  e.label AS label, 'News (' || domain || ')' AS origin, e.severity AS severity, e.penalty * greatest(0, -polarity) AS penalty, title
FROM (SELECT k.*, CASE {pt._rules} END AS e FROM known_p k JOIN first_tellings_p USING (article_id)) WHERE e.type IN ({pt._types})""", stored=True)
view("news_anchors_p", """SELECT cik, type, min(date) AS anchor FROM scored_news_p GROUP BY cik, type
UNION ALL
SELECT w.cik, w.type, min(n.date) FROM news_anchors_p w JOIN scored_news_p n ON n.cik = w.cik AND n.type = w.type AND n.date > w.anchor + 7
GROUP BY w.cik, w.type, w.anchor""", recursive=True)
view("news_clusters_p", """SELECT c.cik, c.type, c.date, c.first, CASE WHEN EXISTS (SELECT 1 FROM events_p f WHERE f.cik = c.cik
    AND (f.event = c.type OR (c.type = 'LAYOFFS' AND f.event = 'RESTRUCTURING')) AND abs(date_diff('day', f.filed, c.date)) <= 7) THEN 0 ELSE c.p END AS penalty
FROM (SELECT cik, type, anchor AS date, arg_min({'label': label, 'origin': origin, 'severity': severity, 'evidence': evidence}, (date, evidence)) AS first, max(penalty) AS p
  FROM (SELECT n.cik, n.type, n.date, n.evidence, n.label, n.origin, n.severity, n.penalty, max(w.anchor) AS anchor FROM scored_news_p n
    JOIN news_anchors_p w ON w.cik = n.cik AND w.type = n.type AND w.anchor <= n.date GROUP BY ALL) GROUP BY cik, type, anchor) c""", stored=True)
view("anomaly_events_p", f"""SELECT s.cik, coalesce(max(f.filed) FILTER (f.filed <= {_D}), {_D}) AS date FROM peers_p s
LEFT JOIN (SELECT * FROM filings_p WHERE regexp_matches(form, '^10-[KQ]')) f USING (cik) WHERE s.as_of = {_D} AND s.beneish_m > -1 GROUP BY s.cik""")
view("all_events_p", """SELECT cik, filed AS date, event AS type, label, source, severity, penalty, cap, accn FROM events_p
UNION ALL SELECT cik, date, type, first.label, first.origin, first.severity, penalty, NULL, first.evidence FROM news_clusters_p
UNION ALL SELECT cik, date, 'STATEMENT_ANOMALY', 'Unusual year-over-year statement changes (ML)', 'financial_anomaly model', 'MEDIUM', 10.0::DOUBLE, NULL, 'ev:statement-anomaly'
FROM anomaly_events_p""")
view("co_market", f"""SELECT c.cik, {_D} AS as_of, m.* EXCLUDE (as_of) FROM companies_p c JOIN market_p m ON m.as_of = DATE '{pm.AS_OF}'
  AND m.ticker = ['click', 'error', 'purchase', 'signup', 'view'][c.cik % 5 + 1]""")
view("co_news", f"SELECT * REPLACE ({_D} AS as_of) FROM news_stats_p")
view("co_emp", f"""SELECT cik, {_D} AS as_of, round_even(index, 4) AS index, trend, quarter, greatest(0.2::DOUBLE, least(1.0::DOUBLE,
  1 - 0.2::DOUBLE * greatest(0, date_diff('day', last_day(make_date(CAST(quarter[1:4] AS INT), CAST(quarter[6:6] AS INT) * 3, 1)),
  DATE '{pr.AS_OF}') / 365.25::DOUBLE - 1))) AS freshness FROM trend_p""")
view("load_p", f"""SELECT cik, {_D} AS as_of, date, type, label, source, severity, penalty, cap, accn,
  date_diff('day', date, {_D}) AS age, exp(-date_diff('day', date, {_D}) / 180.0::DOUBLE) AS decay FROM all_events_p
  WHERE date_diff('day', date, {_D}) BETWEEN 0 AND 365""", stored=True)


@query("scored_events", "SELECT cik, date, type, label, source, severity, round(penalty, 6) AS penalty, cap, accn, age FROM load_p")
def scored_events(spark, sf):
    """Every event that counts at the scoring date: filings, merged news, statement anomalies."""
    return load(spark, sf).select("cik", "date", "type", "label", "source", "severity", F.round("penalty", 6).alias("penalty"), "cap", "accn", F.col("age").cast("bigint").alias("age"))


view("contributing_p", """SELECT cik, date, label, accn, round_even(penalty * decay, 2) AS decayed_penalty,
  row_number() OVER (PARTITION BY cik ORDER BY round_even(penalty * decay, 2) DESC, date DESC, label, accn) AS rank FROM load_p WHERE penalty > 0""")


@query("contributing_events", "SELECT cik, date, label, accn, decayed_penalty, rank FROM contributing_p")
def contributing_events(spark, sf):
    c = fx.contributing_events(load(spark, sf))
    return c.select("cik", "date", "label", "accn", "decayed_penalty", F.col("rank").cast("bigint").alias("rank"))


@query("event_notes", """SELECT cik, string_agg(label || ' (' || date || '): -' || printf('%.1f', ((CAST(round(decayed_penalty * 100) AS BIGINT) + 5) // 10) / 10.0), '; ' ORDER BY rank) AS note
FROM contributing_p WHERE rank <= 4 GROUP BY cik""")
def event_notes(spark, sf):
    return fx.event_notes(fx.contributing_events(load(spark, sf))).select("cik", "note")


# ------------------------------------------------------------------ factors
_cap = lambda n: f"least(coalesce(raw, {n}), {n})"


def _spec(rows, cond):
    return " UNION ALL ".join(f"SELECT cik, as_of, '{k}' AS key, '{lab.replace(chr(39), chr(39) * 2)}' AS label, {w}::DOUBLE AS weight, "
                              f"{str(hi).lower()} AS higher, '{fmt}' AS fmt, {k} AS value, negative_equity, CASE WHEN bank THEN 'BANKS' "
                              f"ELSE sector END AS own FROM fin_src_SUF WHERE {cond}" for k, lab, w, hi, fmt in rows)


def register_financial(suf: str, source: str, table_date: str) -> None:
    view(f"fin_src_{suf}", source)
    specs = (_spec(fx.GENERAL_FACTORS, "NOT bank") + " UNION ALL " + _spec(fx.BANK_FACTORS, "bank")).replace("fin_src_SUF", f"fin_src_{suf}")
    view(f"fin_spec_{suf}", f"SELECT *, {table_date} AS table_date FROM ({specs})")
    view(f"fin_{suf}", f"""SELECT cik, as_of, 'financial' AS pillar, key, label, 'Stat' AS kind, weight, value, fmt, round_even(s, 2) AS score,
      round_even(pct, 4) AS pct, peer_group FROM (SELECT *, CASE WHEN key = 'piotroski_f' AND value IS NOT NULL THEN value / 9 * 100
        WHEN key = 'altman_z2' AND value < 1.1::DOUBLE THEN {_cap(20)} WHEN key = 'current_ratio' AND value < 1 THEN {_cap(30)}
        WHEN key = 'debt_equity' AND negative_equity = 1 THEN 0 WHEN key = 'securities_loss_equity' AND value > 0.5::DOUBLE THEN {_cap(15)}
        WHEN key = 'deposit_growth' AND value < -0.10::DOUBLE THEN {_cap(30)} ELSE raw END AS s
      FROM (SELECT *, CASE WHEN higher THEN 100 * pct ELSE 100 * (1 - pct) END AS raw FROM (
        SELECT l.*, CASE WHEN value IS NULL THEN NULL WHEN o.n IS NOT NULL THEN own WHEN a.n IS NOT NULL THEN 'ALL' END AS peer_group,
          CASE WHEN value IS NOT NULL AND coalesce(o.n, a.n) IS NOT NULL THEN
            {pp._INV.format(q='coalesce(o.quantiles, a.quantiles)', v='value')} END AS pct
        FROM fin_spec_{suf} l LEFT JOIN peer_tables_p o ON o.as_of = l.table_date AND o."group" = l.own AND o.feature = l.key
        LEFT JOIN peer_tables_p a ON a.as_of = l.table_date AND a."group" = 'ALL' AND a.feature = l.key)))""")


_PICK = "CASE WHEN as_of < DATE '{1}' THEN DATE '{0}' ELSE DATE '{1}' END".format(*pp.DATES)
register_financial("now", f"SELECT * FROM peers_p WHERE as_of = {_D}", _PICK)


def financial(spark, sf):
    feats = pp.stored_dataset(spark, sf)
    return fx.financial_factors(feats.where(F.col("as_of") == AS_OF), pp.stored_tables(spark, sf))


@query("financial_factors", "SELECT cik, as_of, key, weight, round(value, 6) AS value, score, pct, peer_group FROM fin_now")
def financial_factors(spark, sf):
    return financial(spark, sf).select("cik", "as_of", "key", "weight", F.round("value", 6).alias("value"), "score", "pct", "peer_group")


def _u(pillar, rows, src, where=""):
    return " UNION ALL ".join(f"SELECT cik, as_of, '{pillar}' AS pillar, '{k}' AS key, {w}::DOUBLE AS weight, {v} AS value, "
                              f"round_even({s}, 2) AS score FROM {src} {where}" for k, w, v, s in rows)


_c100 = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x})) END"
view("mkt_f", _u("market", [
    ("excess_return_6m", 0.30, "coalesce(excess_6m, return_6m)", "100 / (1 + exp(-coalesce(excess_6m, return_6m) / 0.15::DOUBLE))"),
    ("excess_return_12m", 0.20, "coalesce(excess_12m, return_12m)", "100 / (1 + exp(-coalesce(excess_12m, return_12m) / 0.20::DOUBLE))"),
    ("volatility_90d", 0.25, "vol_90d", _c100("(0.80::DOUBLE - vol_90d) / (0.80::DOUBLE - 0.15::DOUBLE) * 100")),
    ("drawdown_52w", 0.25, "drawdown_52w", _c100("(1 - drawdown_52w / 0.6::DOUBLE) * 100"))], "co_market"))
view("news_f", _u("news", [
    ("news_sentiment_level", 0.60, "round_even(level, 4)", _c100("50 * (1 + level)")),
    ("news_sentiment_trend", 0.25, "round_even(trend, 4)", _c100("50 + 100 * trend")),
    ("negative_story_share", 0.15, "round_even(neg_share, 4)", _c100("100 * (1 - 2 * neg_share)"))], "co_news", "WHERE articles >= 5"))
view("emp_load", """SELECT e.*, coalesce(sum(l.decay) FILTER (l.type IN ('RESTRUCTURING', 'LAYOFFS')), 0) AS decayed FROM co_emp e
  LEFT JOIN load_p l USING (cik) GROUP BY ALL""")
view("wf_f", "SELECT * FROM (" + _u("workforce", [
    ("employee_sentiment", 0.30, "index", _c100("50 * (1 + index)")),
    ("employee_sentiment_trend", 0.15, "trend", _c100("50 + 400 * trend")),
    ("layoff_events_12m", 0.30, "round_even(decayed, 3)", _c100("100 - 30 * decayed"))], "emp_load")
     + ") WHERE key <> 'employee_sentiment_trend' OR value IS NOT NULL")
view("penalty_p", f"""SELECT c.cik, {_D} AS as_of, coalesce(sum(l.penalty * l.decay) FILTER (l.penalty > 0), 0) AS total,
  count(*) FILTER (l.penalty > 0) AS events, min(l.cap) FILTER (l.penalty > 0) AS cap FROM companies_p c LEFT JOIN load_p l USING (cik)
  GROUP BY c.cik""")
view("ev_f", _u("events", [("material_events", 1.0, "round_even(total, 2)", _c100("100 - total"))], "penalty_p"))
_F4 = "SELECT cik, as_of, key, weight, round(value, 6) AS value, score FROM {}"


def _slim(df):
    return df.select("cik", "as_of", "key", "weight", F.round("value", 6).alias("value"), "score")


@query("market_factors", _F4.format("mkt_f"))
def market_factors(spark, sf):
    return _slim(fx.market_factors(company_market(spark, sf)))


@query("news_factors", _F4.format("news_f"))
def news_factors(spark, sf):
    return _slim(fx.news_factors(company_news(spark, sf)))


@query("workforce_factors", _F4.format("wf_f"))
def workforce_factors(spark, sf):
    return _slim(fx.workforce_factors(employee(spark, sf), load(spark, sf)))


def penalty(spark, sf):
    base = views.companies(spark, sf).select("cik", lit_date().alias("as_of"))
    return fx.event_penalty(base, load(spark, sf))


@query("event_penalties", "SELECT cik, as_of, round(total, 4) AS total, events, cap FROM penalty_p")
def event_penalties(spark, sf):
    return penalty(spark, sf).withColumn("total", F.round("total", 4))


# ------------------------------------------------------------------ pillars and composite
def assemble(spark, sf):
    return shared(spark, f"scores:{sf}", lambda: build_scores(spark, sf))


def build_scores(spark, sf):
    """factors, pillars, health of every company at the scoring date."""
    feats = pp.stored_dataset(spark, sf)
    now = feats.where(F.col("as_of") == AS_OF)
    stats, emp, pen = company_news(spark, sf), employee(spark, sf), penalty(spark, sf)
    ld = load(spark, sf)
    facs = (fx.financial_factors(now, pp.stored_tables(spark, sf)).unionByName(fx.market_factors(company_market(spark, sf)))
            .unionByName(fx.news_factors(stats)).unionByName(fx.workforce_factors(emp, ld))
            .unionByName(fx.events_factor(pen, fx.event_notes(fx.contributing_events(ld)))))
    base = views.companies(spark, sf).select("cik", lit_date().alias("as_of"))
    facs = materialise(facs)
    fresh = (base.join(now.select("cik", "period_end"), "cik", "left").join(stats.select("cik", "articles"), "cik", "left")
             .join(emp.select("cik", F.col("freshness").alias("ef")), "cik", "left"))
    entries = F.array(*[F.struct(F.lit(k).alias("pillar"), v.alias("freshness")) for k, v in {
        "financial": fx.filing_freshness(F.col("as_of"), F.col("period_end")), "market": F.lit(1.0),
        "news": F.least(F.lit(1.0), F.coalesce("articles", F.lit(0)) / 30.0), "workforce": F.coalesce("ef", F.lit(1.0)),
        "events": F.lit(1.0)}.items()])
    pillars = fx.pillar_scores(facs, fresh.select("cik", "as_of", F.inline(entries)))
    pillars = materialise(pillars)
    health = fx.composite(pillars, pen)
    return facs, pillars, health, feats, ld


view("factors_all", "SELECT cik, as_of, pillar, key, weight, value, score FROM fin_now UNION ALL SELECT * FROM mkt_f UNION ALL "
                    "SELECT * FROM news_f UNION ALL SELECT * FROM wf_f UNION ALL SELECT * FROM ev_f")
view("fresh_p", f"""SELECT c.cik, {_D} AS as_of, unnest([{{'pillar': 'financial', 'f': CASE WHEN p.period_end IS NULL THEN 0.0::DOUBLE
    WHEN date_diff('day', p.period_end, {_D}) / 30.4::DOUBLE <= 15 THEN 1.0 WHEN date_diff('day', p.period_end, {_D}) / 30.4::DOUBLE <= 24 THEN 0.5
    ELSE 0.25 END}}, {{'pillar': 'market', 'f': 1.0::DOUBLE}}, {{'pillar': 'news', 'f': least(1.0, coalesce(n.articles, 0) / 30.0::DOUBLE)}},
    {{'pillar': 'workforce', 'f': coalesce(e.freshness, 1.0)}}, {{'pillar': 'events', 'f': 1.0::DOUBLE}}], recursive := true)
FROM companies_p c LEFT JOIN (SELECT * FROM peers_p WHERE as_of = {_D}) p USING (cik) LEFT JOIN co_news n USING (cik)
LEFT JOIN co_emp e USING (cik)""")
_PW = "CASE pillar " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fx.PILLARS.items()) + " END"
_i = lambda x, d: f"CAST(round({x} * {10 ** d}) AS BIGINT)"
view("pillars_p", f"""SELECT f.cik, f.as_of, f.pillar, {_PW.replace('pillar', 'f.pillar')} AS weight, round_even(ws / a, 0) / 100 AS score,
  round_even(CASE WHEN f.pillar = 'workforce' THEN coalesce((oth + rev * f.f) / 100.0::DOUBLE, 0) ELSE coalesce(a / w, 0) * f.f END * 1e4, 0) / 1e4 AS coverage,
  a AS available_weight
FROM fresh_p f LEFT JOIN (SELECT cik, pillar, sum({_i('weight', 2)}) AS w, sum({_i('weight', 2)}) FILTER (score IS NOT NULL) AS a,
  sum({_i('weight', 2)} * {_i('score', 2)}) FILTER (score IS NOT NULL) AS ws, coalesce(sum({_i('weight', 2)}) FILTER (key LIKE 'employee%'), 0) AS rev,
  coalesce(sum({_i('weight', 2)}) FILTER (key NOT LIKE 'employee%'), 0) AS oth FROM factors_all GROUP BY 1, 2) g USING (cik, pillar)""")
view("eff_p", f"""SELECT *, CASE WHEN score IS NOT NULL THEN round_even({_i('weight', 2)} * 1e4 / sum({_i('weight', 2)}) FILTER (score IS NOT NULL)
  OVER (PARTITION BY cik), 0) / 1e4 ELSE 0 END AS effective_weight FROM pillars_p""")
view("health_p", f"""SELECT h.cik, h.as_of, CASE WHEN raw IS NOT NULL AND conf >= 0.4::DOUBLE THEN CAST(round_even(least(raw, coalesce(p.cap, raw)), 0) AS INT) END AS score,
  round_even(conf * 1e3, 0) / 1e3 AS confidence, round_even(raw * 1e2, 0) / 1e2 AS raw_score, raw > p.cap AS capped FROM (SELECT cik, as_of,
  sum({_i('weight', 2)} * {_i('coverage', 4)}) / 1e6 AS conf, sum({_i('effective_weight', 4)} * {_i('score', 2)}) FILTER (score IS NOT NULL) / 1e6 AS raw
  FROM eff_p GROUP BY 1, 2) h JOIN penalty_p p USING (cik)""")
_BAND = "CASE WHEN score IS NULL THEN 'INSUFFICIENT_DATA' WHEN score >= 70 THEN 'STRONG' WHEN score >= 55 THEN 'STABLE' WHEN score >= 40 THEN 'WATCH' WHEN score >= 25 THEN 'WEAK' ELSE 'CRITICAL' END"


@query("pillar_scores", "SELECT cik, as_of, pillar, weight, score, coverage FROM pillars_p")
def pillar_scores(spark, sf):
    return assemble(spark, sf)[1].select("cik", "as_of", "pillar", "weight", "score", "coverage")


@query("health_scores", f"SELECT cik, as_of, score, confidence, raw_score, coalesce(capped, false) AND score IS NOT NULL AS capped, {_BAND} AS band FROM health_p")
def health_scores(spark, sf):
    h = assemble(spark, sf)[2]
    return h.select("cik", "as_of", "score", "confidence", "raw_score", F.coalesce(F.col("override").startswith("capped"), F.lit(False)).alias("capped"), "band")


view("impacts_p", """SELECT f.cik, f.as_of, f.pillar, f.key, CASE WHEN f.score IS NOT NULL AND e.available_weight IS NOT NULL THEN
  round_even(""" + f"{_i('e.effective_weight', 4)} * {_i('f.weight', 2)} * ({_i('f.score', 2)} - 5000) / (e.available_weight * 100)" + """, 0) / 1e4 ELSE 0 END AS impact, f.score FROM factors_all f JOIN eff_p e
  ON e.cik = f.cik AND e.pillar = f.pillar""")


@query("factor_impacts", "SELECT cik, pillar, key, impact FROM impacts_p")
def factor_impacts(spark, sf):
    facs, pillars, _, _, _ = assemble(spark, sf)
    return fx.impacts(facs, pillars).select("cik", "pillar", "key", "impact")


@query("strongest_factors", """SELECT cik, side, key, impact, rank FROM (SELECT cik, key, impact, CASE WHEN impact > 0 THEN 'positive' ELSE 'negative' END AS side,
  row_number() OVER (PARTITION BY cik, impact > 0 ORDER BY abs(impact) DESC, key) AS rank FROM impacts_p WHERE score IS NOT NULL AND abs(impact) > 0.5::DOUBLE)
  WHERE rank <= 3""")
def strongest_factors(spark, sf):
    facs, pillars, _, _, _ = assemble(spark, sf)
    return top_impacts(fx.impacts(facs, pillars))


def top_impacts(imp, n: int = 3):
    """Up to n strongest supports (> 0.5 points) and drags (< -0.5) per company."""
    from pyspark.sql import Window as W
    big = imp.where(F.col("score").isNotNull() & (F.abs("impact") > 0.5)).withColumn(
        "side", F.when(F.col("impact") > 0, "positive").otherwise("negative"))
    w = W.partitionBy("cik", "side").orderBy(F.desc(F.abs("impact")), "key")
    return big.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cik", "side", "key", "impact", "rank")


@query("attribution_check", """SELECT cik, raw_score, round(50 + total, 4) AS rebuilt, abs(raw_score - 50 - total) <= 0.05::DOUBLE AS holds
FROM health_p JOIN (SELECT cik, sum(impact) AS total FROM impacts_p GROUP BY cik) USING (cik) WHERE raw_score IS NOT NULL""")
def attribution_check(spark, sf):
    facs, pillars, health, _, _ = assemble(spark, sf)
    c = fx.attribution_check(fx.impacts(facs, pillars), health)
    return c.select("cik", "raw_score", F.round("rebuilt", 4).alias("rebuilt"), (F.col("gap") <= 0.05).alias("holds"))


@query("pillar_matrix", """SELECT pillar, max(score) FILTER (cik = 1) AS "1", max(score) FILTER (cik = 2) AS "2", max(score) FILTER (cik = 7) AS "7"
FROM pillars_p GROUP BY pillar""")
def pillar_matrix(spark, sf):
    from keelson.operators.serving import pillar_matrix as matrix
    return matrix(assemble(spark, sf)[1], [1, 2, 7])


# ------------------------------------------------------------------ signals
def signal_inputs(spark, sf, feats):
    """Feature row of each company at the scoring date with market, news and model readings attached."""
    now = feats.where(F.col("as_of") == AS_OF).join(views.companies(spark, sf).select("cik", F.col("financial").alias("is_financial")), "cik")
    mk = company_market(spark, sf).select("cik", "ticker", "drawdown_52w")
    flagged = (market.max_abs_z(market.robust_z(pm.bars(spark, sf))).where("flagged")
               .where(F.datediff(lit_date(pm.AS_OF), F.to_date("bar")).between(0, 14)).select("ticker").distinct()
               .withColumn("market_anomaly_max", F.lit(1.0)))
    shock = news.sentiment_shock(pt.at_date(pt.articles(spark, sf))).select("cik", F.col("shock").alias("sentiment_shock"))
    prob = 1 / (1 + F.exp(F.col("altman_z2")))
    return (now.join(mk, "cik", "left").join(flagged, "ticker", "left").join(shock, "cik", "left")
            .withColumn("statement_anomaly", F.when(F.col("beneish_m") > -1.0, 0.97).otherwise(0.5))
            .withColumn("distress_probability", F.when(~F.col("is_financial"), prob))
            .withColumn("distress_band", fx.risk_band(F.col("distress_probability"))))


view("sig_in", f"""SELECT p.*, m.drawdown_52w, CASE WHEN m.ticker IN (SELECT ticker FROM maxz_p WHERE max_z >= 5 AND
    date_diff('day', CAST(bar AS DATE), DATE '{pm.AS_OF}') BETWEEN 0 AND 14) THEN 1.0 END AS market_anomaly_max,
  coalesce(s.days >= 20 AND s.base_days >= 10 AND s.n7 >= 5 AND s.last7 < s.base_mean - 2 * s.base_std, false) AS sentiment_shock,
  CASE WHEN beneish_m > -1 THEN 0.97 ELSE 0.5 END AS statement_anomaly,
  CASE WHEN NOT c.financial THEN 1 / (1 + exp(altman_z2)) END AS distress_probability
FROM peers_p p JOIN (SELECT cik, financial FROM companies_s) c USING (cik) LEFT JOIN co_market m USING (cik) LEFT JOIN shock_p s USING (cik) WHERE p.as_of = {_D}""")
_ev_rules = " UNION ALL ".join(f"SELECT cik, '{c}' AS code, '{s}' AS severity, max(date) AS date FROM load_p WHERE type IN ({', '.join(repr(t) for t in types)}) "
                               f"AND age <= {d} GROUP BY cik" for c, types, d, s, _ in signals.EVENT_RULES)
_val = [("NOT bank AND altman_z2 < 1.1::DOUBLE", "ALTMAN_DISTRESS", "'HIGH'"), ("current_ratio < 1 AND neg_fcf_quarters >= 2", "LIQUIDITY_SQUEEZE", "'HIGH'"),
        ("negative_equity = 1", "NEGATIVE_EQUITY", "'MEDIUM'"), ("bank AND securities_loss_equity > 0.5::DOUBLE", "SECURITIES_LOSSES", "'HIGH'"),
        ("bank AND deposit_growth < -0.1::DOUBLE", "DEPOSIT_OUTFLOW", "'HIGH'"), ("drawdown_52w >= 0.3::DOUBLE", "DRAWDOWN", "'MEDIUM'"),
        ("market_anomaly_max >= 0.99", "MARKET_ANOMALY", "'LOW'"), ("statement_anomaly >= 0.95", "STATEMENT_ANOMALY", "'MEDIUM'"),
        ("distress_probability >= 0.03::DOUBLE", "DISTRESS_MODEL", "CASE WHEN distress_probability >= 0.1::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END"),
        ("sentiment_shock", "SENTIMENT_SHOCK", "'MEDIUM'")]
view("signals_p", _ev_rules + " UNION ALL SELECT cik, 'EXEC_TURNOVER', 'MEDIUM', max(date) FROM load_p WHERE type = 'EXEC_DEPARTURE' AND age <= 180 "
     "GROUP BY cik HAVING count(*) >= 3 UNION ALL " + " UNION ALL ".join(
         f"SELECT cik, '{c}', {s}, CAST(NULL AS DATE) FROM sig_in WHERE {w}" for w, c, s in _val))


def all_signals(spark, sf, feats, ld):
    return signals.ordered(signals.event_signals(ld).unionByName(signals.turnover_signals(ld))
                           .unionByName(signals.value_signals(signal_inputs(spark, sf, feats))))


@query("event_signals", _ev_rules + " UNION ALL SELECT cik, 'EXEC_TURNOVER', 'MEDIUM', max(date) FROM load_p WHERE type = 'EXEC_DEPARTURE' AND age <= 180 "
       "GROUP BY cik HAVING count(*) >= 3")
def event_signals(spark, sf):
    ld = load(spark, sf)
    return (signals.event_signals(ld).unionByName(signals.turnover_signals(ld))).select("cik", "code", "severity", "date")


@query("warning_signals", """SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1
  WHEN 'MEDIUM' THEN 2 ELSE 3 END, date DESC NULLS LAST, code) - 1 AS position, code, severity, date FROM signals_p""")
def warning_signals(spark, sf):
    feats = pp.stored_dataset(spark, sf)
    s = all_signals(spark, sf, feats, load(spark, sf))
    return s.select("cik", F.col("position").cast("bigint").alias("position"), "code", "severity", "date")


@query("statement_anomaly_events", f"""SELECT s.cik, coalesce(max(f.filed) FILTER (f.filed <= {_D}), {_D}) AS date, 'STATEMENT_ANOMALY' AS type, 10.0::DOUBLE AS penalty
FROM sig_in s LEFT JOIN (SELECT * FROM filings_p WHERE regexp_matches(form, '^10-[KQ]')) f USING (cik) WHERE s.statement_anomaly >= 0.95 GROUP BY s.cik""")
def statement_anomaly_events(spark, sf):
    return signals.statement_anomaly_events(anomaly_scores(pp.stored_dataset(spark, sf)), views.filings(spark, sf)).select("cik", "date", "type", "penalty")


# ------------------------------------------------------------------ score history at filing dates
view("asofs_bf", f"SELECT DISTINCT cik, filed AS as_of FROM filings_p WHERE regexp_matches(form, '^10-[KQ]$') AND filed BETWEEN {_D} - 1095 AND {_D}")
register_asof_views("bf")
register_financial("bf", "SELECT r.*, c.sector, c.bank FROM ratios_bf r JOIN companies_s c USING (cik)", _PICK)
view("bf_pen", """SELECT a.cik, a.as_of, coalesce(sum(e.penalty * exp(-date_diff('day', e.filed, a.as_of) / 180.0::DOUBLE)), 0) AS total FROM asofs_bf a
  LEFT JOIN events_p e ON e.cik = a.cik AND e.filed BETWEEN a.as_of - 365 AND a.as_of AND e.penalty > 0 GROUP BY a.cik, a.as_of""")
view("backfill_p", f"""SELECT f.cik, f.as_of, f.financial, {_c100('p.total')} AS t, round_even({_c100('100 - p.total')}, 2) AS events,
  round_even((0.30::DOUBLE * f.financial + 0.15::DOUBLE * round_even({_c100('100 - p.total')}, 2)) / 0.45::DOUBLE, 2) AS partial_score
FROM (SELECT cik, as_of, round_even(sum(weight * score) / sum(weight) FILTER (score IS NOT NULL), 2) AS financial FROM fin_bf GROUP BY 1, 2) f
JOIN bf_pen p USING (cik, as_of)""")


def backfill(spark, sf):
    """Financial and Events pillars at every 10-K/10-Q of the last three years, each as known on that day."""
    f = views.filings(spark, sf)
    asofs = (f.where(F.col("form").rlike("^10-[KQ]$") & F.col("filed").between(F.date_sub(lit_date(), 1095), lit_date()))
             .select("cik", F.col("filed").alias("as_of")).distinct())
    snap = snapshot(views.facts(spark, sf), asofs)
    feats = ratios.bank_features(ratios.compute_features(ratios.without_filing(snap))).join(
        views.companies(spark, sf).select("cik", "sector", "bank"), "cik")
    facs = fx.financial_factors(materialise(feats), pp.stored_tables(spark, sf))
    have = F.col("score").isNotNull()
    fin = facs.groupBy("cik", "as_of").agg(F.bround(F.sum(F.when(have, F.col("weight") * F.col("score")))
                                                    / F.sum(F.when(have, F.col("weight"))), 2).alias("financial"))
    hits = ev.window_join(asofs, views.events(spark, sf).where("penalty > 0").groupBy("cik", "filed")
                          .agg(F.sum("penalty").alias("penalty")), 365, 0)
    pen = hits.groupBy("cik", "as_of").agg(F.sum(F.col("penalty") * F.exp(-F.datediff("as_of", "filed") / fx.DECAY)).alias("total"))
    j = fin.join(pen, ["cik", "as_of"], "left").withColumn("events", F.bround(clip(100 - F.coalesce("total", F.lit(0.0)), 0.0, 100.0), 2))
    return j.select("cik", "as_of", "financial", "events",
                    F.bround((0.30 * F.col("financial") + 0.15 * F.col("events")) / 0.45, 2).alias("partial_score"))


@query("score_history_at_filings", "SELECT cik, as_of, financial, events, partial_score FROM backfill_p")
def score_history(spark, sf):
    return backfill(spark, sf)


# ------------------------------------------------------------------ the whole-universe report
def universe_report(spark, sf):
    """One nested row per company: health, pillars with their factors, ordered signals, events from the newest, summary sentence."""
    facs, pillars, health, feats, ld = assemble(spark, sf)
    imp = fx.impacts(facs, pillars)
    keys = ["cik", "as_of"]
    fac = imp.groupBy(*keys, "pillar").agg(F.array_sort(F.collect_list(F.struct("key", "label", "value", "score", "weight", "impact", "note"))).alias("factors"))
    pil = (fx.effective_weights(pillars).join(fac, [*keys, "pillar"], "left").groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct("pillar", "score", "weight", "effective_weight", "coverage", "factors"))).alias("pillars")))
    sig = (all_signals(spark, sf, feats, ld).groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct("position", "code", "severity", "kind", "date", "message"))).alias("signals")))
    evs = (ld.groupBy(*keys)
           .agg(F.sort_array(F.collect_list(F.struct("date", "accn", "type", "label", "severity", "penalty")), False).alias("events")))
    co = views.companies(spark, sf).select("cik", "name", "sector", "bank")
    out = (co.join(health, "cik").join(pil, keys).join(sig, keys, "left").join(evs, keys, "left"))
    return out.withColumn("summary", summary_text())


def summary_text():
    """Deterministic summary sentence of a report row."""
    cover = F.format_string("%d%%", F.bround(F.col("confidence") * 100, 0).cast("int"))
    scored = F.concat(F.col("name"), F.format_string(" scores %d/100 (", "score"), F.lower("band"), F.lit(") as of "), F.col("as_of").cast("string"),
                      F.lit(", with "), fx.confidence_text(F.col("confidence")), F.lit(" confidence ("), cover, F.lit(" data coverage)."))
    missing = F.concat(F.lit("A reliable health score could not be computed for "), F.col("name"), F.lit(" as of "), F.col("as_of").cast("string"),
                       F.lit(": only "), cover, F.lit(" of the expected public data is available."))
    warn = F.concat(F.lit(" Warning signals: "), F.array_join(F.transform("signals", lambda s: s["message"]), "; "), F.lit("."))
    return F.concat(F.when(F.col("score").isNull(), missing).otherwise(scored), F.when(F.size("signals") > 0, warn).otherwise(F.lit("")))


@query("universe_report", f"""SELECT c.cik, c.name, c.sector, h.score, {_BAND} AS band, h.confidence, (SELECT count(*) FROM signals_p s WHERE s.cik = c.cik) AS signals,
  (SELECT count(*) FROM load_p l WHERE l.cik = c.cik) AS events, (SELECT count(*) FROM factors_all f WHERE f.cik = c.cik) AS factors
FROM companies_s c JOIN health_p h USING (cik)""")
def universe(spark, sf):
    r = universe_report(spark, sf)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return r.select("cik", "name", "sector", "score", "band", "confidence", F.greatest(n("signals"), F.lit(0)).alias("signals"),
                    F.greatest(n("events"), F.lit(0)).alias("events"),
                    F.aggregate("pillars", F.lit(0).cast("bigint"), lambda a, p: a + F.greatest(F.coalesce(F.size(p["factors"]), F.lit(0)), F.lit(0))).alias("factors"))


@query("report_summaries")
def report_summaries(spark, sf):
    return universe_report(spark, sf).select("cik", "summary")


@query("display_values", """SELECT cik, key, CASE WHEN value IS NULL THEN NULL WHEN fmt = 'pct' THEN printf('%.1f%%', value * 100)
  WHEN fmt = 'times' THEN printf('%.2fx', value) WHEN fmt = 'nine' THEN printf('%.0f/9', value) ELSE printf('%.2f', value) END AS display
FROM (SELECT * REPLACE (value * 100037e-5 AS value) FROM fin_spec_now)""")
def display_values(spark, sf):
    feats = pp.stored_dataset(spark, sf).where(F.col("as_of") == AS_OF).withColumn("table_date", F.col("as_of"))
    v = fx.factor_values(feats)
    return v.select("cik", "key", fx.display_value(F.col("value") * 100037e-5, F.col("fmt")).alias("display"))


@query("evidence_ids", "SELECT accn, 'ev:filing-' || substr(sha1(accn), 1, 10) AS evidence FROM filings_p")
def evidence_ids(spark, sf):
    return views.filings(spark, sf).select("accn", text.evidence_id("filing", F.col("accn")).alias("evidence"))


@query("sector_benchmarks", "SELECT cik, CASE sector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.SECTOR_ETF.items())
       + " ELSE 'SPY' END AS benchmark FROM companies_s")
def sector_benchmarks(spark, sf):
    return views.companies(spark, sf).select("cik", dims.sector_benchmark("sector").alias("benchmark"))
