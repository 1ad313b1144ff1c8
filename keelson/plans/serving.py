"""Report-store queries over orders (reports), customers (watchers) and events (usage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import serving as sv
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query

_BAND = "CASE WHEN s >= 70 THEN 'STRONG' WHEN s >= 55 THEN 'STABLE' WHEN s >= 40 THEN 'WATCH' WHEN s >= 25 THEN 'WEAK' ELSE 'CRITICAL' END"
_CODES = ["ALTMAN_DISTRESS", "BANKRUPTCY", "DRAWDOWN", "LATE_FILING", "RESTATEMENT"]
_SEV = {"ALTMAN_DISTRESS": "HIGH", "BANKRUPTCY": "CRITICAL", "DRAWDOWN": "MEDIUM", "LATE_FILING": "HIGH", "RESTATEMENT": "HIGH"}
# a report per order; signal i is present when bit i of (order key % 32) is set
_REP = """SELECT o.o_orderkey AS report_id, o.o_custkey AS company_id, CAST(o.o_orderdate AS DATE) AS as_of, o.o_orderdate AS generated_at,
  CAST(20 + floor(o.o_totalprice) % 80 AS INT) AS s, o.o_orderkey % 10 = 0 AS is_case_study, o.o_orderkey % 32 AS bits,
  (o.o_orderkey * 13 % 1000) / 1e3 AS confidence, (o.o_orderkey * 7 % 10007) / 10007e0 AS distress_prob, 'Customer ' || o.o_custkey AS name
FROM {orders} o"""
_sig = lambda fn: [fn(i, c, _SEV[c]) for i, c in enumerate(_CODES)]
view("reports_p", f"SELECT *, s AS health_score, {_BAND} AS band FROM ({_REP.format(orders='orders')})")
view("report_signals", " UNION ALL ".join(_sig(lambda i, c, v: (
    f"SELECT report_id, company_id, name, generated_at, '{c}' AS code, '{v}' AS severity, '{c} seen' AS message FROM reports_p "
    f"WHERE (bits // {2 ** i}) % 2 = 1"))))
_WATCH = "SELECT 100000 + c.c_custkey AS user_id, (c.c_custkey * 7) % 1000 AS company_id, CAST(5 + c.c_custkey % 20 AS INT) AS threshold FROM {customer} c"
view("watchers_p", _WATCH.format(customer="customer"))


def reports(spark, sf):
    df = spark.sql(_REP, orders=views.table(spark, sf, "orders"))
    sig = F.array_compact(F.array(*_sig(lambda i, c, v: F.when(
        F.shiftright("bits", i).bitwiseAND(F.lit(1)) == 1,
        F.struct(F.lit(c).alias("code"), F.lit(v).alias("severity"), F.lit(f"{c} seen").alias("message"))))))
    return df.withColumns({"health_score": F.col("s"), "band": F.expr(_BAND), "signals": sig})


def watchers(spark, sf):
    return spark.sql(_WATCH, customer=views.table(spark, sf, "customer"))


view("prev_p", "SELECT *, lag(health_score) OVER w AS prev_score, lag(report_id) OVER w AS prev_id FROM reports_p "
               "WINDOW w AS (PARTITION BY company_id ORDER BY generated_at, report_id)")


@query("score_changes", "SELECT report_id, company_id, health_score, prev_score, health_score - prev_score AS change FROM prev_p")
def score_changes(spark, sf):
    p = sv.with_previous(reports(spark, sf), "company_id", "generated_at", "report_id", ["health_score"])
    return p.select("report_id", "company_id", "health_score", F.col("prev_health_score").alias("prev_score"),
                    (F.col("health_score") - F.col("prev_health_score")).alias("change"))


view("drops_p", """SELECT w.user_id, p.company_id, p.report_id, 'SCORE_DROP' AS type,
  CASE WHEN prev_score - health_score >= 2 * threshold THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  name || ' health score fell ' || (prev_score - health_score) || ' points (' || prev_score || ' -> ' || health_score || ', ' || band || ').' AS message
FROM prev_p p JOIN watchers_p w USING (company_id) WHERE prev_score - health_score >= threshold AND prev_score - health_score > 0""")
view("fresh_signals", """SELECT s.company_id, s.report_id, s.name, s.code, s.severity, s.message FROM report_signals s JOIN prev_p p USING (report_id)
WHERE s.severity IN ('HIGH', 'CRITICAL') AND CASE WHEN p.prev_id IS NULL THEN s.severity = 'CRITICAL'
  ELSE NOT EXISTS (SELECT 1 FROM report_signals q WHERE q.report_id = p.prev_id AND q.code = s.code) END""")


@query("score_drop_alerts", "SELECT * FROM drops_p")
def score_drop_alerts(spark, sf):
    return sv.score_drops(reports(spark, sf), watchers(spark, sf))


@query("new_signals", "SELECT * FROM fresh_signals")
def new_signals(spark, sf):
    return sv.new_signals(reports(spark, sf))


@query("watchlist_alerts", """SELECT * FROM drops_p UNION ALL SELECT w.user_id, f.company_id, f.report_id, 'NEW_SIGNAL', f.severity,
  f.name || ': ' || f.message FROM fresh_signals f JOIN watchers_p w USING (company_id)""")
def watchlist_alerts(spark, sf):
    return sv.alerts(reports(spark, sf), watchers(spark, sf))


@query("newest_alerts_per_user", """SELECT user_id, report_id, type, message FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY report_id DESC, message DESC)
  AS k FROM drops_p) WHERE k <= 100""")
def newest_alerts(spark, sf):
    a = sv.score_drops(reports(spark, sf), watchers(spark, sf))
    return sv.newest_per_key(a, ["user_id"], ["report_id", "message"], 100).select("user_id", "report_id", "type", "message")


@query("watchers_of_company", "SELECT r.report_id, w.user_id, w.threshold FROM reports_p r JOIN watchers_p w USING (company_id)")
def watchers_of(spark, sf):
    return reports(spark, sf).join(watchers(spark, sf), "company_id").select("report_id", "user_id", "threshold")


@query("watched_companies", "SELECT c_custkey AS company_id, c_name FROM customer WHERE c_custkey IN (SELECT company_id FROM watchers_p)")
def watched(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), "c_name")
    return sv.watched(c, watchers(spark, sf))


# ------------------------------------------------------------------ radar, compare, latest reports
view("universe_p", """SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey * 11 % 2400 AS INT) END AS as_of
FROM customer UNION ALL SELECT company_id, as_of FROM reports_p WHERE report_id % 5 = 0""")
view("live_p", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY generated_at DESC, report_id DESC) AS rn "
               "FROM reports_p WHERE NOT is_case_study) WHERE rn = 1")
view("dated_p", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, as_of ORDER BY generated_at DESC, report_id DESC) AS rn "
                "FROM reports_p) WHERE rn = 1")
view("radar_p", """SELECT u.company_id, u.as_of, r.report_id, r.as_of AS r_as_of, r.health_score, r.band, false AS case_study FROM universe_p u LEFT JOIN live_p r
  USING (company_id) WHERE u.as_of IS NULL UNION ALL SELECT u.company_id, u.as_of, r.report_id, r.as_of, r.health_score, r.band, true FROM universe_p u
  LEFT JOIN dated_p r USING (company_id, as_of) WHERE u.as_of IS NOT NULL""")


def universe(spark, sf):
    c = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("company_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 11 % 2400).cast("int"))).alias("as_of"))
    return c.unionByName(reports(spark, sf).where("report_id % 5 = 0").select("company_id", "as_of"))


@query("radar_points", """SELECT company_id, report_id, r_as_of AS as_of, health_score, band, case_study FROM (SELECT *, row_number() OVER (PARTITION BY report_id
  ORDER BY case_study) AS rn FROM radar_p WHERE report_id IS NOT NULL) WHERE rn = 1""")
def radar_points(spark, sf):
    return sv.radar(universe(spark, sf), reports(spark, sf))[0]


@query("radar_pending", "SELECT company_id, as_of FROM radar_p WHERE report_id IS NULL")
def radar_pending(spark, sf):
    return sv.radar(universe(spark, sf), reports(spark, sf))[1]


@query("company_comparison", """SELECT c.c_custkey AS company_id, report_id, as_of, health_score, band FROM customer c LEFT JOIN live_p ON company_id = c.c_custkey""")
def comparison(spark, sf):
    ids = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"))
    return sv.compare(ids, reports(spark, sf)).select("company_id", "report_id", "as_of", "health_score", "band")


@query("latest_report_per_company", "SELECT company_id, report_id, generated_at FROM live_p")
def latest_report(spark, sf):
    r = reports(spark, sf).where("NOT is_case_study")
    return sv.latest_per_key(r, ["company_id"], ["generated_at", "report_id"]).select("company_id", "report_id", "generated_at")


@query("newest_reports_per_company", """SELECT company_id, report_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY generated_at DESC, report_id DESC)
  AS k FROM reports_p) WHERE k <= 5""")
def newest_reports(spark, sf):
    return sv.newest_per_key(reports(spark, sf), ["company_id"], ["generated_at", "report_id"], 5).select("company_id", "report_id")


# ------------------------------------------------------------------ score points
_POINTS = """SELECT company_id, as_of, generated_at, health_score AS score, 'LIVE' AS source FROM {r} WHERE report_id % 3 = 0
UNION ALL SELECT company_id, DATE '1995-01-01' + 90 * CAST(floor(({days}) / 90) AS INT), generated_at, CAST(floor(2e0 * health_score / 3 + 5e-1) AS INT), 'BACKFILL' FROM {r} WHERE report_id % 3 = 1"""
view("points_new", _POINTS.format(r="reports_p", days="as_of - DATE '1995-01-01'"))
view("points_old", "SELECT company_id, as_of, generated_at, health_score AS score, CASE WHEN report_id % 2 = 0 THEN 'LIVE' ELSE 'BACKFILL' END AS source FROM reports_p WHERE report_id % 3 = 2")
view("points_p", """SELECT company_id, as_of, generated_at, score, source FROM (SELECT *, row_number() OVER (PARTITION BY company_id, as_of ORDER BY source = 'LIVE' DESC,
  generated_at DESC, score DESC) AS rn FROM (SELECT * FROM points_old UNION ALL SELECT * FROM points_new)) WHERE rn = 1""")


def incoming_points(r):
    """New LIVE points and partial-score BACKFILL points of a report table."""
    live = r.where("report_id % 3 = 0").selectExpr("company_id", "as_of", "generated_at", "health_score as score", "'LIVE' as source")
    slot = F.date_add(F.lit("1995-01-01").cast("date"), (90 * F.floor(F.datediff("as_of", F.lit("1995-01-01")) / 90)).cast("int"))
    hist = (r.where("report_id % 3 = 1").withColumn("as_of", slot).withColumn("partial_score", 2.0 * F.col("health_score") / 3))
    return live.unionByName(sv.backfill_points(hist).select("company_id", "as_of", "generated_at", "score", "source"))


def stored_points(r):
    return r.where("report_id % 3 = 2").selectExpr("company_id", "as_of", "generated_at", "health_score as score",
                                                   "if(report_id % 2 = 0, 'LIVE', 'BACKFILL') as source")


def points_incoming(r):
    return incoming_points(r).unionByName(stored_points(r))


def points(spark, sf):
    r = reports(spark, sf)
    return sv.upsert_points(stored_points(r), incoming_points(r))


@query("score_points_upserted", "SELECT * FROM points_p")
def score_points(spark, sf):
    return points(spark, sf)


@query("stored_report_decimals", """SELECT report_id, CAST(round(confidence, 3) AS DECIMAL(4,3)) AS confidence, CAST(round(distress_prob, 4) AS DECIMAL(5,4)) AS distress_prob
FROM reports_p""")
def stored_decimals(spark, sf):
    return sv.stored_report(reports(spark, sf)).select("report_id", "confidence", "distress_prob")


view("requests_p", """SELECT c_custkey + 100000 AS user_id, c_custkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '1999-01-15' END AS from_date, DATE '2001-03-31' AS to_date FROM customer""")


@query("visible_history", """SELECT q.user_id, q.company_id, p.as_of, p.score, p.source FROM (SELECT *, CASE WHEN plan = 'FREE' THEN
  greatest(coalesce(from_date, CAST(to_date - INTERVAL 60 MONTH AS DATE)), to_date - 365) ELSE coalesce(from_date, CAST(to_date - INTERVAL 60 MONTH AS DATE)) END AS start FROM requests_p) q
JOIN points_p p ON p.company_id = q.company_id AND p.as_of BETWEEN q.start AND q.to_date""")
def visible_history(spark, sf):
    c = views.table(spark, sf, "customer")
    req = c.select((F.col("c_custkey") + 100000).alias("user_id"), F.col("c_custkey").alias("company_id"), plan_of(F.col("c_custkey")).alias("plan"),
                   F.when(F.col("c_custkey") % 2 == 0, F.lit("1999-01-15").cast("date")).alias("from_date"), F.lit("2001-03-31").cast("date").alias("to_date"))
    pts = points(spark, sf).withColumn("confidence", F.lit(None).cast("double"))
    return sv.clamp_history(pts, req).select("user_id", "company_id", "as_of", "score", "source")


def plan_of(key):
    return F.when(key % 3 == 0, "FREE").when(key % 3 == 1, "PRO").otherwise("ENTERPRISE")


@query("radar_trajectories", """SELECT company_id, as_of, report_id, lead(report_id) OVER w IS NULL OR max(as_of) OVER (PARTITION BY company_id) = as_of AS is_last FROM dated_p
WINDOW w AS (PARTITION BY company_id ORDER BY as_of)""")
def trajectories(spark, sf):
    d = sv.latest_per_key(reports(spark, sf), ["company_id", "as_of"], ["generated_at", "report_id"])
    return sv.trajectories(d).select("company_id", "as_of", "report_id", "is_last")


@query("event_tab_filters", """SELECT 'material' AS mode, count(*) AS n, count(DISTINCT accn) AS filings FROM events_p WHERE penalty > 0
UNION ALL SELECT 'news', count(*), count(DISTINCT accn) FROM events_p WHERE source LIKE 'News%' UNION ALL SELECT 'all', count(*), count(DISTINCT accn) FROM events_p""")
def event_filters(spark, sf):
    e = views.events(spark, sf).withColumn("origin", F.col("source"))
    parts = [sv.visible_events(e, m).agg(F.count("*").alias("n"), F.count_distinct("accn").alias("filings")).select(F.lit(m).alias("mode"), "n", "filings")
             for m in ("material", "news", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ usage, identifiers, availability, counts
NOW = "2024-01-15 18:00:00"
_KIND = "CASE event_type WHEN 'click' THEN 'API_CALL' WHEN 'purchase' THEN 'EXPORT' ELSE 'ANALYSIS' END"


def usage(spark, sf):
    return views.table(spark, sf, "events").select("user_id", F.expr(_KIND).alias("kind"), F.col("ts").alias("created_at"))


view("usage_p", f"SELECT user_id, {_KIND} AS kind, count(*) AS used FROM events WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '{NOW}' GROUP BY 1, 2")


@query("usage_today", "SELECT * FROM usage_p")
def usage_today(spark, sf):
    return sv.usage_today(usage(spark, sf), F.lit(NOW).cast("timestamp"))


@query("quota_check", """SELECT user_id, kind, plan, used, lim AS "limit", coalesce(used < lim, true) AS allowed FROM (SELECT u.*, p.plan, CASE kind WHEN 'ANALYSIS' THEN
  CASE p.plan WHEN 'FREE' THEN 5 WHEN 'PRO' THEN 100 ELSE 2000 END WHEN 'API_CALL' THEN CASE p.plan WHEN 'FREE' THEN 0 WHEN 'PRO' THEN 1000 ELSE 50000 END END AS lim
  FROM usage_p u JOIN (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PRO' ELSE 'ENTERPRISE' END AS plan FROM events) p USING (user_id))""")
def quota_check(spark, sf):
    users = views.table(spark, sf, "events").select("user_id").distinct().withColumn("plan", plan_of(F.col("user_id")))
    return sv.quota(sv.usage_today(usage(spark, sf), F.lit(NOW).cast("timestamp")), users)


view("ident_p", """SELECT 'ticker' AS scheme, 'T' || (c_custkey % 400) AS value, c_custkey AS company_id, DATE '1994-01-01' + CAST((c_custkey // 400) * 700 AS INT) AS valid_from,
  CASE WHEN c_custkey + 400 <= (SELECT max(c_custkey) FROM customer) THEN DATE '1994-01-01' + CAST((c_custkey // 400 + 1) * 700 AS INT) END AS valid_to FROM customer""")


@query("identifier_at_date", """SELECT o.o_orderkey AS probe, i.company_id FROM orders o JOIN ident_p i ON i.value = 'T' || (o.o_orderkey % 400) AND i.valid_from <= CAST(o.o_orderdate AS DATE)
  AND (i.valid_to IS NULL OR CAST(o.o_orderdate AS DATE) < i.valid_to)""")
def identifier_at_date(spark, sf):
    c = views.table(spark, sf, "customer")
    newest = c.agg(F.max("c_custkey")).scalar()
    block = F.floor(F.col("c_custkey") / 400).cast("int")
    origin = F.lit("1994-01-01").cast("date")
    ids = c.select(F.lit("ticker").alias("scheme"), F.concat(F.lit("T"), (F.col("c_custkey") % 400).cast("string")).alias("value"),
                   F.col("c_custkey").alias("company_id"), F.date_add(origin, block * 700).alias("valid_from"),
                   F.when(F.col("c_custkey") + 400 <= newest, F.date_add(origin, (block + 1) * 700)).alias("valid_to"))
    o = views.table(spark, sf, "orders").select("o_orderkey", F.lit("ticker").alias("scheme"), F.to_date("o_orderdate").alias("as_of"),
                                                F.concat(F.lit("T"), (F.col("o_orderkey") % 400).cast("string")).alias("value"))
    hit = sv.identifier_asof(ids, o.select("scheme", "value", "as_of").distinct())
    return o.join(hit, ["scheme", "value", "as_of"]).select(F.col("o_orderkey").alias("probe"), "company_id")


@query("source_availability", """SELECT c.cik, s.source, l.d IS NOT NULL AS available, l.d AS data_as_of, CASE WHEN l.d IS NULL THEN 'no ' || s.source || ' data for this company' END AS reason
FROM companies_p c CROSS JOIN (VALUES ('filings'), ('facts'), ('news'), ('reviews')) AS s(source) LEFT JOIN (SELECT cik, 'filings' AS source, max(filed) AS d FROM filings_p GROUP BY 1
  UNION ALL SELECT cik, 'facts', max("end") FROM facts_raw_p GROUP BY 1 UNION ALL SELECT cik, 'news', max(CAST(published_at AS DATE)) FROM articles_p GROUP BY 1
  UNION ALL SELECT cik, 'reviews', max(date_review) FROM firm_reviews_p GROUP BY 1) l ON l.cik = c.cik AND l.source = s.source""")
def source_availability(spark, sf):
    from keelson.plans import reviews as pr
    from keelson.plans import text as pt
    newest = lambda df, name, col: df.groupBy("cik").agg(F.max(col).alias("data_as_of")).withColumn("source", F.lit(name))
    latest = (newest(views.filings(spark, sf), "filings", "filed").unionByName(newest(views.facts_raw(spark, sf), "facts", "end"))
              .unionByName(newest(pt.articles(spark, sf).withColumn("day", F.to_date("published_at")), "news", "day"))
              .unionByName(newest(pr.firm_reviews(spark, sf), "reviews", "date_review")))
    return sv.source_status(views.companies(spark, sf), latest, ["filings", "facts", "news", "reviews"])


@query("platform_counts", """SELECT 'companies' AS metric, count(*) AS n FROM supplier UNION ALL SELECT 'reports', count(*) FROM orders UNION ALL SELECT 'users', count(*) FROM customer
UNION ALL SELECT 'finished_jobs', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def platform_counts(spark, sf):
    t = lambda n: views.table(spark, sf, n)
    return sv.platform_stats(companies=t("supplier"), reports=t("orders"), users=t("customer"), finished_jobs=t("orders").where("o_orderstatus = 'F'"))


@query("last_quarters_and_balances", """SELECT cik, item, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, item ORDER BY "end" DESC) AS k FROM quar_one
  WHERE item IN ('Revenue', 'NetIncome', 'OperatingCashFlow', 'OperatingIncome')) WHERE k <= 16
UNION ALL SELECT cik, item, "end", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, item ORDER BY "end" DESC) AS k FROM inst_one
  WHERE item IN ('Cash', 'TotalLiabilities', 'StockholdersEquity', 'TotalAssets')) WHERE k <= 12""")
def last_series(spark, sf):
    from keelson.operators import pit, series
    from keelson.plans.pointintime import one_date
    known = pit.known_as_of(views.facts(spark, sf), one_date(spark, sf))
    q = series.quarterly_series(known.where(F.col("item").isin("Revenue", "NetIncome", "OperatingCashFlow", "OperatingIncome")), ["cik", "as_of"])
    i = series.instant_series(known.where(F.col("item").isin("Cash", "TotalLiabilities", "StockholdersEquity", "TotalAssets")), ["cik", "as_of"])
    cut = lambda df, n: sv.newest_per_key(df, ["cik", "item"], ["end"], n).select("cik", "item", "end", "val")
    return cut(q, 16).unionByName(cut(i, 12))


@query("impact_changes", """SELECT company_id, report_id, impact, round_even(impact - lag(impact) OVER (PARTITION BY company_id ORDER BY as_of), 4) AS delta
FROM (SELECT *, (health_score - 50) / 4e0 AS impact FROM dated_p)""")
def impact_changes(spark, sf):
    d = sv.latest_per_key(reports(spark, sf), ["company_id", "as_of"], ["generated_at", "report_id"])
    imp = d.select(F.col("company_id").alias("cik"), F.lit("total").alias("key"), "as_of", "report_id", ((F.col("health_score") - 50) / 4.0).alias("impact"))
    return sv.impact_changes(imp).select(F.col("cik").alias("company_id"), "report_id", "impact", "delta")


@query("factor_table_export")
def factor_export(spark, sf):
    from keelson.operators import factors as fx
    from keelson.plans.scoring import assemble
    facs, pillars, _, _, _ = assemble(spark, sf)
    fmt = F.when(F.col("pillar") == "market", "pct").otherwise("num")
    rows = fx.impacts(facs, pillars).withColumn("display_value", fx.display_value(F.col("value"), fmt))
    return sv.export_factors(rows)
