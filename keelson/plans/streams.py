"""Streaming queries: the tables are replayed as file streams and the result must equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import drift
from keelson.plans import monitoring as pmon
from keelson.plans import serving as psv
from keelson.plans import text as pt
from keelson.plans import views
from keelson.plans.intake import scratch
from keelson.plans.oracle import view
from keelson.plans.registry import query
from keelson.session import materialise
from keelson.streaming import feeds


def table(spark, stream, mode="append", keys=None):
    path = scratch(spark)
    return feeds.run_to_table(stream, f"{path}/out", f"{path}/checkpoint", mode, keys)


# windows of ten days that start every five, as the stream closes them: those that end a day or more before the newest row
view("window_bins", """SELECT b.model, b.feature, s.start, b.bin, count(*) AS c FROM (SELECT l.model, l.feature, l.logged_at, len(list_filter(e.edges, lambda x: x <= l.v)) AS bin
    FROM (SELECT model, 'value' AS feature, value AS v, logged_at, ref FROM log_p UNION ALL SELECT model, 'k', k, logged_at, ref FROM log_p) l
    JOIN edges_p e ON e.model = l.model AND e.feature = l.feature WHERE NOT l.ref AND l.v IS NOT NULL) b
  CROSS JOIN (VALUES (0), (1)) AS n(n) CROSS JOIN LATERAL (SELECT to_timestamp((floor(epoch(b.logged_at) / 432000) - n.n) * 432000) AT TIME ZONE 'UTC' AS start) s
  WHERE s.start + INTERVAL 10 DAY <= (SELECT max(logged_at) FROM log_p) - INTERVAL 1 DAY GROUP BY ALL""")
view("window_n", "SELECT model, feature, start, sum(c) AS n FROM window_bins GROUP BY ALL")


@query("stream_drift", """SELECT w.model, w.feature, w.start, CAST(max(w.n) AS BIGINT) AS n,
  round(sum((greatest(coalesce(b.c, 0) / w.n, 1e-4) - greatest(s.expected, 1e-4)) * ln(greatest(coalesce(b.c, 0) / w.n, 1e-4) / greatest(s.expected, 1e-4))), 6) AS psi
FROM window_n w JOIN shares_p s ON s.model = w.model AND s.feature = w.feature LEFT JOIN window_bins b ON b.model = w.model AND b.feature = w.feature AND b.start = w.start AND b.bin = s.bin
GROUP BY w.model, w.feature, w.start""")
def stream_drift(spark, sf):
    ref, live = pmon.parts(spark, sf)
    h = materialise(drift.reference_histogram(drift.long_features(ref), ["model", "feature"]))
    log = feeds.replay(spark, live.select("logged_at", "model", "features"), scratch(spark), order="logged_at")
    bins = table(spark, feeds.drift_bins(log, h, "10 days", "5 days"))
    return feeds.psi_of_bins(bins, h).select("model", "feature", "start", "n", F.round("psi", 6).alias("psi"))


@query("stream_usage_counters", f"SELECT CAST(ts AS DATE) AS day, user_id, {psv._KIND} AS kind, count(*) AS used FROM events GROUP BY 1, 2, 3")
def stream_usage(spark, sf):
    return table(spark, feeds.usage_counters(feeds.replay(spark, psv.usage(spark, sf), scratch(spark), order="created_at")), "update", ["day", "user_id", "kind"])


@query("stream_rate_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS key, count(*) AS calls, count(*) > 4 AS exceeded FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    calls = views.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("created_at"))
    return table(spark, feeds.window_counters(feeds.replay(spark, calls, scratch(spark), order="created_at"), 3600, 4), "update", ["start", "key"])


@query("stream_daily_sentiment", "SELECT cik, day, round(sentiment, 6) AS sentiment, articles FROM daily_p")
def stream_sentiment(spark, sf):
    a = pt.articles(spark, sf).select("cik", "published_at", "polarity")
    days = table(spark, feeds.daily_sentiment(feeds.replay(spark, a, scratch(spark), order="published_at")), "update", ["cik", "day"])
    return days.withColumn("sentiment", F.round("sentiment", 6))


@query("stream_fresh_headlines", "SELECT DISTINCT cik, norm FROM tokens_p")
def stream_fresh(spark, sf):
    """Every headline twice; each normalised title comes out once."""
    a = pt.articles(spark, sf).select("cik", "title", "published_at")
    s = feeds.fresh_headlines(feeds.replay(spark, a.unionByName(a), scratch(spark)))
    return table(spark, s.select("cik", "norm"), "append")


@query("stream_labels", """SELECT f.cik, f.accn, e.filed FROM annual_p f JOIN (SELECT DISTINCT cik, filed FROM events_p WHERE event = 'BANKRUPTCY') e ON e.cik = f.cik AND e.filed > f.filed
  AND e.filed <= f.filed + 365""")
def stream_labels(spark, sf):
    from keelson.plans.pointintime import annual_filings
    r = annual_filings(spark, sf).select("cik", "accn", F.col("filed").cast("timestamp").alias("as_of"))
    e = views.events(spark, sf).where("event = 'BANKRUPTCY'").select("cik", F.col("filed").cast("timestamp").alias("filed")).distinct()
    s = feeds.labelled_later(feeds.replay(spark, r, scratch(spark), 8), feeds.replay(spark, e, scratch(spark), 8))
    return table(spark, s, "append").select("cik", "accn", F.to_date("filed").alias("filed"))


@query("stream_report_alerts", """SELECT p.company_id, p.report_id, CASE WHEN prev_score - health_score > 0 THEN prev_score - health_score END AS score_drop,
  coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM fresh_signals f WHERE f.report_id = p.report_id), '') AS new_signals FROM prev_p p""")
def stream_alerts(spark, sf):
    r = psv.reports(spark, sf)
    serious = F.filter("signals", lambda s: s["severity"].isin("CRITICAL", "HIGH"))
    rows = r.select("company_id", "report_id", "generated_at", "health_score", F.array_join(F.transform("signals", lambda s: s["code"]), ",").alias("codes"),
                    F.array_join(F.transform(serious, lambda s: F.concat(s["code"], F.when(s["severity"] == "CRITICAL", "!").otherwise(""))), ",").alias("serious"))
    return feeds.settled(table(spark, feeds.report_alerts(feeds.replay(spark, rows, scratch(spark), order="generated_at")))).select("company_id", "report_id", "score_drop", "new_signals")


@query("stream_score_points", "SELECT * FROM points_p")
def stream_points(spark, sf):
    """All incoming and stored points arrive as one stream; the store's points equal the batch upsert, however many batches there were."""
    path = scratch(spark)
    store = feeds.PointStore(f"{path}/points")
    stream = feeds.replay(spark, psv.points_incoming(psv.reports(spark, sf)), f"{path}/in", 2, 8)
    feeds.upsert_stream(stream, store, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    store.compact(spark)
    return store.read(spark)
