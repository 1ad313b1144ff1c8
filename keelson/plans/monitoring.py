"""Drift, evaluation and text-validation queries over events (inference log), orders (scored rows) and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions.text import ADVICE, PLAIN_NUMBERS
from keelson.operators import drift, factors
from keelson.operators import evaluate as evl
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query
from keelson.session import materialise

CUT = "2024-01-16 00:00:00"


def log(spark, sf):
    """Inference log: features from the event value and its JSON property, prediction derived from both."""
    e = views.table(spark, sf, "events")
    k = F.from_json("props", "k double")["k"]
    return e.select(F.col("user_id").alias("company"), F.col("event_type").alias("model"), F.col("ts").alias("logged_at"),
                    F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k).alias("features"),
                    (k / (k + F.col("value") + 1.0)).alias("prediction"), (F.col("event_id") % 900).cast("int").alias("financials_age_days"))


view("log_p", """SELECT user_id AS company, event_type AS model, ts AS logged_at, value, CAST(props->>'$.k' AS DOUBLE) AS k, CAST(props->>'$.k' AS DOUBLE)
  / (CAST(props->>'$.k' AS DOUBLE) + value + 1.0::DOUBLE) AS prediction, CAST(event_id % 900 AS INT) AS age, ts < TIMESTAMP '2024-01-16' AS ref FROM events""")
view("loglong_p", "SELECT model, 'value' AS feature, value AS v, ref FROM log_p UNION ALL SELECT model, 'k', k, ref FROM log_p UNION ALL SELECT model, 'prediction', prediction, ref FROM log_p")
view("edges_p", """SELECT model, feature, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges
  FROM loglong_p WHERE ref GROUP BY 1, 2 HAVING count(v) >= 50""")
view("bins_p", """SELECT model, feature, ref, bin, count(*) AS c FROM (SELECT l.model, l.feature, l.ref, len(list_filter(e.edges, lambda x: x <= l.v)) AS bin
  FROM loglong_p l JOIN edges_p e ON e.model = l.model AND e.feature = l.feature) GROUP BY ALL""")
view("shares_p", """SELECT e.model, e.feature, b.bin, coalesce(r.c, 0) / (SELECT sum(c) FROM bins_p x WHERE x.model = e.model AND x.feature = e.feature AND x.ref)::DOUBLE AS expected,
  coalesce(v.c, 0) / (SELECT sum(c) FROM bins_p x WHERE x.model = e.model AND x.feature = e.feature AND NOT x.ref)::DOUBLE AS actual,
  (SELECT sum(c) FROM bins_p x WHERE x.model = e.model AND x.feature = e.feature AND NOT x.ref) AS live_n
FROM edges_p e JOIN (SELECT unnest(range(0, 10)) AS bin) b ON b.bin <= len(e.edges) LEFT JOIN (SELECT * FROM bins_p WHERE ref) r ON r.model = e.model AND r.feature = e.feature AND r.bin = b.bin
LEFT JOIN (SELECT * FROM bins_p WHERE NOT ref) v ON v.model = e.model AND v.feature = e.feature AND v.bin = b.bin""")
view("hist_p", """SELECT s.model, s.feature, e.edges, list(expected ORDER BY bin) AS proportions FROM shares_p s JOIN edges_p e ON e.model = s.model AND e.feature = s.feature GROUP BY ALL""")
view("psi_p", """SELECT model, feature, CAST(max(live_n) AS BIGINT) AS live_n, sum((greatest(actual, 1e-4) - greatest(expected, 1e-4)) * ln(greatest(actual, 1e-4) / greatest(expected, 1e-4))) AS psi
FROM shares_p GROUP BY 1, 2""")


def parts(spark, sf):
    g = log(spark, sf)
    ref, live = g.where(F.col("logged_at") < CUT), g.where(F.col("logged_at") >= CUT)
    return ref, live


@query("reference_histograms", """SELECT model, feature, list_transform(edges, lambda x: round(x, 6)) AS edges, list_transform(proportions, lambda x: round(x, 6)) AS proportions
FROM hist_p WHERE feature <> 'prediction'""")
def reference_histograms(spark, sf):
    h = drift.reference_histogram(drift.long_features(parts(spark, sf)[0]), ["model", "feature"])
    r = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return h.select("model", "feature", r("edges"), r("proportions"))


@query("population_stability", "SELECT model, feature, live_n, round(psi, 6) AS psi FROM psi_p WHERE feature <> 'prediction'")
def population_stability(spark, sf):
    ref, live = parts(spark, sf)
    h = materialise(drift.reference_histogram(drift.long_features(ref), ["model", "feature"]))
    return drift.psi(h, drift.long_features(live), ["model", "feature"]).withColumn("psi", F.round("psi", 6))


def report(spark, sf):
    ref, live = parts(spark, sf)
    h = materialise(drift.reference_histogram(drift.long_features(ref), ["model", "feature"]))      # stored with the model
    hp = materialise(drift.reference_histogram(ref.select("model", F.col("prediction").alias("v")), ["model"]))
    return drift.drift_report(h, hp, live)


@query("drift_report", """SELECT l.model, count(*) AS rows, count(DISTINCT company) AS companies, round(any_value(p.psi), 4) AS prediction_psi,
  (SELECT list(feature ORDER BY psi DESC) FROM psi_p q WHERE q.model = l.model AND feature <> 'prediction') AS features,
  CASE WHEN max((SELECT max(psi) FROM psi_p q WHERE q.model = l.model)) > 0.2::DOUBLE THEN 'drift' ELSE 'ok' END AS status
FROM log_p l JOIN psi_p p ON p.model = l.model AND p.feature = 'prediction' WHERE NOT l.ref GROUP BY l.model""")
def drift_report(spark, sf):
    return report(spark, sf).select("model", "rows", "companies", "prediction_psi", F.transform("psi", lambda x: x["feature"]).alias("features"), "status")


@query("freshness_report", "SELECT company, arg_max(age, (logged_at, age)) AS financials_age_days, arg_max(age, (logged_at, age)) > 456 AS stale FROM log_p GROUP BY company")
def freshness_report(spark, sf):
    return drift.freshness_report(log(spark, sf))


@query("recent_inference_log", """SELECT model, count(*) AS rows, count(DISTINCT company) AS companies, round(sum(prediction), 6) AS predictions FROM log_p
WHERE logged_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY model""")
def recent_log(spark, sf):
    """The log appended twice to its folders of days, halves by user, and the last seven days read back."""
    from keelson.plans.intake import scratch
    path = scratch(spark)
    g = log(spark, sf)
    for half in (0, 1):
        drift.append_log(g.where(F.col("company") % 2 == half), path)
    r = drift.read_log(spark, path, "2024-01-31", 7)
    return r.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("company").alias("companies"), F.round(F.sum("prediction"), 6).alias("predictions"))


@query("inference_log_rows", """SELECT event_id, 'k=' || CAST(props->>'$.k' AS INT) || ';n=' || user_id AS features FROM events""")
def inference_log_rows(spark, sf):
    e = views.table(spark, sf, "events")
    k = F.from_json("props", "k double")["k"]
    vals = e.select("event_id", F.inline(F.array(F.struct(F.lit("k").alias("name"), k.alias("value")),
                                                 F.struct(F.lit("n").alias("name"), F.col("user_id").cast("double").alias("value")))))
    rows = drift.log_rows(vals, ["event_id"])
    shown = lambda n: F.concat(F.lit(f"{n}="), F.col("features")[n].cast("int").cast("string"))
    return rows.select("event_id", F.concat_ws(";", shown("k"), shown("n")).alias("features"))


# ------------------------------------------------------------------ scored rows
_SC = """SELECT o.o_orderkey AS id, o.o_orderpriority AS model, CAST(o.o_orderkey * 31 % 7 = 0 AS INT) AS y,
  ((CAST(floor(o.o_totalprice * 100) AS BIGINT) % 700) + 200 * CAST(o.o_orderkey * 31 % 7 = 0 AS INT)) / 1e3 AS prob, o.o_custkey AS grp, year(o.o_orderdate) AS yr FROM {orders} o"""
view("scored_p", _SC.format(orders="orders"))
view("cum_p", """SELECT model, prob, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
FROM (SELECT model, prob, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored_p GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY prob DESC)""")


def scored(spark, sf):
    return spark.sql(_SC, orders=views.table(spark, sf, "orders"))


@query("rank_metrics", """SELECT model, round(sum(pos * (n - fp + neg / 2)) / max(p * n), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM cum_p GROUP BY model""")
def rank_metrics(spark, sf):
    m = evl.rank_metrics(scored(spark, sf), ["model"], "prob", "y")
    return m.select("model", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("binary_metrics", """SELECT model, tp, fp, tn, fn, round(brier, 6) AS brier, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, n FROM (SELECT model, count(*) FILTER (prob >= 0.5::DOUBLE AND y = 1) AS tp, count(*) FILTER (prob >= 0.5::DOUBLE AND y = 0) AS fp,
  count(*) FILTER (prob < 0.5::DOUBLE AND y = 0) AS tn, count(*) FILTER (prob < 0.5::DOUBLE AND y = 1) AS fn, avg((prob - y) * (prob - y)) AS brier, count(*) AS n FROM scored_p GROUP BY model)""")
def binary_metrics(spark, sf):
    m = evl.binary_metrics(scored(spark, sf), ["model"], "prob", "y")
    return m.withColumns({c: F.round(c, 6) for c in ("brier", "precision", "recall", "f1")})


@query("best_f1_threshold", """SELECT model, arg_max(prob, (f1, -prob)) AS threshold, round(max(f1), 6) AS f1 FROM (SELECT *, round(2 * tp / (tp + fp + p), 12) AS f1 FROM cum_p) GROUP BY model""")
def best_threshold(spark, sf):
    return evl.best_f1_threshold(scored(spark, sf), ["model"], "prob", "y").withColumn("f1", F.round("f1", 6))


@query("calibration_table", """SELECT model, bin, round(avg(prob), 6) AS mean_predicted, round(avg(y), 6) AS observed, count(*) AS n FROM (SELECT s.*, len(list_filter(q.e, lambda x: x < s.prob)) AS bin
FROM scored_p s JOIN (SELECT model, quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scored_p GROUP BY model) q USING (model)) GROUP BY model, bin""")
def calibration(spark, sf):
    c = evl.calibration_table(scored(spark, sf), ["model"], "prob", "y")
    return c.select("model", F.col("bin").cast("bigint").alias("bin"), F.round("mean_predicted", 6).alias("mean_predicted"), F.round("observed", 6).alias("observed"), "n")


@query("precision_at_top_fraction", """SELECT model, round(avg(y) FILTER (rn <= k), 6) AS "precision", round(avg(y), 6) AS base_rate, round(avg(y) FILTER (rn <= k) / avg(y), 6) AS lift
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob DESC, id) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY model) * 0.05::DOUBLE)) AS k FROM scored_p) GROUP BY model""")
def precision_at(spark, sf):
    p = evl.precision_at(scored(spark, sf), ["model"], "prob", "y", "id", 0.05)
    return p.select("model", *[F.round(c, 6).alias(c) for c in ("precision", "base_rate", "lift")])


@query("recall_at_positives", """SELECT model, positives, round(sum(y) / positives, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY prob DESC, id) AS rn,
  sum(y) OVER (PARTITION BY model) AS positives FROM scored_p) WHERE rn <= positives GROUP BY model, positives""")
def recall_at(spark, sf):
    return evl.recall_at_positives(scored(spark, sf), ["model"], "prob", "y", "id").withColumn("recall", F.round("recall", 6))


@query("score_ecdf", """SELECT s.id, round(e.ecdf, 6) AS ecdf FROM scored_p s JOIN (SELECT prob, (SELECT count(*) FROM scored_p t WHERE t.yr < 1999 AND t.prob <= d.prob)
  / (SELECT count(*) FROM scored_p t WHERE t.yr < 1999)::DOUBLE AS ecdf FROM (SELECT DISTINCT prob FROM scored_p WHERE yr >= 1999) d) e USING (prob) WHERE s.yr >= 1999""")
def score_ecdf(spark, sf):
    s = scored(spark, sf)
    return evl.ecdf(s.where("yr < 1999"), s.where("yr >= 1999"), "prob").select("id", F.round("ecdf", 6).alias("ecdf"))


@query("risk_band_rates", """SELECT CASE WHEN p < 0.01::DOUBLE THEN 'LOW' WHEN p < 0.03::DOUBLE THEN 'MODERATE' WHEN p < 0.1::DOUBLE THEN 'ELEVATED' ELSE 'HIGH' END AS band, count(*) AS n,
  round(avg(y), 6) AS observed_rate FROM (SELECT y, prob / 5 AS p FROM scored_p) GROUP BY 1""")
def band_rates(spark, sf):
    s = scored(spark, sf).withColumn("band", factors.risk_band(F.col("prob") / 5))
    return s.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("observed_rate"))


@query("class_balance", "SELECT yr AS split, count(*) AS n, sum(y) AS positives, round(sum(1 - y) / greatest(1, sum(y)), 6) AS pos_weight, round(avg(y), 6) AS base_rate FROM scored_p GROUP BY yr")
def class_balance(spark, sf):
    s = scored(spark, sf)
    return s.groupBy(F.col("yr").alias("split")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"),
                                                     F.round(F.sum(1 - F.col("y")) / F.greatest(F.lit(1), F.sum("y")), 6).alias("pos_weight"), F.round(F.avg("y"), 6).alias("base_rate"))


_LABELS = ["negative", "neutral", "positive"]
view("classes_p", "SELECT ['negative', 'neutral', 'positive'][1 + id % 3] AS truth, ['negative', 'neutral', 'positive'][1 + CAST(floor(prob * 1000) AS INT) % 3] AS pred FROM scored_p")


@query("multiclass_metrics", " UNION ALL ".join(f"""SELECT '{x}' AS label, round(count(*) FILTER (truth = '{x}' AND pred = '{x}') / count(*) FILTER (pred = '{x}'), 6) AS "precision",
  round(count(*) FILTER (truth = '{x}' AND pred = '{x}') / count(*) FILTER (truth = '{x}'), 6) AS recall, round(2 * count(*) FILTER (truth = '{x}' AND pred = '{x}')
  / (count(*) FILTER (pred = '{x}') + count(*) FILTER (truth = '{x}')), 6) AS f1, round(avg(CAST(truth = pred AS DOUBLE)), 6) AS accuracy FROM classes_p""" for x in _LABELS))
def multiclass(spark, sf):
    arr = F.array(*[F.lit(x) for x in _LABELS])
    s = scored(spark, sf).select(F.get(arr, (F.col("id") % 3).cast("int")).alias("truth"), F.get(arr, (F.floor(F.col("prob") * 1000) % 3).cast("int")).alias("pred"))
    return evl.multiclass_metrics(s, "truth", "pred", _LABELS).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("rank_metric_interval")
def metric_interval(spark, sf):
    return evl.bootstrap_interval(scored(spark, sf), ["model"], "prob", "y", "id", replicas=50)


@query("index_rating_correlation", """SELECT round(corr(index, mean_rating), 6) AS pearson, round(corr(r1, r2), 6) AS spearman, count(*) AS n FROM (SELECT *,
  (rank() OVER (ORDER BY index) + rank() OVER (ORDER BY index) + count(*) OVER (PARTITION BY index) - 1) / 2.0::DOUBLE AS r1,
  (rank() OVER (ORDER BY mean_rating) + rank() OVER (ORDER BY mean_rating) + count(*) OVER (PARTITION BY mean_rating) - 1) / 2.0::DOUBLE AS r2 FROM index_p)""")
def rating_correlation(spark, sf):
    from keelson.operators import reviews as rv
    from keelson.plans.reviews import firm_reviews
    c = evl.correlations(rv.quarterly_index(firm_reviews(spark, sf)), "index", "mean_rating")
    return c.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query("assignment_stability", """SELECT round((s_ab - s_a * s_b / (n * (n - 1) / 2)) / ((s_a + s_b) / 2 - s_a * s_b / (n * (n - 1) / 2)), 6) AS ari FROM (SELECT
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM scored_p GROUP BY model, id % 4)) AS s_ab, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM scored_p GROUP BY model)) AS s_a,
  (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM scored_p GROUP BY id % 4)) AS s_b, (SELECT count(*)::DOUBLE FROM scored_p) AS n)""")
def assignment_stability(spark, sf):
    s = scored(spark, sf).withColumn("other", F.col("id") % 4)
    return evl.adjusted_rand(s, "model", "other").select(F.round("ari", 6).alias("ari"))


@query("promotion_gate", """SELECT model, 'pr_auc' AS metric, round(v, 6) AS value, passed FROM (SELECT m.model, m.v, m.v > b.v AND m.v > m.v * 0.9::DOUBLE + 0.005::DOUBLE AS passed
FROM (SELECT model, sum(pos * tp / (tp + fp)) / max(p) AS v FROM cum_p GROUP BY model) m JOIN (SELECT model, avg(y) AS v FROM scored_p GROUP BY model) b USING (model))""")
def promotion_gate(spark, sf):
    s = scored(spark, sf)
    runs = evl.rank_metrics(s, ["model"], "prob", "y").select("model", F.lit("pr_auc").alias("metric"), F.col("pr_auc").alias("value"), F.lit(False).alias("lower_is_better"),
                                                             F.lit(0.005).alias("margin"), F.lit(True).alias("card_complete"))
    base = s.groupBy("model").agg(F.avg("y").alias("value")).withColumn("metric", F.lit("pr_auc"))
    champ = runs.select("model", "metric", (F.col("value") * 0.9).alias("value"))
    return evl.promotion_gate(runs, base, champ).select("model", "metric", F.round("value", 6).alias("value"), "passed")


# ------------------------------------------------------------------ generated-text validation
_plain = ", ".join(str(float(x)) for x in PLAIN_NUMBERS)


@query("ungrounded_numbers", f"""SELECT a.conv_id, a.turn AS id, list_filter(regexp_extract_all(a.text, '-?[0-9]+(?:\\.[0-9]+)?'), lambda m: NOT (CAST(m AS DOUBLE) IN ({_plain}) OR CAST(m AS DOUBLE) BETWEEN 1900 AND 2100)
  AND len(list_filter(coalesce(f.numbers, []), lambda x: least(abs(CAST(m AS DOUBLE) - x), abs(CAST(m AS DOUBLE) / 100 - x), abs(CAST(m AS DOUBLE) * 100 - x), abs(CAST(m AS DOUBLE) * 1e9 - x),
    abs(CAST(m AS DOUBLE) * 1e6 - x)) <= greatest(0.051::DOUBLE, abs(x) * 0.006::DOUBLE))) = 0) AS unsupported,
  regexp_matches(a.text, '{ADVICE}') AS advice
FROM conversations a LEFT JOIN (SELECT conv_id, list_distinct(flatten(list(list_transform(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'), lambda m: CAST(m AS DOUBLE))))) AS numbers
  FROM conversations WHERE role <> 'assistant' GROUP BY conv_id) f USING (conv_id) WHERE a.role = 'assistant'""")
def ungrounded(spark, sf):
    c = views.table(spark, sf, "conversations")
    nums = F.transform(F.regexp_extract_all("text", F.lit(r"(-?\d+(?:\.\d+)?)")), lambda m: m.cast("double"))
    facts = (c.where("role <> 'assistant'").select("conv_id", F.explode(nums).alias("x")).groupBy("conv_id").agg(F.collect_set("x").alias("numbers")))
    return evl.grounding_problems(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("id"), "text"), facts, "conv_id")


@query("unknown_evidence", """SELECT report_id, list_sort(list(code)) AS unknown FROM report_signals WHERE code NOT IN ('BANKRUPTCY', 'RESTATEMENT') GROUP BY report_id""")
def unknown_evidence(spark, sf):
    from keelson.plans.serving import reports
    r = reports(spark, sf).withColumn("used", F.transform("signals", lambda s: s["code"]))
    gone = evl.unknown_evidence(F.col("used"), F.array(F.lit("BANKRUPTCY"), F.lit("RESTATEMENT")))
    return r.select("report_id", F.array_sort(gone).alias("unknown")).where(F.size("unknown") > 0)
