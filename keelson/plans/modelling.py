"""Model queries: splits, fitted preprocessing, classifiers, anomalies, segments, forecasts and text models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions import numeric as num
from keelson.models import anomaly, distress, forecast, prepare, segments, splits, texts
from keelson.operators import evaluate as evl
from keelson.operators import market, pit, series
from keelson.plans import market as pm
from keelson.plans import pointintime as pp
from keelson.plans import text as pt
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query
from keelson.session import materialise, shared

YEARS = {"train": (1995, 1998), "validation": (1999, 1999), "test": (2000, 2001)}
MODEL_FEATURES = [f for f in pp.STORED if not f.startswith("bn_")]


def dataset(spark, sf):
    """The stored distress dataset."""
    return shared(spark, f"distress:{sf}", lambda: materialise(pp.run_distress(spark, sf)))


def split_dataset(spark, sf):
    return splits.time_split(dataset(spark, sf), "year", YEARS)


_SPLIT = "CASE WHEN year(filed) BETWEEN 1995 AND 1998 THEN 'train' WHEN year(filed) = 1999 THEN 'validation' ELSE 'test' END"


# ------------------------------------------------------------------ splits
@query("split_by_year", f"SELECT accn, {_SPLIT} AS split FROM annual_p")
def split_by_year(spark, sf):
    a = pp.annual_filings(spark, sf).withColumn("year", F.year("filed"))
    return splits.time_split(a, "year", YEARS).select("accn", "split")


@query("split_by_group", """SELECT c_custkey, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM customer)""")
def split_by_group(spark, sf):
    return splits.group_split(views.table(spark, sf, "customer"), "c_custkey").select("c_custkey", "split")


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 500")
def seeded_sample(spark, sf):
    return splits.sample_n(views.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 42)


_SEG_OK = " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in segments.FEATURES)


@query("company_cross_section", f"""SELECT cik, accn, as_of FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY as_of DESC, accn DESC) AS rn FROM distress_p
WHERE year = 2000) WHERE rn = 1 AND {_SEG_OK} >= 6""")
def company_cross_section(spark, sf):
    return splits.cross_section(dataset(spark, sf), 2000, segments.FEATURES).select("cik", "accn", "as_of")


@query("rows_with_enough_features", "SELECT cik, accn FROM distress_p WHERE "
       + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in anomaly.FINANCIAL) + " >= 6")
def enough_features(spark, sf):
    return num.min_present(dataset(spark, sf), anomaly.FINANCIAL, 6).select("cik", "accn")


# ------------------------------------------------------------------ fitted preprocessing
_FIT = ["net_margin", "current_ratio", "altman_z2", "bn_tata"]


@query("winsor_bounds", " UNION ALL ".join(f"""SELECT '{f}' AS feature, count({f}) AS n, round(quantile_cont({f}, 0.01), 5) AS low, round(quantile_cont({f}, 0.5), 5) AS median,
  round(quantile_cont({f}, 0.99), 5) AS high FROM ratios_one""" for f in _FIT))
def winsor_bounds(spark, sf):
    from keelson.operators import ranking, ratios
    from keelson.operators.snapshot import snapshot
    feats = ratios.compute_features(ratios.without_filing(snapshot(views.facts(spark, sf), pp.one_date(spark, sf))))
    q = ranking.quantiles(ranking.melt(feats, [], _FIT), ["feature"], "v", [0.01, 0.5, 0.99])
    at = lambda i: F.round(F.get("quantiles", F.lit(i)), 5)
    return q.select("feature", "n", at(0).alias("low"), at(1).alias("median"), at(2).alias("high"))


@query("winsorised_values", "SELECT event_id, greatest(10::DOUBLE, least(100::DOUBLE, value)) AS clipped, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) AS signed_log FROM events")
def winsorised(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", num.winsorise("value", F.lit(10.0), F.lit(100.0)).alias("clipped"), F.round(num.signed_log(F.col("value") - 50), 6).alias("signed_log"))


# ------------------------------------------------------------------ distress model
def fitted_distress(spark, sf):
    return shared(spark, f"classifiers:{sf}", lambda: fit_distress(spark, sf))


def prepared(spark, sf):
    return shared(spark, f"prepared:{sf}", lambda: distress.prepared(split_dataset(spark, sf), MODEL_FEATURES))


def fit_distress(spark, sf):
    ready = prepared(spark, sf)
    grid = {"logistic_regression": [{"reg": 0.01}, {"reg": 0.1}], "random_forest": [{"trees": 20}], "boosted_trees": [{"rounds": 8, "depth": 3}]}
    models, table = distress.fit_candidates(ready, MODEL_FEATURES, grid)
    return ready, models, table


@query("distress_candidates")
def distress_candidates(spark, sf):
    return fitted_distress(spark, sf)[2]


@query("distress_calibration")
def distress_calibration(spark, sf):
    """Test-split Brier scores of the chosen model: raw, Platt and isotonic."""
    ready, models, table = fitted_distress(spark, sf)
    scored = materialise(distress.score(models[distress.best(table)], ready).select("split", "label", "prob"))
    va = scored.where("split = 'validation'")
    out = distress.calibrated(distress.platt(va), scored.where("split = 'test'")).select("label", "prob", "calibrated")
    both = distress.isotonic(va).transform(out)
    err = lambda c: F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label")))
    return both.agg(err("prob").alias("brier_raw"), err("calibrated").alias("brier_platt"), err("isotonic").alias("brier_isotonic"), F.count("*").alias("n"))


def linear_model(spark, sf):
    ready, models, _ = fitted_distress(spark, sf)
    m = models["logistic_regression#0"]
    return m, m.transform(ready.where("split = 'test'"))


@query("distress_drivers")
def distress_drivers(spark, sf):
    m, test = linear_model(spark, sf)
    return distress.contributions(m, test, MODEL_FEATURES).select("cik", "accn", "drivers")


@query("feature_importance")
def feature_importance(spark, sf):
    m, test = linear_model(spark, sf)
    return distress.importance(distress.contributions(m, test, MODEL_FEATURES, top=len(MODEL_FEATURES)))


@query("feature_group_ablation")
def feature_group_ablation(spark, sf):
    return distress.ablation(prepared(spark, sf), MODEL_FEATURES)


# ------------------------------------------------------------------ anomalies
def statement_scores(spark, sf):
    rows = num.min_present(split_dataset(spark, sf), anomaly.FINANCIAL, 6)
    scaled = materialise(prepare.robust_scale(rows.withColumn("row_id", F.xxhash64("accn")), anomaly.FINANCIAL, rows.where("split = 'train'")))
    forest = anomaly.fit_forest(scaled.where("split = 'train'"), "row_id", anomaly.FINANCIAL, trees=50)
    return materialise(anomaly.score_forest(scaled, anomaly.FINANCIAL, forest))


@query("statement_anomalies")
def statement_anomalies(spark, sf):
    """Test filings with their calibrated anomaly score and the three largest deviations."""
    s = statement_scores(spark, sf)
    e = evl.ecdf(s.where("split = 'train'"), s.where("split = 'test'"), "raw_score")
    return anomaly.top_deviations(e, anomaly.FINANCIAL).select("cik", "accn", "ecdf", "drivers")


@query("statement_injection_benchmark")
def statement_injection(spark, sf):
    rows = num.min_present(split_dataset(spark, sf), anomaly.FINANCIAL, 6).withColumn("row_id", F.xxhash64("accn"))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    forest = anomaly.fit_forest(prepare.robust_scale(train, anomaly.FINANCIAL, train), "row_id", anomaly.FINANCIAL, trees=50)
    inj = prepare.robust_scale(anomaly.inject_statements(test, "row_id", 0.05), anomaly.FINANCIAL, train)
    return evl.rank_metrics(anomaly.score_forest(inj, anomaly.FINANCIAL, forest), [], "raw_score", "injected")


def injected_market(spark, sf):
    z = market.background_days(market.robust_z(pm.bars(spark, sf))).where("ordinary")
    z = z.withColumn("row_id", F.concat_ws("|", "ticker", F.date_format("bar", "yyyyMMddHH")))
    return anomaly.inject_market(z, "row_id", 0.05)


@query("market_injection_labels", """SELECT ticker, bar, CAST(('0x' || substr(md5(ticker || '|' || strftime(bar, '%Y%m%d%H') || ':pick'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.05::DOUBLE AS INT) AS injected
FROM maxz_p WHERE max_z < 4""")
def market_labels(spark, sf):
    return injected_market(spark, sf).select("ticker", "bar", "injected")


@query("market_injection_benchmark")
def market_benchmark(spark, sf):
    """The rule and the forest on injected shocks; the forest is fitted on the first half of the bars."""
    cols = ["ret_z", "abs_ret_z", "volume_z", "range_z", "gap_z"]
    inj = materialise(market.max_abs_z(injected_market(spark, sf)).withColumn("half", F.when(F.to_date("bar") < "2024-01-16", "train").otherwise("test")))
    forest = anomaly.fit_forest(inj.where("half = 'train' and injected = 0"), "row_id", cols, trees=50)
    te = anomaly.score_forest(inj.where("half = 'test'"), cols, forest)
    rule = evl.rank_metrics(te, [], "max_z", "injected").withColumn("detector", F.lit("max_abs_z"))
    return rule.unionByName(evl.rank_metrics(te, [], "raw_score", "injected").withColumn("detector", F.lit("isolation_forest")))


view("hit_p", "SELECT ticker, bar, max_z, max_z >= quantile_cont(max_z, 0.95) OVER (PARTITION BY ticker) AS flagged, CAST(bar AS DATE) AS day FROM maxz_p")


@query("event_hit_rate", """SELECT ticker, count(*) AS event_bars, round(avg(CAST(flagged AS DOUBLE)), 6) AS hit_rate, round(avg(CAST(flagged AS DOUBLE)) / 0.05::DOUBLE, 6) AS lift FROM hit_p
WHERE day(day) % 7 IN (0, 1) GROUP BY ticker""")
def event_hit_rate(spark, sf):
    """Share of bars on event days (every seventh day and the next) among the top 5% deviations, against the base rate."""
    from keelson.operators.ranking import quantiles
    z = market.max_abs_z(market.robust_z(pm.bars(spark, sf)))
    cut = quantiles(z, ["ticker"], "max_z", [0.95]).select("ticker", F.get("quantiles", F.lit(0)).alias("cut"))
    j = z.join(cut, "ticker").where(F.dayofmonth("bar") % 7 < 2).withColumn("hit", (F.col("max_z") >= F.col("cut")).cast("double"))
    return j.groupBy("ticker").agg(F.count("*").alias("event_bars"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("hit") / 0.05, 6).alias("lift"))


# ------------------------------------------------------------------ segments
def cross_sections(spark, sf):
    d = dataset(spark, sf)
    return [materialise(splits.cross_section(d, y, segments.FEATURES)) for y in (2000, 1999)]


def segmented(spark, sf):
    return shared(spark, f"segments:{sf}", lambda: fit_segments(spark, sf))


def fit_segments(spark, sf):
    now, before = cross_sections(spark, sf)
    z = materialise(segments.vectorise(prepare.rank_normal(now, "cik", segments.FEATURES), segments.FEATURES))
    rows, km = segments.choose_k(z)
    centres = [list(map(float, c)) for c in km.clusterCenters()]
    names = segments.cluster_names(spark, centres)
    return now, before, z, rows, km, segments.assign(z, centres, names)


@query("segment_choice")
def segment_choice(spark, sf):
    """Silhouettes by k for k-means and the mixture, next to the sector baseline and Davies-Bouldin of the chosen k."""
    now, _, z, rows, km, assigned = segmented(spark, sf)
    codes = now.select("sector").distinct().withColumn("s", (F.dense_rank().over(W.orderBy("sector")) - 1).cast("double"))     # a dozen sectors
    base = segments.silhouette(z.join(now.select("cik", "sector").join(codes, "sector").select("cik", "s"), "cik"), "s")
    out = spark.createDataFrame([(k, a, b) for k, a, b in rows], "k int, kmeans_silhouette double, mixture_silhouette double")
    db = segments.davies_bouldin(assigned, "cluster").scalar()
    return out.withColumns({"sector_silhouette": F.lit(float(base)), "chosen": F.col("k") == len(km.clusterCenters()), "davies_bouldin": db})


@query("company_segments")
def company_segments(spark, sf):
    return segmented(spark, sf)[5].select("cik", "cluster", "segment", "membership")


@query("segment_profiles")
def segment_profiles(spark, sf):
    now, _, _, _, _, assigned = segmented(spark, sf)
    j = assigned.select("cik", "segment").join(now, "cik")
    return segments.segment_profile(j, ["net_margin", "revenue_yoy", "liabilities_assets", "current_ratio"])


@query("segment_stability")
def segment_stability(spark, sf):
    """Adjusted Rand index of this year's segments against clusters fitted on the year before."""
    now, before, z, _, km, assigned = segmented(spark, sf)
    from pyspark.ml.clustering import KMeans
    zp = segments.vectorise(prepare.rank_normal(before, "cik", segments.FEATURES), segments.FEATURES)
    older = KMeans(k=len(km.clusterCenters()), seed=42).fit(zp).transform(z).select("cik", F.col("prediction").alias("older"))
    return evl.adjusted_rand(assigned.join(older, "cik"), "cluster", "older")


@query("segment_projection")
def segment_projection(spark, sf):
    z = segmented(spark, sf)[5]
    p = segments.project(z)
    return p.select("cik", "segment", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


_SEGVIEW = "CASE WHEN net_margin < 0 THEN 'loss' WHEN current_ratio < 1 THEN 'tight' ELSE 'other' END"


@query("rule_segment_profile", f"""SELECT {_SEGVIEW} AS segment, count(*) AS companies, round(avg(label), 6) AS label_rate, round(quantile_cont(net_margin, 0.5), 5) AS net_margin,
  round(quantile_cont(current_ratio, 0.5), 5) AS current_ratio FROM distress_p GROUP BY 1""")
def rule_segment_profile(spark, sf):
    d = pp.rounded(dataset(spark, sf), ["net_margin", "current_ratio"]).withColumn("segment", F.expr(_SEGVIEW))
    p = segments.segment_profile(materialise(d.select("segment", "label", "net_margin", "current_ratio")), ["net_margin", "current_ratio"])
    return p.select("segment", "companies", F.round("label_rate", 6).alias("label_rate"), F.round("net_margin", 5).alias("net_margin"), F.round("current_ratio", 5).alias("current_ratio"))


# ------------------------------------------------------------------ forecasts
def restated_quarters(spark, sf, item="Revenue"):
    """Series as finally known (restated values included), of every non-financial company."""
    co = views.companies(spark, sf).where("NOT financial").select("cik", F.lit("2100-01-01").cast("date").alias("as_of"))
    facts = views.facts(spark, sf).where(F.col("item") == item)
    known = pit.known_as_of(facts, co)
    return series.quarterly_series(known, ["cik", "as_of"]).select("cik", "end", "val")


view("asofs_end", "SELECT cik, DATE '2100-01-01' AS as_of FROM companies_s WHERE NOT financial")
pp.register_asof_views("end")
view("run_p", """SELECT cik, "end", val FROM (SELECT *, max(run) OVER (PARTITION BY cik) AS last FROM (SELECT *, sum(brk) OVER (PARTITION BY cik ORDER BY "end") AS run FROM (
  SELECT cik, "end", val, CAST(coalesce(date_diff('day', lag("end") OVER (PARTITION BY cik ORDER BY "end"), "end") NOT BETWEEN 75 AND 105, false) AS INT) AS brk FROM quar_end WHERE item = 'Revenue'))) WHERE run = last""")
_l = lambda k: f"lag(val, {k}) OVER w"
view("origins_p", f"""SELECT *, avg(abs(val - v4)) OVER (PARTITION BY cik ORDER BY "end" ROWS UNBOUNDED PRECEDING) AS mase_scale, (abs(val) + abs(v1) + abs(v2) + abs(v3)) / 4 AS scale FROM (
  SELECT cik, "end", val, {', '.join(f'{_l(k)} AS v{k}' for k in range(1, 8))}, {', '.join(f'lead(val, {h}) OVER w AS f{h}, lead("end", {h}) OVER w AS e{h}' for h in range(1, 5))},
  row_number() OVER w AS idx, count(*) OVER (PARTITION BY cik) AS n FROM run_p WINDOW w AS (PARTITION BY cik ORDER BY "end"))""")
_steps = [f"(({'val' if k == 0 else f'v{k}'} - v{k + 1}) / scale)" for k in range(7)]
_mean = "((" + " + ".join(_steps) + ") / 7)"
view("fc_rows", " UNION ALL ".join(f"""SELECT cik, "end" AS origin, {h} AS horizon, f{h} AS y, e{h} AS target_end, {'val' if h == 4 else f'v{4 - h}'} AS seasonal, val AS last, scale, mase_scale, val / scale AS lag_0, v7 / scale AS lag_7,
  CASE WHEN v4 <> 0 THEN val / v4 END AS yoy_ratio, CASE WHEN v4 + v5 + v6 + v7 > 0 THEN (val + v1 + v2 + v3) / (v4 + v5 + v6 + v7) - 1 END AS growth_4q,
  sqrt(({' + '.join(f'({s} - {_mean}) * ({s} - {_mean})' for s in _steps)}) / 7) AS volatility, quarter("end" + {91 * h}) AS quarter, log10(scale) AS log_scale
  FROM origins_p WHERE n >= 14 AND idx >= 8 AND scale > 0 AND f{h} IS NOT NULL""" for h in range(1, 5)))
_FC = ["mase_scale", "lag_0", "lag_7", "yoy_ratio", "growth_4q", "volatility", "log_scale"]


@query("regular_quarter_runs", 'SELECT cik, "end", val FROM run_p')
def regular_runs(spark, sf):
    return series.regular_run(restated_quarters(spark, sf), ["cik"])


@query("forecast_rows", "SELECT cik, origin, horizon, y, target_end, seasonal, last, quarter, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FC) + " FROM fc_rows")
def forecast_rows(spark, sf):
    r = forecast.forecast_rows(restated_quarters(spark, sf))
    return r.select("cik", "origin", "horizon", "y", "target_end", "seasonal", "last", F.col("quarter").cast("bigint").alias("quarter"), *[F.round(c, 6).alias(c) for c in _FC])


ENDS = ("1999-12-31", "2000-06-30", "2001-12-31")


@query("forecast_split", f"""SELECT split, horizon, count(*) AS n FROM (SELECT *, CASE WHEN target_end <= DATE '{ENDS[0]}' THEN 'train' WHEN target_end <= DATE '{ENDS[1]}' AND origin <= DATE '{ENDS[0]}' THEN 'calib'
  WHEN target_end > DATE '{ENDS[1]}' AND target_end <= DATE '{ENDS[2]}' AND origin <= DATE '{ENDS[1]}' THEN 'test' END AS split FROM fc_rows) WHERE split IS NOT NULL GROUP BY 1, 2""")
def forecast_split(spark, sf):
    return splits.forecast_split(forecast.forecast_rows(restated_quarters(spark, sf)), *ENDS).groupBy("split", "horizon").agg(F.count("*").alias("n"))


@query("naive_forecast_errors", " UNION ALL ".join(f"""SELECT '{n}' AS method, horizon, round(avg(abs(y - {c}) / mase_scale), 6) AS mase, round(avg(2 * abs(y - {c}) / greatest(abs(y) + abs({c}), 1e-9)), 6) AS smape,
  count(*) AS n FROM fc_rows WHERE mase_scale > 0 GROUP BY horizon""" for n, c in (("naive", "last"), ("seasonal_naive", "seasonal"))))
def naive_errors(spark, sf):
    r = materialise(forecast.forecast_rows(restated_quarters(spark, sf)))
    parts = [evl.forecast_errors(r, ["horizon"], "y", c, "mase_scale").withColumn("method", F.lit(n)) for n, c in (("naive", "last"), ("seasonal_naive", "seasonal"))]
    return parts[0].unionByName(parts[1]).select("method", "horizon", F.round("mase", 6).alias("mase"), F.round("smape", 6).alias("smape"), "n")


def forecasts(spark, sf):
    rows = materialise(splits.forecast_split(forecast.forecast_rows(restated_quarters(spark, sf)), *ENDS))
    model = forecast.fit_global(rows.where("split = 'train'"), rounds=10)
    pred = materialise(forecast.predict(model, rows.where("split <> 'train'")))
    return forecast.conformal(pred.where("split = 'calib'"), pred.where("split = 'test'"))


@query("conformal_forecasts")
def conformal_forecasts(spark, sf):
    return forecasts(spark, sf).select("cik", "origin", "horizon", "target_end", "y", "p10", "p50", "p90")


SETTING = (0.5, 0.2, 0.1, 0.9)                    # level, trend, season, damping
_a, _b, _g, _phi = (f"{x}::DOUBLE" for x in SETTING)
view("damped_series", """SELECT cik, list(val ORDER BY "end") AS y, list("end" ORDER BY "end") AS ends, count(*) AS n FROM run_p GROUP BY cik HAVING count(*) >= 14""")


@query("damped_trend_forecasts", f"""WITH RECURSIVE start AS (SELECT cik, y, ends, n, (y[1] + y[2] + y[3] + y[4]) / 4 AS base, (y[5] + y[6] + y[7] + y[8]) / 4 AS later FROM damped_series),
walk AS (
  SELECT cik, 4::BIGINT AS t, base AS level, (later - base) / 4 AS trend, [y[1] - base, y[2] - base, y[3] - base, y[4] - base] AS s FROM start
  UNION ALL
  SELECT cik, t + 1, new, {_b} * (new - level) + (1 - {_b}) * {_phi} * trend, [s[2], s[3], s[4], {_g} * (v - new) + (1 - {_g}) * s[1]]
  FROM (SELECT w.*, x.y[w.t + 1] AS v, {_a} * (x.y[w.t + 1] - w.s[1]) + (1 - {_a}) * (w.level + {_phi} * w.trend) AS new FROM walk w JOIN start x ON x.cik = w.cik AND w.t < x.n))
SELECT w.cik, x.ends[w.t] AS origin, h.h AS horizon, round(w.level + h.damp * w.trend + w.s[h.h], 2) AS damped FROM walk w JOIN start x ON x.cik = w.cik
CROSS JOIN (VALUES {", ".join(f"({h}, {sum(SETTING[3] ** k for k in range(1, h + 1))}::DOUBLE)" for h in range(1, 5))}) AS h(h, damp) WHERE w.t >= 8""")
def damped_trend_forecasts(spark, sf):
    """The damped baseline with one setting, from every origin."""
    return forecast.damped_baseline(restated_quarters(spark, sf), [SETTING]).withColumn("damped", F.round("damped", 2))


@query("forecast_evaluation")
def forecast_evaluation(spark, sf):
    """Errors by method and the coverage of the 80% intervals on the test split."""
    q = materialise(restated_quarters(spark, sf))
    f = materialise(forecasts(spark, sf).join(forecast.damped_baseline(q), ["cik", "origin", "horizon"], "left"))
    out = None
    for name, c in (("naive", "last"), ("seasonal_naive", "seasonal"), ("boosted", "p50"), ("damped_trend", "damped")):
        m = evl.forecast_errors(f, [], "y", c, "mase_scale").withColumn("method", F.lit(name))
        out = m if out is None else out.unionByName(m)
    cover = f.agg(F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("double"))).scalar()
    return out.withColumn("coverage_80", F.when(F.col("method") == "boosted", cover))


# ------------------------------------------------------------------ text models
def labelled_articles(spark, sf):
    return pt.articles(spark, sf).select("article_id", "cik", F.col("title").alias("text"), "label", "polarity")


@query("headline_classifier")
def headline_classifier(spark, sf):
    """Macro F1 by regularisation on a held-out group of outlets."""
    a = splits.group_split(labelled_articles(spark, sf), "article_id").withColumn("chars", texts.char_ngrams("text"))
    a = materialise(a)
    out = None
    for reg in (0.01, 0.1):
        m = texts.sentiment_pipeline(reg).fit(a.where("split = 'train'"))
        scored = texts.classify(m, a.where("split <> 'train'")).withColumn("reg", F.lit(reg))
        r = evl.multiclass_metrics(scored, "label", "predicted", texts.LABELS).withColumn("reg", F.lit(reg))
        out = r if out is None else out.unionByName(r)
    return out


@query("complaint_themes")
def complaint_themes(spark, sf):
    from keelson.operators import reviews as rv
    from keelson.plans.reviews import firm_reviews
    r = materialise(firm_reviews(spark, sf).select("cik", "review_id", "cons"))
    m = texts.fit_themes(r, "cons", k=8, iterations=5)
    return rv.theme_shares(texts.theme_weights(m, r, texts.topic_names(m)).select("cik", "review_id", "theme", "w"))


_lex = " ".join(f"WHEN '{w}' THEN {v}" for w, v in texts.LEXICON.items())


@query("lexicon_labels", f"""SELECT article_id, CASE WHEN s >= 0.05::DOUBLE THEN 'positive' WHEN s <= -0.05::DOUBLE THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT article_id, coalesce(list_avg(list_filter(
  list_transform(regexp_extract_all(lower(title), '[a-z]+'), lambda w: CASE w {_lex} END), lambda x: x IS NOT NULL)), 0) AS s FROM articles_p)""")
def lexicon_labels(spark, sf):
    return pt.articles(spark, sf).select("article_id", texts.lexicon_label("title").alias("label"))


@query("rating_labels", "SELECT review_id, CASE WHEN overall_rating <= 2 THEN 'negative' WHEN overall_rating = 3 THEN 'neutral' ELSE 'positive' END AS label FROM reviews_p")
def rating_labels(spark, sf):
    from keelson.plans.reviews import reviews
    return reviews(spark, sf).select("review_id", texts.rating_label(F.col("overall_rating")).alias("label"))


@query("vector_outliers")
def vector_outliers(spark, sf):
    """Isolation scores of the embedding vectors on all their coordinates."""
    e = views.table(spark, sf, "embeddings")
    cols = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    wide = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    return anomaly.score_forest(wide, cols, anomaly.fit_forest(wide, "vec_id", cols, trees=50)).select("vec_id", "raw_score")
