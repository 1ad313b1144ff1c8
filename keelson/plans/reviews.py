"""Employee-review queries over the documents table (source = firm)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import reviews as rv
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query

AS_OF = "2021-03-31"
_REV = """SELECT d.source AS firm, d.doc_id AS review_id, DATE '2020-01-01' + CAST(d.doc_id % 365 AS INT) AS date_review,
  CAST(1 + d.n_chars % 5 AS INT) AS overall_rating, (d.n_chars % 5 - 2) / 2e0 * 9e-1 + ((d.doc_id * 31) % 21 - 10) / 10371e-2 AS polarity,
  d.lang AS headline, CASE WHEN d.doc_id % 3 <> 0 THEN d.text END AS pros, d.text AS cons
FROM {documents} d"""
view("reviews_p", _REV.format(documents="documents"))
view("firm_reviews_p", f"""SELECT CAST(substr(firm, 4) AS INT) % 17 + 1 AS cik, * FROM reviews_p WHERE date_review <= DATE '{AS_OF}'""")
view("index_p", """SELECT cik, year(date_review) || 'Q' || quarter(date_review) AS quarter, avg(polarity) AS index, count(*) AS reviews,
  avg(CAST(overall_rating AS DOUBLE)) AS mean_rating FROM firm_reviews_p GROUP BY 1, 2""")


def reviews(spark, sf):
    return spark.sql(_REV, documents=views.table(spark, sf, "documents"))


def firm_map(spark, sf):
    """Firm name -> company; several names share a company."""
    return (views.table(spark, sf, "documents").select(F.col("source").alias("firm")).distinct()
            .withColumn("cik", F.expr("CAST(substr(firm, 4) AS INT) % 17 + 1")))


def firm_reviews(spark, sf):
    return rv.map_firms(reviews(spark, sf), firm_map(spark, sf), AS_OF)


@query("reviews_by_company", "SELECT cik, firm, count(*) AS n, max(date_review) AS last FROM firm_reviews_p GROUP BY 1, 2")
def by_company(spark, sf):
    return firm_reviews(spark, sf).groupBy("cik", "firm").agg(F.count("*").alias("n"), F.max("date_review").alias("last"))


@query("review_texts", """SELECT review_id, md5(coalesce(headline, '') || '. Pros: ' || coalesce(pros, '') || '. Cons: '
  || coalesce(cons, '')) AS digest FROM reviews_p""")
def review_texts(spark, sf):
    from keelson.functions.text import review_text
    return reviews(spark, sf).select("review_id", F.md5(review_text()).alias("digest"))


@query("employee_index", "SELECT cik, quarter, round(index, 6) AS index, reviews, round(mean_rating, 6) AS mean_rating FROM index_p")
def employee_index(spark, sf):
    i = rv.quarterly_index(firm_reviews(spark, sf))
    return i.withColumns({c: F.round(c, 6) for c in ("index", "mean_rating")})


@query("employee_index_interval")
def employee_interval(spark, sf):
    return rv.bootstrap_interval(firm_reviews(spark, sf))


view("usable_p", "SELECT * FROM index_p WHERE reviews >= 10")
view("trend_p", """SELECT cik, quarter, index, CASE WHEN n >= 4 THEN round_even((SELECT quantile_cont((b.index - a.index) / (b.k - a.k), 0.5) FROM
  last4_p a JOIN last4_p b ON a.cik = b.cik AND a.k < b.k WHERE a.cik = t.cik), 4) END AS trend
FROM (SELECT cik, max(quarter) AS quarter, arg_max(index, quarter) AS index, count(*) AS n FROM last4_p GROUP BY cik) t""")
view("last4_p", """SELECT *, row_number() OVER (PARTITION BY cik ORDER BY quarter) AS k FROM (SELECT *, row_number() OVER (PARTITION BY cik
  ORDER BY quarter DESC) AS rn FROM usable_p) WHERE rn <= 4""")


@query("employee_index_trend", "SELECT cik, quarter, round(index, 6) AS index, trend FROM trend_p")
def employee_trend(spark, sf):
    t = rv.index_trend(rv.usable_quarters(rv.quarterly_index(firm_reviews(spark, sf))))
    return t.withColumn("index", F.round("index", 6))


_THEMES = ["pay", "hours", "team", "lead"]
view("weights_p", " UNION ALL ".join(f"SELECT cik, review_id, '{t}' AS theme, (review_id * {7 + 4 * i} + {i}) % 11 AS w FROM firm_reviews_p"
                                     for i, t in enumerate(_THEMES)))


@query("theme_shares", """SELECT cik, theme, round(avg(w / greatest(t, 1e-12)), 6) AS share FROM (SELECT *, sum(w) OVER
  (PARTITION BY cik, review_id) AS t FROM weights_p) GROUP BY cik, theme""")
def theme_shares(spark, sf):
    r = firm_reviews(spark, sf)
    entries = F.array(*[F.struct(F.lit(t).alias("theme"), ((F.col("review_id") * (7 + 4 * i) + i) % 11).cast("double").alias("w"))
                        for i, t in enumerate(_THEMES)])
    w = r.select("cik", "review_id", F.inline(entries))
    return rv.theme_shares(w).withColumn("share", F.round("share", 6))
