"""Headline queries over the documents table (source = outlet and company, labels = polarity). A headline is the first line, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import text
from keelson.operators import news
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query

AS_OF = "2024-03-31"
PHRASES = ["announces quarterly results", "to lay off staff", "sued over data breach", "CEO steps down", "probe widens",
           "cuts 500 jobs", "acquisition talks", "reports outage", "opens plant"]
_phrase = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"
_cik = "CAST(substr(d.source, 4) AS INT) + 1"
_pol = "CASE WHEN l.quality IS NULL THEN ((d.doc_id * 37) % 201 - 100) / 1e2 ELSE (l.quality - l.toxic) * 8e-1 END"
_ART = f"""SELECT {_cik} AS cik, d.doc_id AS article_id, split_part(d.text, chr(10), 1) || ' ' || {_phrase.replace('doc_id', 'd.doc_id')} AS title,
  'http://' || d.source || '/' || d.doc_id AS url, d.source AS domain, {{ts}} AS published_at, {_pol} AS polarity
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id"""
_secs = "1704067200 + (d.doc_id % 120) * 86400 + (d.doc_id * 7919) % 86400"
_LABEL = "CASE WHEN polarity > 3e-1 THEN 'positive' WHEN polarity < -3e-1 THEN 'negative' ELSE 'neutral' END"
view("articles_p", f"SELECT *, {_LABEL} AS label FROM ("
     + _ART.format(ts=f"make_timestamp(({_secs}) * 1000000)", documents="documents", labels="labels") + ")")


def articles(spark, sf):
    sql = _ART.replace("{ts}", f"timestamp_seconds({_secs})")
    df = spark.sql(sql, documents=views.table(spark, sf, "documents"), labels=views.table(spark, sf, "labels"))
    return df.withColumn("label", F.expr(_LABEL))


def at_date(df, as_of=AS_OF):
    return df.withColumn("as_of", F.lit(as_of).cast("date"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
view("tokens_p", f"""SELECT cik, article_id, published_at, array_to_string(words, ' ') AS norm, list_sort(list_distinct(list_transform(
  list_filter(words, lambda w: w NOT IN ({_STOP})), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|ed|es|s)$', '')
  ELSE w END))) AS tokens FROM (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS words FROM articles_p)""")


@query("normalised_titles", "SELECT article_id, norm, tokens FROM tokens_p")
def normalised_titles(spark, sf):
    return articles(spark, sf).select("article_id", text.normalise_title("title").alias("norm"),
                                      text.content_tokens("title").alias("tokens"))


@query("headlines_without_exact_copies", """SELECT article_id FROM (SELECT article_id, row_number() OVER (PARTITION BY cik, norm
  ORDER BY published_at, article_id) AS rn FROM tokens_p) WHERE rn = 1""")
def exact_copies(spark, sf):
    return news.drop_exact_copies(articles(spark, sf)).select("article_id")


view("unique_p", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, norm ORDER BY published_at, article_id) AS rn
  FROM tokens_p) WHERE rn = 1""")


view("story_pairs_p", """SELECT b.cik, b.article_id AS later, a.article_id AS earlier FROM unique_p a JOIN unique_p b
  ON a.cik = b.cik AND (a.published_at, a.article_id) < (b.published_at, b.article_id)
WHERE epoch_us(b.published_at) - epoch_us(a.published_at) < 4 * 86400000000
  AND len(list_intersect(a.tokens, b.tokens)) >= 3
  AND len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) >= 0.6::DOUBLE""")


@query("story_pairs", "SELECT cik, later, earlier FROM story_pairs_p")
def story_pairs(spark, sf):
    return news.story_pairs(news.drop_exact_copies(articles(spark, sf)))


# the greedy order, one headline of each company a step
view("story_queue_p", """SELECT u.cik, u.article_id, row_number() OVER (PARTITION BY u.cik ORDER BY u.published_at, u.article_id) AS k, p.earlier
FROM unique_p u LEFT JOIN (SELECT later, list(earlier) AS earlier FROM story_pairs_p GROUP BY later) p ON p.later = u.article_id""")


view("told_p", """SELECT cik, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT cik FROM story_queue_p)
UNION ALL
SELECT t.cik, q.k, CASE WHEN q.earlier IS NULL OR NOT list_has_any(t.kept, q.earlier) THEN list_append(t.kept, q.article_id) ELSE t.kept END
FROM told_p t JOIN story_queue_p q ON q.cik = t.cik AND q.k = t.k + 1""", recursive=True)
view("first_tellings_p", """SELECT unnest(kept) AS article_id FROM (SELECT cik, kept FROM told_p QUALIFY row_number() OVER (PARTITION BY cik ORDER BY k DESC) = 1)""",
     stored=True)


@query("deduplicated_headlines", "SELECT a.cik, a.article_id, a.title, a.published_at FROM first_tellings_p x JOIN articles_p a USING (article_id)")
def deduplicated(spark, sf):
    return news.deduplicate(articles(spark, sf)).select("cik", "article_id", "title", "published_at")


_rules = " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN {{'type': '{k}', 'label': '{lab}', 'penalty': {pen}::DOUBLE, 'severity': '{sev}'}}"
                  for k, lab, pen, sev, p in text.HEADLINE_RULES)
view("classed_p", f"SELECT *, CASE {_rules} END AS e FROM articles_p")
_types = ", ".join(f"'{t}'" for t in text.EVENT_TYPES)
view("news_events_p", f"""SELECT cik, 'ev:news-' || substr(sha1(coalesce(url, title)), 1, 10) AS evidence,
  CAST(published_at AS DATE) AS date, e.type AS type, e.label AS label, 'News (' || domain || ')' AS origin, e.severity AS severity,
  e.penalty * greatest(0, -polarity) AS penalty, title FROM classed_p WHERE e.type IN ({_types})""")


@query("headline_events", """SELECT article_id, e.type AS type, e.label AS label, e.penalty AS penalty, e.severity AS severity
FROM classed_p WHERE e IS NOT NULL""")
def headline_events(spark, sf):
    a = articles(spark, sf).withColumn("e", text.headline_event("title")).where("e is not null")
    return a.select("article_id", "e.type", "e.label", "e.penalty", "e.severity")


@query("news_event_penalties", "SELECT cik, evidence, date, type, label, origin, severity, round(penalty, 6) AS penalty FROM news_events_p")
def news_event_penalties(spark, sf):
    return news.news_events(articles(spark, sf)).drop("title").withColumn("penalty", F.round("penalty", 6))


# filings of the same companies moved to the headline year, so both kinds of event overlap in time
view("news_filings", "SELECT cik, event, filed + 9131 - CAST(floor((filed - DATE '1995-01-01') / 366) AS INT) * 366 AS filed FROM events_p")


def moved_filings(spark, sf):
    e = views.events(spark, sf)
    shift = F.lit(9131) - F.floor(F.datediff("filed", F.lit("1995-01-01").cast("date")) / 366).cast("int") * 366
    return e.select("cik", "event", F.date_add("filed", shift).alias("filed"))


@query("merged_events", """WITH RECURSIVE walk AS (
  SELECT cik, type, min(date) AS anchor FROM news_events_p GROUP BY cik, type
  UNION ALL
  SELECT w.cik, w.type, min(n.date) FROM walk w JOIN news_events_p n ON n.cik = w.cik AND n.type = w.type AND n.date > w.anchor + 7
  GROUP BY w.cik, w.type, w.anchor),
tied AS (SELECT n.cik, n.type, n.date, n.evidence, n.title, n.penalty, max(w.anchor) AS anchor FROM news_events_p n JOIN walk w
  ON w.cik = n.cik AND w.type = n.type AND w.anchor <= n.date GROUP BY ALL),
clusters AS (SELECT cik, type, anchor AS date, arg_min(title, (date, evidence)) AS title, count(*) AS items,
  list(evidence ORDER BY date, evidence) AS evidence, max(penalty) AS p FROM tied GROUP BY cik, type, anchor),
marked AS (SELECT c.cik, c.type, c.date, count(f.cik) > 0 AS superseded FROM clusters c LEFT JOIN news_filings f ON f.cik = c.cik
  AND (f.event = c.type OR (c.type = 'LAYOFFS' AND f.event = 'RESTRUCTURING')) AND abs(date_diff('day', f.filed, c.date)) <= 7 GROUP BY ALL)
SELECT cik, type, date, title, items, evidence, superseded, CASE WHEN superseded THEN 0 ELSE round(p, 6) END AS penalty
FROM clusters JOIN marked USING (cik, type, date)""")
def merged_events(spark, sf):
    m = news.merge_events(news.news_events(articles(spark, sf)), moved_filings(spark, sf))
    return m.select("cik", "type", "date", "title", "items", "evidence", "superseded", F.round("penalty", 6).alias("penalty"))


# what is known on the as-of date: the 90 days up to its end, nothing published later
view("known_p", f"""SELECT * FROM (SELECT *, (epoch(TIMESTAMP '{AS_OF}') + 86400 - floor(epoch(published_at))) / 86400.0::DOUBLE AS age FROM articles_p)
  WHERE age >= 0 AND age <= 90""")
view("news_stats_p", f"""SELECT cik, DATE '{AS_OF}' AS as_of, count(*) AS articles, sum(w * polarity) / (sum(w) + 5) AS level,
  CASE WHEN count(*) FILTER (age <= 30) >= 3 AND count(*) FILTER (age > 30 AND age <= 90) >= 3 THEN
    avg(polarity) FILTER (age <= 30) - avg(polarity) FILTER (age > 30 AND age <= 90) END AS trend,
  avg(CAST(label = 'negative' AND polarity <= -0.5::DOUBLE AS DOUBLE)) AS neg_share, avg(polarity) AS mean_sentiment,
  avg(CAST(label = 'positive' AS DOUBLE)) AS positive_share, avg(CAST(label = 'negative' AS DOUBLE)) AS negative_share
FROM (SELECT *, pow(0.5::DOUBLE, age / 14) AS w FROM known_p) GROUP BY cik""")
_NS = ["level", "trend", "neg_share", "mean_sentiment", "positive_share", "negative_share"]


@query("news_statistics", "SELECT cik, as_of, articles, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NS) + " FROM news_stats_p")
def news_statistics(spark, sf):
    s = news.news_stats(at_date(articles(spark, sf)))
    return s.select("cik", "as_of", "articles", *[F.round(c, 6).alias(c) for c in _NS])


view("daily_p", "SELECT cik, CAST(published_at AS DATE) AS day, avg(polarity) AS sentiment, count(*) AS articles FROM articles_p GROUP BY 1, 2")


@query("daily_sentiment", "SELECT cik, day, round(sentiment, 6) AS sentiment, articles FROM daily_p")
def daily_sentiment(spark, sf):
    return news.daily_sentiment(articles(spark, sf)).withColumn("sentiment", F.round("sentiment", 6))


view("known_daily_p", "SELECT cik, CAST(published_at AS DATE) AS day, avg(polarity) AS sentiment FROM known_p GROUP BY 1, 2")
view("shock_p", """SELECT d.cik, count(*) AS days, count(*) FILTER (day <= m.day1 - 7) AS base_days, any_value(n7) AS n7,
  avg(sentiment) FILTER (day > m.day1 - 7) AS last7, avg(sentiment) FILTER (day <= m.day1 - 7) AS base_mean,
  stddev_samp(sentiment) FILTER (day <= m.day1 - 7) AS base_std
FROM known_daily_p d JOIN (SELECT a.cik, max(CAST(published_at AS DATE)) AS day1, count(*) FILTER (published_at > last1 - INTERVAL 7 DAY) AS n7
  FROM known_p a JOIN (SELECT cik, max(published_at) AS last1 FROM known_p GROUP BY cik) x USING (cik) GROUP BY a.cik) m
  USING (cik) GROUP BY d.cik""")


@query("sentiment_shock", """SELECT cik, days, base_days, n7, round(last7, 6) AS last7, round(base_mean, 6) AS base_mean,
  round(base_std, 6) AS base_std, coalesce(days >= 20 AND base_days >= 10 AND n7 >= 5 AND last7 < base_mean - 2 * base_std, false)
  AS shock FROM shock_p""")
def sentiment_shock(spark, sf):
    s = news.sentiment_shock(at_date(articles(spark, sf)))
    return s.select("cik", "days", "base_days", "n7", *[F.round(c, 6).alias(c) for c in ("last7", "base_mean", "base_std")], "shock")


@query("newest_headlines_per_company", """SELECT cik, article_id, published_at FROM (SELECT *, row_number() OVER (PARTITION BY cik
  ORDER BY published_at DESC, article_id DESC) AS rn FROM articles_p) WHERE rn <= 60""")
def newest_headlines(spark, sf):
    from keelson.operators.serving import newest_per_key
    return newest_per_key(articles(spark, sf), ["cik"], ["published_at", "article_id"], 60).select("cik", "article_id", "published_at")


@query("headlines_naming_the_outlet", """SELECT article_id FROM (SELECT article_id, lower(title) AS t,
  lower(string_split(title, ' ')[1]) AS w1, lower(string_split(title, ' ')[2]) AS w2 FROM articles_p)
WHERE regexp_matches(t, '(^|[^a-z0-9_])the($|[^a-z0-9_])') OR regexp_matches(t, '(^|[^a-z0-9_])data breach($|[^a-z0-9_])')""")
def naming(spark, sf):
    a = articles(spark, sf).withColumn("terms", F.array(F.lit("The"), F.lit("Data Breach")))
    return a.where(text.names_company("title", "terms")).select("article_id")
