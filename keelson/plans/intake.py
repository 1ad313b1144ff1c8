"""Source and sink queries: the proxies are written out in each source's own shape and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.functions import dims, text
from keelson.operators import resolve as rs
from keelson.plans import market as pm
from keelson.plans import text as pt
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query
from keelson.session import ensure_checkpoint_dir
from keelson.sources import facts as sfacts
from keelson.sources import filings as sfil
from keelson.sources import manifest as sman
from keelson.sources import series as sser


def scratch(spark) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ submissions documents: one page per company and year
def pages(spark, sf):
    f = views.filings(spark, sf).withColumn("yr", F.year("filed"))
    text_of = {"accessionNumber": F.col("accn"), "filingDate": F.col("filed").cast("string"), "reportDate": F.coalesce(F.col("report_date").cast("string"), F.lit("")),
               "form": F.when(F.col("accn").cast("bigint") % 29 == 0, "4").otherwise(F.col("form")), "items": F.nullif("items", F.lit("")), "primaryDocument": F.col("primary_document")}
    rows = f.select("cik", "yr", F.struct(*[v.alias(k) for k, v in text_of.items()]).alias("r"))
    g = rows.groupBy("cik", "yr").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    field = lambda k: F.transform("rows", lambda r: r[k]).alias(k)
    block = F.struct(*[field(k) for k in sfil.FIELDS])
    return g.select("cik", "yr", block.alias("block"))


def submission_files(spark, sf):
    p = pages(spark, sf)
    newest = p.groupBy("cik").agg(F.max("yr").alias("newest"), F.count("*").alias("n_pages"))
    co = views.companies(spark, sf)
    padded = F.lpad(F.col("cik").cast("string"), 10, "0")
    j = p.join(newest, "cik").join(co.select("cik", "name", "sic"), "cik")
    doc = F.struct(F.col("cik").cast("string").alias("cik"), "name", F.array(F.concat(F.lit("T"), F.col("cik").cast("string")), F.lit("")).alias("tickers"),
                   F.array(F.lit(""), F.lit("NYSE")).alias("exchanges"), F.when(F.col("cik") % 7 == 0, "").otherwise(F.col("sic").cast("string")).alias("sic"),
                   F.array(F.struct(F.concat(F.lit("Old "), "name").alias("name"))).alias("formerNames"),
                   F.struct(F.col("block").alias("recent"), F.when(F.col("n_pages") > 1, F.array(F.struct(F.lit("more").alias("name")))).alias("files")).alias("filings"))
    primary = j.where("yr = newest").select(F.concat(F.lit("CIK"), padded, F.lit(".json")).alias("file_name"), F.to_json(doc).alias("value"))
    over = j.where("yr < newest").select(F.concat(F.lit("CIK"), padded, F.lit("-submissions-"), F.col("yr").cast("string"), F.lit(".json")).alias("file_name"), F.to_json("block").alias("value"))
    return primary.unionByName(over)


view("intake_filings", """SELECT cik, accn, filed, report_date, form, items, primary_document FROM filings_p WHERE CAST(accn AS BIGINT) % 29 <> 0
  AND regexp_matches(form, '^(10-K|10-KT|10-Q|8-K|NT 10-K|NT 10-Q|15-12B|15-12G|15-15D|25|25-NSE)(/A)?$')""")


@query("filings_from_parallel_arrays", "SELECT cik, accn, CAST(filed AS VARCHAR) AS filed, form FROM intake_filings")
def parallel_arrays(spark, sf):
    return sfil.read_filings(pages(spark, sf).select("cik", "block")).select("cik", "accn", "filed", "form")


@query("filings_from_documents", "SELECT * FROM intake_filings WHERE cik IN (SELECT cik FROM intake_filings WHERE regexp_matches(form, '^10-[KQ]'))")
def filings_from_documents(spark, sf):
    return sfil.parse_submissions(submission_files(spark, sf))[1].select("cik", "accn", "filed", "report_date", "form", "items", "primary_document")


@query("companies_from_documents", """SELECT cik, name, ['T' || cik] AS tickers, ['NYSE'] AS exchanges, CASE WHEN cik % 7 = 0 THEN NULL ELSE CAST(sic AS VARCHAR) END AS sic, ['Old ' || name] AS former_names
FROM companies_p WHERE cik IN (SELECT cik FROM intake_filings WHERE regexp_matches(form, '^10-[KQ]'))""")
def companies_from_documents(spark, sf):
    return sfil.parse_submissions(submission_files(spark, sf))[0].select("cik", "name", "tickers", "exchanges", "sic", "former_names")


@query("filings_finalised", "SELECT cik, accn, filed, report_date, form, items FROM filings_p")
def filings_finalised(spark, sf):
    """Every filing twice, with blank dates and missing items, as pages overlap in practice."""
    f = views.filings(spark, sf)
    raw = f.select("cik", "accn", F.col("filed").cast("string").alias("filed"), F.coalesce(F.col("report_date").cast("string"), F.lit("")).alias("report_date"),
                   "form", F.nullif("items", F.lit("")).alias("items"))
    return sfil.finalize_filings(raw.unionByName(raw))


# ------------------------------------------------------------------ facts documents
view("tag_d", "SELECT * FROM (VALUES " + ", ".join(f"('{i}', {r})" for i, tags in {**dims.DURATION_TAGS, **dims.INSTANT_TAGS}.items() for r in range(len(tags))) + ") AS t(item, rank)")


DOCUMENT_LINES = 125_000            # line items of a task that makes documents: it holds its facts several times over


@query("facts_from_documents", """SELECT cik, item, CAST(rank AS INT) AS rank, start, "end", val, min(filed) AS filed FROM facts_raw_p SEMI JOIN tag_d USING (item, rank)
WHERE form IN ('10-K', '10-K/A', '10-Q', '10-Q/A', '10-KT', '10-KT/A') AND filed >= DATE '1997-01-01' GROUP BY cik, item, rank, start, "end", val""")
def facts_from_documents(spark, sf):
    raw = views.facts_raw(spark, sf, DOCUMENT_LINES).join(F.broadcast(dims.tag_map(spark)), ["item", "rank"])
    entry = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val", F.col("fy").cast("float").alias("fy"), "fp", "form",
                     F.col("filed").cast("string").alias("filed"), "accn")
    tags = raw.groupBy("cik", "fy", "taxonomy", "tag", "unit").agg(F.collect_list(entry).alias("list"))
    units = tags.groupBy("cik", "fy", "taxonomy", "tag").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "list"))).alias("units")).alias("u"))
    tax = units.groupBy("cik", "fy", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "u"))).alias("t"))
    docs = tax.groupBy("cik", "fy").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "t"))).alias("facts")).select("cik", F.to_json(F.struct("facts")).alias("value"))
    return sfacts.read_facts(docs, "1997-01-01").select("cik", "item", F.col("rank").cast("int").alias("rank"), "start", "end", "val", "filed")


@query("facts_store_pruned_read", """SELECT cik, "end", val, filed FROM facts_p WHERE item = 'Revenue' AND cik IN (1, 2, 3, 5, 8)""")
def facts_store(spark, sf):
    path = scratch(spark)
    sfacts.write_facts(views.facts(spark, sf), path)
    return sfacts.load_facts(spark, path, ["Revenue"], [1, 2, 3, 5, 8], ["cik", "end", "val", "filed"])


# ------------------------------------------------------------------ prices, reviews, headlines, labelled text
@query("prices_from_csv", "SELECT ticker, bar, open, high, low, close, volume FROM prices_p")
def prices_csv(spark, sf):
    """One TICKER.csv a ticker, with blanks in its header, read back with the ticker of its name."""
    path = scratch(spark)
    b = pm.bars(spark, sf).withColumnRenamed("bar", "date")
    for t in pm.TICKERS:
        out = b.where(F.col("ticker") == t).drop("ticker").select("date", "open", "high", "low", "close", "volume").toDF(
            *[f" {c.title()} " for c in ("date", "open", "high", "low", "close", "volume")])
        out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{t}.csv")
    return sser.read_prices(spark, path)


@query("reviews_from_csv", "SELECT firm, date_review, overall_rating, md5(cons) AS digest FROM reviews_p WHERE firm IN ('src1', 'src2', 'src3') AND review_id % 11 <> 0")
def reviews_csv(spark, sf):
    from keelson.plans.reviews import reviews
    path = scratch(spark)
    r = reviews(spark, sf)
    day = F.when(F.col("review_id") % 11 == 0, "not a date").otherwise(F.col("date_review").cast("string"))
    (r.select("firm", day.alias("date_review"), F.lit("").alias("job_title"), F.lit("").alias("current"), F.col("overall_rating").cast("double").alias("overall_rating"), "headline", "pros", "cons")
     .write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    firms = r.select("firm").distinct().where(F.col("firm").isin("src1", "src2", "src3"))
    out = sser.read_reviews(spark, path, firms)
    return out.select("firm", "date_review", F.col("overall_rating").cast("int").alias("overall_rating"), F.md5("cons").alias("digest"))


@query("headlines_from_json", """SELECT cik, url, published_at FROM articles_p WHERE article_id % 13 <> 0 AND trim(title) <> '' AND regexp_matches(lower(title), '(^|[^a-z0-9_])(staff|jobs|outage)($|[^a-z0-9_])')""")
def headlines_json(spark, sf):
    a = pt.articles(spark, sf)
    stamp = F.when(F.col("article_id") % 13 == 0, "yesterday").otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"))
    doc = F.struct(F.array(F.struct(F.concat(F.lit("  "), "title").alias("title"), "url", "domain", stamp.alias("seendate"), F.lit("US").alias("sourcecountry"))).alias("articles"))
    raw = a.select("cik", F.array(F.lit("Staff"), F.lit("jobs"), F.lit("Outage")).alias("terms"), F.to_json(doc).alias("value"))
    return sser.read_news(raw).select("cik", "url", "published_at")


@query("headline_volume_from_json", "SELECT cik, day AS date, articles FROM daily_p")
def volume_json(spark, sf):
    from keelson.operators import news
    d = news.daily_sentiment(pt.articles(spark, sf))
    doc = F.struct(F.array(F.struct(F.date_format("day", "yyyyMMdd'T'000000'Z'").alias("date"), F.col("articles").alias("value"))).alias("volume"))
    return sser.read_volume(d.select("cik", F.to_json(doc).alias("value")))


@query("labelled_lines", """SELECT trim(t[1 : len(t) - strpos(reverse(t), '@')]) AS text, trim(t[len(t) - strpos(reverse(t), '@') + 2 :]) AS label FROM (SELECT lang || ' @ ' || source || '@' || CASE doc_id % 3
  WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS t FROM documents)""")
def labelled_lines(spark, sf):
    d = views.table(spark, sf, "documents")
    lab = F.when(F.col("doc_id") % 3 == 0, "negative").when(F.col("doc_id") % 3 == 1, "positive").otherwise("neutral")
    path = scratch(spark)
    lines = d.select(F.concat("lang", F.lit(" @ "), "source", F.lit("@"), lab).alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path)
    return sser.read_labelled_lines(spark, path)


@query("labelled_csv_codes", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' END AS label FROM documents")
def labelled_codes(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", sser.labelled(F.col("text"), (F.col("doc_id") % 4).cast("int"))[1])


@query("merged_recordings", "SELECT ticker, bar, CASE WHEN hour(bar) % 2 = 0 THEN close + 1 ELSE close END AS close FROM prices_p")
def merged_recordings(spark, sf):
    b = pm.bars(spark, sf).select("ticker", "bar", "close")
    return sser.merge_latest(b, b.where(F.hour("bar") % 2 == 0).withColumn("close", F.col("close") + 1), ["ticker", "bar"])


@query("input_manifest")
def input_manifest(spark, sf):
    return sman.manifest(spark, sf, "*.parquet").select("file", "bytes", "sha256")


@query("input_manifest_hash")
def input_manifest_hash(spark, sf):
    return sman.manifest_hash(sman.manifest(spark, sf, "*.parquet"))


@query("partitioned_rewrite", "SELECT filed AS as_of, CASE WHEN month(filed) = 6 THEN -count(*) ELSE count(*) END AS n FROM filings_p GROUP BY filed")
def partitioned_rewrite(spark, sf):
    """Filings per day in a table partitioned by month, then written again for each June with other values: only these months change."""
    path = scratch(spark)
    per_day = views.filings(spark, sf).groupBy(F.trunc("filed", "month").alias("month"), F.col("filed").alias("as_of")).agg(F.count("*").alias("n"))
    sman.write_partitioned(per_day.repartition("month"), path, "month")
    sman.write_partitioned(per_day.where("month(month) = 6").withColumn("n", -F.col("n")).repartition("month"), path, "month")
    return spark.read.parquet(path).select("as_of", "n")


# ------------------------------------------------------------------ names
@query("short_names", """SELECT s_suppkey, regexp_replace(trim(n), '(( inc| inc\\.| corp| corp\\.| corporation| co| co\\.| company| ltd| plc| holdings| group| platforms| /de/| /new/)[ ,]*)+$', '', 'i') AS short
FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Group plc' WHEN 2 THEN ' Corporation' ELSE '' END AS n FROM supplier)""")
def short_names(spark, sf):
    return named(spark, sf).select(F.col("s_suppkey"), text.short_name("n").alias("short"))


def named(spark, sf):
    s = views.table(spark, sf, "supplier")
    tail = F.when(F.col("s_suppkey") % 4 == 0, " Holdings, Inc.").when(F.col("s_suppkey") % 4 == 1, " Group plc").when(F.col("s_suppkey") % 4 == 2, " Corporation").otherwise("")
    return s.withColumn("n", F.concat("s_name", tail))


@query("company_aliases", """SELECT cik, list_distinct([n, regexp_replace(trim(n), '(( inc| inc\\.| corp| corp\\.| corporation| co| co\\.| company| ltd| plc| holdings| group| platforms| /de/| /new/)[ ,]*)+$', '', 'i'),
  'Old ' || s_name]).list_sort() AS aliases FROM (SELECT s_suppkey + 1 AS cik, s_name, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Group plc' WHEN 2 THEN ' Corporation' ELSE '' END AS n FROM supplier)""")
def company_aliases(spark, sf):
    a = rs.aliases(directory(spark, sf))
    return a.groupBy("cik").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))


def directory(spark, sf):
    return named(spark, sf).select((F.col("s_suppkey") + 1).alias("cik"), F.col("n").alias("name"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"),
                                   F.array(F.concat(F.lit("Old "), "s_name")).alias("former_names"))


@query("resolved_entities")
def resolved_entities(spark, sf):
    """Misspelt supplier names and tickers resolved against the directory."""
    s = named(spark, sf)
    q = s.select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("t"), F.col("s_suppkey").cast("string")))
                 .otherwise(F.regexp_replace("n", "pp", "p")).alias("query"))
    return rs.resolve(q, directory(spark, sf))
