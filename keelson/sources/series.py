"""Price, review, headline and labelled-text sources, and the merge of recorded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.text import names_company

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]
REVIEW_SCHEMA = ("firm string, date_review string, job_title string, current string, overall_rating double, headline string, "
                 "pros string, cons string")


def read_prices(spark: SparkSession, path: str, kind: str = "daily") -> DataFrame:
    """TICKER.csv (daily) or TICKER_weekly.csv in the folder `path`, each a file or a folder of parts; headers are trimmed and lowered.
    Weekly `close` is the adjusted close and the reported one is kept as raw_close."""
    weekly = kind == "weekly"
    df = spark.read.option("header", True).csv(f"{path}/*_weekly.csv" if weekly else f"{path}/*.csv")
    df = df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(/[^/]*)?$", 1).alias("_name"))
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if not weekly:
        df = df.where(~F.col("_name").endswith("_weekly"))
    df = df.withColumn("ticker", F.url_decode(F.regexp_replace("_name", "_weekly$", "")))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    day = F.try_to_timestamp("date").alias("bar")
    if not weekly:
        return df.select("ticker", day, *[number(c) for c in PRICE_COLUMNS])
    return df.select("ticker", day, *[number(c) for c in ("open", "high", "low", "volume")],
                     F.col("close").try_cast("double").alias("raw_close"), F.col("adjusted_close").try_cast("double").alias("close"))


def read_reviews(spark: SparkSession, path: str, firm_map: DataFrame) -> DataFrame:
    """Reviews of mapped firms with a usable date (free text may span lines)."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(REVIEW_SCHEMA)
          .option("enforceSchema", False).csv(path))
    mapped = df.join(firm_map.select("firm").distinct(), "firm", "left_semi")
    return mapped.withColumn("date_review", F.try_to_date("date_review")).where("date_review is not null")


def read_news(raw: DataFrame) -> DataFrame:
    """raw: (cik, terms array, value JSON with `articles`). Headlines that name the company, with a parseable stamp."""
    schema = "struct<articles: array<struct<title: string, url: string, domain: string, seendate: string, sourcecountry: string>>>"
    a = raw.select("cik", "terms", F.explode(F.from_json("value", schema)["articles"]).alias("a"))
    rows = a.select("cik", "terms", F.trim("a.title").alias("title"), "a.url", "a.domain",
                    F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("published_at"),
                    F.col("a.sourcecountry").alias("source_country"))
    kept = rows.where((F.col("title") != "") & F.col("published_at").isNotNull() & names_company("title", "terms"))
    return kept.drop("terms")


def read_volume(raw: DataFrame) -> DataFrame:
    """raw: (cik, value JSON with `volume`) -> (cik, date, articles)."""
    schema = "struct<volume: array<struct<date: string, value: bigint>>>"
    v = raw.select("cik", F.explode(F.from_json("value", schema)["volume"]).alias("v")).where("v.date is not null")
    return v.select("cik", F.try_to_date(F.substring("v.date", 1, 8), "yyyyMMdd").alias("date"), F.coalesce("v.value", F.lit(0)).alias("articles"))


def labelled(text: Column, code: Column) -> list[Column]:
    """Integer codes of the labelled set: 0 negative, 1 positive, 2 neutral (fixed values)."""
    name = F.when(code == 0, "negative").when(code == 1, "positive").when(code == 2, "neutral")
    return [text.alias("text"), name.alias("label")]


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*labelled(F.col("text"), F.col("label").try_cast("int")))


def split_labelled_lines(lines: DataFrame) -> DataFrame:
    """`sentence@label`, split at the last @."""
    return lines.where(F.col("value").contains("@")).select(
        F.trim(F.regexp_extract("value", r"^(.*)@([^@]*)$", 1)).alias("text"), F.trim(F.regexp_extract("value", r"^(.*)@([^@]*)$", 2)).alias("label"))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 lines; the csv reader with an unused separator is what decodes the charset."""
    df = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    return split_labelled_lines(df)


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded series: old rows stay, new rows win where both exist."""
    return old.join(new, keys, "left_anti").unionByName(new.select(*old.columns))
