"""Filing and company documents (JSON) -> typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"accessionNumber": "accn", "filingDate": "filed", "reportDate": "report_date", "form": "form", "items": "items",
          "primaryDocument": "primary_document"}
# fixed value: forms worth keeping, with or without an amendment mark
KEEP_FORMS = r"^(10-K|10-KT|10-Q|8-K|NT 10-K|NT 10-Q|15-12B|15-12G|15-15D|25|25-NSE)(/A)?$"
PRIMARY = r"CIK(\d{10})\.json$"
OVERFLOW = r"CIK(\d{10})-submissions-\d+\.json$"
BLOCK = "struct<" + ", ".join(f"{f}: array<string>" for f in FIELDS) + ">"
DOCUMENT = (f"struct<cik: string, name: string, tickers: array<string>, exchanges: array<string>, sic: string, sicDescription: string, "
            f"entityType: string, stateOfIncorporation: string, fiscalYearEnd: string, formerNames: array<struct<name: string>>, "
            f"filings: struct<recent: {BLOCK}, files: array<struct<name: string>>>>")


def keep_forms(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("form", F.lit("")).rlike(KEEP_FORMS))


def read_filings(blocks: DataFrame) -> DataFrame:
    """blocks: (cik, block of parallel arrays). A missing or empty field becomes NULLs; no accession numbers, no rows."""
    b = F.col("block")
    n = F.size(b["accessionNumber"])
    filled = [F.when(F.size(b[f]) > 0, b[f]).otherwise(F.array_repeat(F.lit(None).cast("string"), n)).alias(f) for f in FIELDS]
    rows = (blocks.where(n > 0).select("cik", *filled)
            .select("cik", F.inline(F.arrays_zip(*FIELDS))).withColumnsRenamed(FIELDS))
    return keep_forms(rows)


def read_companies(docs: DataFrame) -> DataFrame:
    """docs: (doc struct). Blank tickers and exchanges are removed, a blank SIC code is NULL."""
    d = F.col("doc")
    filled = lambda c: F.filter(F.coalesce(d[c], F.expr("cast(array() as array<string>)")), lambda x: x != "")
    return docs.select(
        d["cik"].cast("bigint").alias("cik"), d["name"].alias("name"), filled("tickers").alias("tickers"), filled("exchanges").alias("exchanges"),
        F.nullif(d["sic"], F.lit("")).alias("sic"), d["sicDescription"].alias("sic_description"), d["entityType"].alias("entity_type"),
        d["stateOfIncorporation"].alias("state_of_incorporation"), d["fiscalYearEnd"].alias("fiscal_year_end"),
        F.transform(d["formerNames"], lambda x: x["name"]).alias("former_names"))


def finalize_filings(rows: DataFrame) -> DataFrame:
    """One row per accession number; lenient dates; a blank report date is NULL, missing items are ''."""
    cols = [c for c in rows.columns if c != "accn"]
    one = rows.groupBy("accn").agg(F.min(F.struct(*cols)).alias("r")).select("accn", "r.*")
    return one.withColumns({"filed": F.try_to_date("filed"), "report_date": F.try_to_date(F.nullif("report_date", F.lit(""))),
                            "items": F.coalesce("items", F.lit(""))}).select(*rows.columns)


def parse_submissions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: (file_name, value). Primary documents give a company and filings, overflow pages filings only; a primary without a
    periodic report and without overflow pages is skipped. Both results keep only entities that filed a 10-K or 10-Q."""
    f = files.withColumn("primary_cik", F.regexp_extract("file_name", PRIMARY, 1)).withColumn(
        "overflow_cik", F.regexp_extract("file_name", OVERFLOW, 1))
    primary = f.where("primary_cik <> ''").select(F.col("primary_cik").cast("bigint").alias("cik"), F.from_json("value", DOCUMENT).alias("doc"))
    recent = F.col("doc.filings.recent")
    periodic = F.exists(F.coalesce(recent["form"], F.expr("cast(array() as array<string>)")), lambda x: x.rlike("^10-[KQ]"))
    used = primary.where(periodic | (F.size("doc.filings.files") > 0))
    over = f.where("overflow_cik <> ''").select(F.col("overflow_cik").cast("bigint").alias("cik"), F.from_json("value", BLOCK).alias("block"))
    rows = read_filings(used.select("cik", recent.alias("block"))).unionByName(read_filings(over))
    companies = read_companies(used.select(F.col("doc").withField("cik", F.col("cik").cast("string")).alias("doc")))
    rows = rows.join(companies.select("cik"), "cik", "left_semi")
    filings = finalize_filings(rows)
    filers = filings.where(F.col("form").rlike("^10-[KQ]")).select("cik").distinct()
    return companies.join(filers, "cik", "left_semi"), filings.join(filers, "cik", "left_semi")


def scan_submissions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extracted archive folder; one JSON document per file, chosen by file name."""
    files = (spark.read.option("wholetext", True).option("pathGlobFilter", "CIK*.json").text(path)
             .select(F.col("_metadata.file_name").alias("file_name"), "value"))
    return parse_submissions(files)
