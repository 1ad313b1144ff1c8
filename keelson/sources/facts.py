"""Facts documents -> canonical facts, and the columnar fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators import pit

ENTRY = "struct<start: string, `end`: string, val: double, fy: float, fp: string, form: string, filed: string, accn: string>"
DOCUMENT = f"struct<facts: map<string, map<string, struct<units: map<string, array<{ENTRY}>>>>>>"


def read_facts(docs: DataFrame, min_filed: str = "2009-01-01") -> DataFrame:
    """docs: (cik, value JSON). Mapped tags only; filtered right after the unit list is exploded; first filing of each value."""
    tags = F.broadcast(dims.tag_map(docs.sparkSession))        # fixed size: one row per mapped tag
    doc = docs.select("cik", F.from_json("value", DOCUMENT).alias("d"))
    by_tag = (doc.select("cik", F.explode("d.facts").alias("taxonomy", "t")).select("cik", "taxonomy", F.explode("t").alias("tag", "u"))
              .join(tags, ["taxonomy", "tag"]))
    rows = by_tag.select("cik", "item", "rank", F.inline(F.try_element_at(F.col("u.units"), F.col("unit"))))
    kept = rows.where(F.col("form").isin(pit.FACT_FORMS) & (F.col("filed") >= min_filed)).withColumns(
        {c: F.try_to_date(c) for c in ("start", "end", "filed")})
    return pit.first_filed(pit.sane_dates(kept.where("`end` is not null and filed is not null")))


def write_facts(facts: DataFrame, path: str) -> None:
    """zstd parquet, one folder per item, sorted by company inside, so `item =` prunes folders and `cik IN` row groups."""
    (facts.repartition("item", F.pmod(F.hash("cik"), F.lit(64))).sortWithinPartitions("item", "cik").write.mode("append")
     .option("compression", "zstd").partitionBy("item").parquet(path))


def load_facts(spark: SparkSession, path: str, items: list[str] | None = None, ciks: list[int] | None = None,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if items:
        df = df.where(F.col("item").isin(items))
    if ciks:
        df = df.where(F.col("cik").isin(ciks))
    return df.select(*columns) if columns else df
