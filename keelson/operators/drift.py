"""Input and prediction drift against reference histograms, and data freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import finite
from keelson.operators.ranking import quantiles
from keelson.session import materialise

ALERT = 0.2
MIN_ROWS = 20
MIN_REFERENCE = 50
STALE_DAYS = 456
HISTOGRAM_BYTES, BROADCAST_BYTES = 400, 16 << 20  # of a row: names, nine edges, ten shares


def log_rows(values: DataFrame, keys: list[str]) -> DataFrame:
    """values: (keys, name, value) -> one row per key with a features map; non-finite values become NULL."""
    return (values.withColumn("value", finite("value")).groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("features")))


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only log, one folder per day, so a reader of the last n days prunes by partition."""
    rows.withColumn("log_date", F.to_date("logged_at")).write.mode("append").partitionBy("log_date").parquet(path)


def read_log(spark, path: str, now: str, days: int) -> DataFrame:
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    df = spark.read.parquet(path)
    return df.where((F.col("log_date") >= F.to_date(start)) & (F.col("logged_at") >= start))


def long_features(log: DataFrame) -> DataFrame:
    return log.select("model", F.explode("features").alias("feature", "v"))


def bin_of(edges: Column, v: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= v))


def small_side(df: DataFrame) -> DataFrame:
    """A table of one row per (model, feature), broadcast where its size is known to be small: the log is then binned where it is read."""
    stored = materialise(df)
    return F.broadcast(stored) if stored.count() * HISTOGRAM_BYTES <= BROADCAST_BYTES else stored


def bin_counts(values: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts, n, missing): rows by bin as a map, values and missing values of each key, in one pass over `values` (keys, v).

    Values are binned against the edges on the map side and counted before they are shuffled: what is shuffled follows keys and bins.
    """
    v = values.select(*keys, finite("v").alias("v")).join(edges.select(*keys, "edges"), keys)
    counted = v.groupBy(*keys, F.when(F.col("v").isNotNull(), bin_of(F.col("edges"), F.col("v"))).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    seen = F.col("bin").isNotNull()
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(seen, F.struct("bin", "c")))).alias("counts"), F.sum(F.when(seen, F.col("c")).otherwise(0)).alias("n"),
        F.sum(F.when(seen, 0).otherwise(F.col("c"))).alias("missing"))


def share_of(b: Column, n: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("counts"), b), F.lit(0)) / n


def reference_histogram(values: DataFrame, keys: list[str], min_n: int = MIN_REFERENCE) -> DataFrame:
    """Distinct decile edges, bin proportions and missing share per key (long values, NULL = missing)."""
    v = values.withColumn("v", finite("v"))
    edges = small_side(quantiles(v, keys, "v", [i / 10 for i in range(1, 10)], min_n).select(*keys, F.array_distinct("quantiles").alias("edges")))
    share = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: share_of(b, F.col("n")))
    return edges.join(bin_counts(v, edges, keys), keys).select(*keys, "edges", share.alias("proportions"),
                                                               (F.col("missing") / (F.col("n") + F.col("missing"))).alias("nan_share"))


def psi(reference: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Population stability index per key; NULL when nothing finite was seen live."""
    reference = small_side(reference)
    by_key = bin_counts(live, reference, keys).where("n > 0").select(*keys, "counts", F.col("n").alias("live_n"))

    def term(b):
        a = F.greatest(share_of(b, F.col("live_n")), F.lit(1e-4))
        e = F.greatest(F.element_at("proportions", b + 1), F.lit(1e-4))
        return (a - e) * F.ln(a / e)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("edges")), term), F.lit(0.0), lambda acc, x: acc + x)
    return reference.join(by_key, keys, "left").select(*keys, "live_n", F.when(F.col("live_n") > 0, total).alias("psi"))


def drift_report(reference: DataFrame, prediction_reference: DataFrame, log: DataFrame) -> DataFrame:
    """One row per model: volume, companies, PSI per feature (largest first), drifted features, prediction PSI, status.

    Features and predictions of all models are binned in one pass over the log."""
    size = log.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("company").alias("companies"),
                                    F.count("prediction").alias("predictions"))
    kept = ["model", "feature", "edges", "proportions"]
    known = reference.select(*kept, F.lit(False).alias("is_prediction")).unionByName(
        prediction_reference.select("model", F.lit("prediction").alias("feature"), "edges", "proportions", F.lit(True).alias("is_prediction")))
    entries = F.transform(F.map_entries("features"), lambda e: F.struct(F.lit(False).alias("is_prediction"), e["key"].alias("feature"), e["value"].alias("v")))
    own = F.array(F.struct(F.lit(True).alias("is_prediction"), F.lit("prediction").alias("feature"), F.col("prediction").alias("v")))
    long = log.select("model", F.inline(F.concat(F.coalesce(entries, F.slice(own, 1, 0)), own)))
    found = psi(known, long, ["model", "is_prediction", "feature"]).withColumn("psi", F.round("psi", 4))
    by_model = found.groupBy("model").agg(
        F.sort_array(F.collect_list(F.when(~F.col("is_prediction"), F.struct(F.coalesce("psi", F.lit(-1.0)).alias("order"), "feature", "psi"))), False).alias("_f"),
        F.max(F.when(F.col("is_prediction"), F.col("psi"))).alias("_p"))
    j = size.join(by_model, "model", "left").withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")))
    enough = F.col("rows") >= MIN_ROWS
    p = F.when(enough & (F.col("predictions") >= MIN_ROWS), F.col("_p"))
    drifted = F.transform(F.filter("_f", lambda x: x["psi"] > ALERT), lambda x: x["feature"])
    every = F.when(p > ALERT, F.array_append(drifted, F.lit("prediction"))).otherwise(drifted)
    status = (F.when(F.col("_f").isNull(), "no reference histogram").when(~enough, "insufficient data")
              .when(F.size(every) > 0, "drift").otherwise("ok"))
    return j.select("model", "rows", "companies", F.when(enough, F.transform("_f", lambda x: F.struct(x["feature"].alias("feature"), x["psi"].alias("psi")))).alias("psi"),
                    F.when(enough, every).alias("drifted"), p.alias("prediction_psi"), status.alias("status"),
                    F.coalesce((status == "drift"), F.lit(False)).alias("retrain"))


def freshness_report(log: DataFrame, age: str = "financials_age_days") -> DataFrame:
    """Newest known statement age per company; stale above 456 days."""
    g = log.where(F.col(age).isNotNull()).groupBy("company").agg(F.max_by(age, F.struct("logged_at", age)).alias(age))
    return g.withColumn("stale", F.col(age) > STALE_DAYS)
