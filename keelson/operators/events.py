"""Filing events: taxonomy mapping, decayed event features and interval labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import dims

DECAY_DAYS = 180.0
WINDOW_DAYS = 365
PERIODIC = r"^10-[KQ]"


def canonical_events(filings: DataFrame) -> DataFrame:
    """8-K item codes (distinct, trimmed) and event forms -> canonical events. Both dimensions have fixed size."""
    spark = filings.sparkSession
    items = F.broadcast(dims.item_events(spark))
    forms = F.broadcast(dims.form_events(spark))
    codes = F.array_distinct(F.transform(F.split("items", ","), lambda c: F.trim(c)))
    cols = ["cik", "filed", "accn", "source", "event", "label", "penalty", "severity", "cap"]
    from_items = (filings.where(F.col("form").startswith("8-K") & (F.col("items") != ""))
                  .select("cik", "filed", "accn", F.explode(codes).alias("key"))
                  .join(items, "key").withColumn("source", F.concat(F.lit("8-K Item "), "key")).select(*cols))
    from_forms = (filings.select("cik", "filed", "accn", F.col("form").alias("key"))
                  .join(forms, "key").withColumnRenamed("key", "source").select(*cols))
    return from_items.unionByName(from_forms)


def day_span(col: Column, before: int, after: int) -> Column:
    """Calendar-year buckets a date window can touch; joining on them keeps a range join an equi-join."""
    return F.sequence(F.year(F.date_sub(col, before)), F.year(F.date_add(col, after)))


def per_day(events: DataFrame, *keys: str) -> DataFrame:
    """Pre-aggregate events to one row per key and day, so a busy company is bounded by the calendar."""
    return events.groupBy("cik", "filed", *keys).agg(F.count(F.lit(1)).alias("n"))


def window_join(asofs: DataFrame, daily: DataFrame, before: int, after: int, how: str = "inner") -> DataFrame:
    """Join (cik, as_of) to daily event rows with filed in [as_of - before, as_of + after].

    Equality on (cik, calendar year) carries the join; a hot company is spread over its years.
    """
    left = asofs.withColumn("yr", F.explode(day_span(F.col("as_of"), before, after)))
    right = daily.withColumn("yr", F.year("filed"))
    cond = [F.col("l.cik") == F.col("r.cik"), F.col("l.yr") == F.col("r.yr"),
            F.col("r.filed") >= F.date_sub(F.col("l.as_of"), before),
            F.col("r.filed") <= F.date_add(F.col("l.as_of"), after)]
    drop = [F.col("r.cik"), F.col("l.yr"), F.col("r.yr")]
    out = left.alias("l").join(right.alias("r"), cond, how)
    return out.drop(*drop) if how == "inner" else out.drop("yr")


def events_in_window(asofs: DataFrame, events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Events aged 0..days at each as-of date, one row per (cik, as_of, event, day) with its count and age."""
    joined = window_join(asofs.select("cik", "as_of").distinct(), per_day(events, "event"), days, 0)
    return joined.withColumn("age", F.datediff("as_of", "filed"))


def event_features(asofs: DataFrame, events: DataFrame) -> DataFrame:
    """Decayed 12-month counts, one column per feature event; zero where nothing happened."""
    base = asofs.select("cik", "as_of").distinct()
    wanted = events.where(F.col("event").isin(list(dims.EVENT_FEATURES)))
    hits = events_in_window(base, wanted)
    weight = F.col("n") * F.exp(-F.col("age") / F.lit(DECAY_DAYS))
    wide = (hits.groupBy("cik", "as_of").pivot("event", list(dims.EVENT_FEATURES))
            .agg(F.sum(weight)))
    names = {e: F.coalesce(F.col(e), F.lit(0.0)) for e in dims.EVENT_FEATURES}
    return (base.join(wide, ["cik", "as_of"], "left")
            .select("cik", "as_of", *[v.alias(dims.EVENT_FEATURES[e]) for e, v in names.items()]))


def first_event_between(asofs: DataFrame, events: DataFrame, event: str, days: int, prefix: str = "label") -> DataFrame:
    """label = 1 when the event is filed in (as_of, as_of + days]; label_date = the first such date."""
    base = asofs.select("cik", "as_of").distinct()
    daily = events.where(F.col("event") == event).select("cik", "filed").distinct()
    hits = (window_join(base, daily, 0, days).where(F.col("filed") > F.col("as_of"))
            .groupBy("cik", "as_of").agg(F.min("filed").alias(f"{prefix}_date")))
    return (base.join(hits, ["cik", "as_of"], "left")
            .withColumn(prefix, F.col(f"{prefix}_date").isNotNull().cast("int")))


def exclude_prior(asofs: DataFrame, events: DataFrame, event: str, days: int) -> DataFrame:
    """Drop as-of dates with the event filed in (as_of - days, as_of]."""
    daily = events.where(F.col("event") == event).select("cik", "filed").distinct()
    hit = (window_join(asofs.select("cik", "as_of").distinct(), daily, days, 0)
           .where(F.col("filed") > F.date_sub(F.col("as_of"), days)).select("cik", "as_of").distinct())
    return asofs.join(hit, ["cik", "as_of"], "left_anti")


def event_summary(asofs: DataFrame, events: DataFrame, label: str = "BANKRUPTCY", horizon: int = 365, prior_days: int = 730) -> DataFrame:
    """Event features, interval label and prior-event mark of every as-of date from one window join."""
    base = asofs.select("cik", "as_of").distinct()
    daily = per_day(events.where(F.col("event").isin([label, *dims.EVENT_FEATURES])), "event")
    hits = window_join(base, daily, prior_days, horizon).withColumn("age", F.datediff("as_of", "filed"))
    is_label = F.col("event") == label
    weight = F.when(F.col("age").between(0, WINDOW_DAYS), F.col("n") * F.exp(-F.col("age") / F.lit(DECAY_DAYS)))
    feats = [F.sum(F.when(F.col("event") == e, weight)).alias(c) for e, c in dims.EVENT_FEATURES.items()]
    agg = hits.groupBy("cik", "as_of").agg(
        F.max(is_label & F.col("age").between(0, prior_days - 1)).alias("had_prior"),
        F.min(F.when(is_label & F.col("age").between(-horizon, -1), F.col("filed"))).alias("label_date"), *feats)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in dims.EVENT_FEATURES.values()}
    return (base.join(agg, ["cik", "as_of"], "left").withColumns(
        {**zero, "had_prior": F.coalesce("had_prior", F.lit(False)), "label": F.col("label_date").isNotNull().cast("int")}))


def periodic_filers(companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Entities with at least one 10-K or 10-Q."""
    return companies.join(filings.where(F.col("form").rlike(PERIODIC)).select("cik").distinct(), "cik", "left_semi")
