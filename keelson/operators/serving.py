"""Report-store operators: upserts, alerts, comparisons, history, exports, usage and access rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.operators.pit import spread


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows per key. The rank filter is applied map-side first, so a busy key ships n rows per task."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by aggregation (partial maxima before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def with_previous(df: DataFrame, key: str, ts: str, tie: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds the previous row's columns per key in (ts, tie) order.

    Works month by month: a lag inside each (key, month), then the last row of the preceding non-empty month for the first
    row of a month. The months of a key are bounded by the calendar, so a busy key is spread over them.
    """
    kept = df.withColumn("_m", F.trunc(F.col(ts).cast("date"), "month"))
    packed = F.struct(*[F.col(c).alias(c) for c in cols])
    inside = W.partitionBy(key, "_m").orderBy(ts, tie)
    rows = kept.withColumn("_p", F.lag(packed).over(inside))
    last = kept.groupBy(key, "_m").agg(F.max_by(packed, F.struct(ts, tie)).alias("_l"))
    carry = last.select(key, "_m", F.lag("_l").over(W.partitionBy(key).orderBy("_m")).alias("_c"))
    joined = rows.join(carry, [key, "_m"]).withColumn("_q", F.coalesce("_p", "_c"))
    return joined.select(*df.columns, F.col("_q").isNotNull().alias("has_previous"),
                         *[F.col("_q")[c].alias(f"{prefix}{c}") for c in cols])


def upsert_points(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Score points keyed by (company_id, as_of): LIVE replaces anything, BACKFILL only BACKFILL, the newest wins."""
    cols = existing.columns
    both = existing.unionByName(incoming.select(*cols))
    live = (F.col("source") == "LIVE").cast("int")
    return (both.groupBy("company_id", "as_of").agg(F.max_by(F.struct(*[c for c in cols if c not in ("company_id", "as_of")]),
                                                              F.struct(live, "generated_at", "score")).alias("r"))
            .select("company_id", "as_of", "r.*").select(*cols))


def backfill_points(history: DataFrame) -> DataFrame:
    """History rows with a numeric partial score become BACKFILL points of confidence 0.450."""
    return (history.where(F.col("partial_score").isNotNull())
            .withColumns({"score": F.floor(F.col("partial_score") + 0.5).cast("int"), "source": F.lit("BACKFILL"),
                          "confidence": F.lit("0.450").cast("decimal(4,3)")}))


def stored_report(df: DataFrame) -> DataFrame:
    """Confidence and probability as stored: decimals rounded half up."""
    return df.withColumns({"confidence": F.round("confidence", 3).cast("decimal(4,3)"),
                           "distress_prob": F.round("distress_prob", 4).cast("decimal(5,4)")})


def score_drops(reports: DataFrame, watchers: DataFrame) -> DataFrame:
    """One SCORE_DROP per watcher whose threshold the fall since the previous report reaches."""
    prev = with_previous(reports, "company_id", "generated_at", "report_id", ["health_score"])
    fell = (prev.withColumn("drop", F.col("prev_health_score") - F.col("health_score")).where(F.col("drop") > 0)
            .join(watchers, "company_id").where(F.col("drop") >= F.col("threshold")))
    msg = F.format_string("%s health score fell %d points (%d -> %d, %s).", "name", "drop", "prev_health_score", "health_score", "band")
    return fell.select("user_id", "company_id", "report_id", F.lit("SCORE_DROP").alias("type"),
                       F.when(F.col("drop") >= 2 * F.col("threshold"), "HIGH").otherwise("MEDIUM").alias("severity"),
                       msg.alias("message"))


def new_signals(reports: DataFrame) -> DataFrame:
    """Serious signals absent from the previous report; without a previous report only CRITICAL ones."""
    prev = with_previous(reports, "company_id", "generated_at", "report_id", ["signals"])
    s = prev.withColumn("s", F.explode("signals")).where(F.col("s.severity").isin("CRITICAL", "HIGH"))
    known = F.exists("prev_signals", lambda x: x["code"] == F.col("s.code"))
    fresh = F.when(F.col("has_previous"), ~F.coalesce(known, F.lit(False))).otherwise(F.col("s.severity") == "CRITICAL")
    return s.where(fresh).select("company_id", "report_id", "name", "s.code", "s.severity", "s.message")


def alerts(reports: DataFrame, watchers: DataFrame) -> DataFrame:
    fresh = new_signals(reports).join(watchers, "company_id").select(
        "user_id", "company_id", "report_id", F.lit("NEW_SIGNAL").alias("type"), "severity",
        F.concat("name", F.lit(": "), "message").alias("message"))
    return score_drops(reports, watchers).unionByName(fresh)


def watched(companies: DataFrame, items: DataFrame) -> DataFrame:
    return companies.join(items.select("company_id").distinct(), "company_id", "left_semi")


def radar(universe: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """universe: (company_id, as_of date or NULL for the latest). Stored points (one per report) and pending pairs."""
    live = latest_per_key(reports.where(~F.col("is_case_study")), ["company_id"], ["generated_at", "report_id"])
    dated = latest_per_key(reports, ["company_id", "as_of"], ["generated_at", "report_id"])
    cols = ["report_id", "as_of", "health_score", "band"]
    pick = lambda df, keys: df.select(*keys, F.struct(*[F.col(c) for c in cols]).alias("r"))
    latest_pairs = (universe.where("as_of is null").join(pick(live, ["company_id"]), "company_id", "left")
                    .withColumn("case_study", F.lit(False)))
    r = dated.select("company_id", F.col("as_of").alias("_d"), F.struct(*[F.col(c) for c in cols]).alias("r"))
    dated_pairs = (universe.where("as_of is not null").join(r.withColumnRenamed("_d", "as_of"), ["company_id", "as_of"], "left")
                   .withColumn("case_study", F.lit(True)))
    both = latest_pairs.unionByName(dated_pairs)
    pending = both.where("r is null").select("company_id", "as_of")
    points = (both.where("r is not null").groupBy(F.col("r.report_id").alias("report_id"))
              .agg(F.min_by(F.struct("company_id", "r", "case_study"), F.col("case_study").cast("int")).alias("x"))
              .select("x.company_id", "report_id", F.col("x.r.as_of").alias("as_of"), F.col("x.r.health_score").alias("health_score"),
                      F.col("x.r.band").alias("band"), "x.case_study"))
    return points, pending


def compare(ids: DataFrame, reports: DataFrame) -> DataFrame:
    live = latest_per_key(reports.where(~F.col("is_case_study")), ["company_id"], ["generated_at", "report_id"])
    return ids.join(live, "company_id", "left")


def pillar_matrix(pillars: DataFrame, ids: list[int]) -> DataFrame:
    """One row per pillar, one column per compared company."""
    return pillars.where(F.col("cik").isin(ids)).groupBy("pillar").pivot("cik", ids).agg(F.first("score"))


def clamp_history(points: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (user_id, company_id, plan, from_date, to_date). Visible points: the plan bounds the history start."""
    limits = F.broadcast(dims.plan_limits(points.sparkSession).select("plan", "history_days"))
    bounded = requests.join(limits, "plan").withColumn(
        "start", F.coalesce("from_date", F.add_months("to_date", -60)))
    start = F.when(F.col("history_days") > 0, F.greatest("start", F.expr("date_sub(to_date, history_days)"))).otherwise(F.col("start"))
    return (points.join(bounded.withColumn("start", start), "company_id")
            .where(F.col("as_of").between(F.col("start"), F.col("to_date")))
            .select("user_id", "company_id", "as_of", "score", "confidence", "source"))


def visible_events(events: DataFrame, mode: str) -> DataFrame:
    """Report-tab filters: all, material (with a penalty) or news."""
    if mode == "material":
        return events.where(F.col("penalty") > 0)
    if mode == "news":
        return events.where(F.col("origin").startswith("News"))
    return events


def usage_today(usage: DataFrame, now: Column) -> DataFrame:
    """Events per user and kind since midnight UTC of `now`."""
    return (usage.where((F.col("created_at") > F.date_trunc("day", now)) & (F.col("created_at") <= now))
            .groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("used")))


def quota(used: DataFrame, users: DataFrame) -> DataFrame:
    limits = F.broadcast(dims.plan_limits(used.sparkSession))
    limit = (F.when(F.col("kind") == "ANALYSIS", F.col("analyses_per_day")).when(F.col("kind") == "API_CALL", F.col("api_calls_per_day")))
    return (used.join(users, "user_id").join(limits, "plan").withColumn("limit", limit)
            .select("user_id", "kind", "plan", "used", "limit", F.coalesce(F.col("used") < F.col("limit"), F.lit(True)).alias("allowed")))


def impact_changes(impacts: DataFrame) -> DataFrame:
    """Change of each factor's impact between consecutive as-of dates of a company."""
    w = W.partitionBy("cik", "key").orderBy("as_of")
    return impacts.withColumn("delta", F.bround(F.col("impact") - F.lag("impact").over(w), 4))


def trajectories(points: DataFrame) -> DataFrame:
    """Radar points with a score and a probability, ordered per company; the newest is flagged."""
    known = points.where(F.col("health_score").isNotNull() & F.col("distress_prob").isNotNull())
    newest = known.groupBy("company_id").agg(F.max("as_of").alias("_last"))
    return known.join(newest, "company_id").withColumn("is_last", F.col("as_of") == F.col("_last")).drop("_last")


RADIX, LEVELS = 16, 6                             # 16 ** 6 days hold every date
DAY_ZERO, LAST_DAY = "0001-01-01", 9999 * 366


def day_blocks(first: Column, after: Column) -> Column:
    """Cover of the days first .. after - 1 by aligned blocks of 1, 16, 256 .. days, as an array of (level, block); none overlap.

    From both ends, days up to the next larger block's border become blocks of the present size; what is between goes on to that size. Both ends of
    a level are found from the days themselves, since a step from the level before would grow the expression threefold with each level.
    """
    def inner(level):
        size = RADIX ** level
        return F.ceil(first / size) * size, F.floor(after / size) * size

    parts = []
    for level in range(LEVELS):
        (low, high), (up, down) = inner(level), inner(level + 1)
        meets = (up <= down) & F.lit(level < LEVELS - 1)

        def run(a, b, level=level, size=RADIX ** level):
            numbers = F.when(a < b, F.sequence(F.floor(a / size), F.floor((b - 1) / size))).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))
        parts += [run(low, F.when(meets, up).otherwise(high)), run(F.when(meets, down).otherwise(high), high)]
    return F.concat(*parts)


def blocks_of_day(day: Column) -> Column:
    """The blocks a day lies in, one for each level."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.floor(day / RADIX ** level).alias("block")) for level in range(LEVELS)])


def identifier_asof(identifiers: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: (scheme, value, as_of) -> company whose identifier was valid on the date (valid_to exclusive, open if NULL).

    Validity is cut into aligned day blocks, and a probe looks up the blocks its day lies in. Blocks of one validity do not overlap, so every
    joined row is a result: a value with many validity rows is not paired with each of its probes, and its rows spread over its blocks.
    Blocks are many times the identifiers they are made from, which the optimizer does not know, so it is told not to broadcast them.
    """
    number = lambda c: F.datediff(c, F.lit(DAY_ZERO).cast("date")).cast("long")
    valid = (spread(identifiers.where("valid_to is null or valid_from < valid_to"), "scheme", "value", "company_id")
             .select("scheme", "value", "company_id", F.explode(day_blocks(number(F.col("valid_from")), F.coalesce(number(F.col("valid_to")), F.lit(LAST_DAY)))).alias("b"))
             .select("scheme", "value", "company_id", "b.level", "b.block"))
    asked = (probes.select("scheme", "value", "as_of", F.explode(blocks_of_day(number(F.col("as_of")))).alias("b"))
             .select("scheme", "value", "as_of", "b.level", "b.block"))
    return asked.join(valid.hint("merge"), ["scheme", "value", "level", "block"]).select("scheme", "value", "as_of", "company_id")


def source_status(companies: DataFrame, latest: DataFrame, sources: list[str]) -> DataFrame:
    """Every company x source with its newest data date, or the reason it is unavailable."""
    grid = companies.select("cik", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    j = grid.join(latest, ["cik", "source"], "left")
    return j.select("cik", "source", F.col("data_as_of").isNotNull().alias("available"), "data_as_of",
                    F.when(F.col("data_as_of").isNull(), F.concat(F.lit("no "), "source", F.lit(" data for this company"))).alias("reason"))


def platform_stats(**tables: DataFrame) -> DataFrame:
    """One row of counts: each table folds to one number first."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def export_factors(factors: DataFrame) -> DataFrame:
    """Factor table as the CSV export writes it."""
    text = lambda c, fmt: F.coalesce(F.format_string(fmt, c), F.lit(""))
    return factors.select(
        "cik", "as_of", "pillar", F.col("label").alias("factor"), "kind", F.coalesce("display_value", F.lit("")).alias("value"),
        text(F.col("score"), "%.2f").alias("score"), text(F.col("pct"), "%.4f").alias("peer_percentile"),
        text(F.col("impact"), "%.4f").alias("impact_points"), F.coalesce("note", F.lit("")).alias("note"))
