"""Structured Streaming jobs. Each returns the same rows as its batch form on the same data."""

from __future__ import annotations

import bisect
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keelson.functions.text import normalise_title
from keelson.operators import drift, serving


cloudpickle.register_pickle_by_value(sys.modules[__name__])      # workers need no copy of this package


def drift_bins(log: DataFrame, reference: DataFrame, window: str = "30 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Bin counts of the logged features in sliding windows; in append mode a window comes out once, when the watermark has passed its end.

    The state is open windows x features x bins, independent of traffic. The reference edges are a static table, broadcast where its size is checked.
    """
    reference = drift.small_side(reference)
    long = (log.withWatermark("logged_at", delay).select("logged_at", "model", F.explode("features").alias("feature", "v"))
            .where(F.col("v").isNotNull()))
    binned = long.join(reference.select("model", "feature", "edges"), ["model", "feature"])
    return (binned.withColumn("bin", drift.bin_of(F.col("edges"), F.col("v")))
            .groupBy(F.window("logged_at", window, slide).alias("w"), "model", "feature", "bin").agg(F.count(F.lit(1)).alias("c")))


def psi_of_bins(bins: DataFrame, reference: DataFrame) -> DataFrame:
    """PSI per window, model and feature from bin counts (batch form, used on each micro-batch's result table)."""
    g = bins.groupBy("w", "model", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_c"), F.sum("c").alias("n"))
    j = g.join(reference, ["model", "feature"])

    def term(b):
        a = F.greatest(F.coalesce(F.try_element_at(F.col("_c"), b), F.lit(0)) / F.col("n"), F.lit(1e-4))
        e = F.greatest(F.element_at("proportions", b + 1), F.lit(1e-4))
        return (a - e) * F.ln(a / e)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("edges")), term), F.lit(0.0), lambda acc, x: acc + x)
    return j.select(F.col("w.start").alias("start"), "model", "feature", "n", total.alias("psi"))


def usage_counters(usage: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily counts per user and kind (UTC days)."""
    return (usage.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "user_id", "kind")
            .agg(F.count(F.lit(1)).alias("used")).select(F.to_date("w.start").alias("day"), "user_id", "kind", "used"))


def window_counters(calls: DataFrame, seconds: int, limit: int, delay: str = "1 hour") -> DataFrame:
    """Fixed windows per key: how many calls, and whether the limit was exceeded."""
    return (calls.withWatermark("created_at", delay).groupBy(F.window("created_at", f"{seconds} seconds").alias("w"), "key")
            .agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("start"), "key", "calls", (F.col("calls") > limit).alias("exceeded")))


def daily_sentiment(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    return (articles.withWatermark("published_at", delay).groupBy(F.window("published_at", "1 day").alias("w"), "cik")
            .agg(F.avg("polarity").alias("sentiment"), F.count(F.lit(1)).alias("articles"))
            .select("cik", F.to_date("w.start").alias("day"), "sentiment", "articles"))


def fresh_headlines(articles: DataFrame, keep: str = "90 days") -> DataFrame:
    """First copy of each normalised title per company; the memory is bounded by the news window."""
    return (articles.withColumn("norm", normalise_title("title")).withWatermark("published_at", keep)
            .dropDuplicatesWithinWatermark(["cik", "norm"]))


def labelled_later(reports: DataFrame, events: DataFrame, days: int = 365) -> DataFrame:
    """Reports joined to events filed within `days` after them; both sides are bounded by watermarks."""
    r = reports.withWatermark("as_of", "1 day").alias("r")
    e = events.withWatermark("filed", "1 day").alias("e")
    on = ((F.col("r.cik") == F.col("e.cik")) & (F.col("e.filed") > F.col("r.as_of"))
          & (F.col("e.filed") <= F.col("r.as_of") + F.expr(f"INTERVAL {days} DAYS")))
    return r.join(e, on).select("r.cik", "r.accn", "r.as_of", "e.filed")


class Reports(StatefulProcessor):
    """Per company: time, score and signal codes of its reports, in one value that a batch reads and writes once. A report is judged against the
    one before it in event time, whatever the order of arrival; a late report is judged when it comes, and its successor again. The latest
    revision of a report counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "revision bigint, reports string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        revision, held = self.seen.get() if self.seen.exists() else (0, "[]")
        known = {(r[0], r[1]): r for r in json.loads(held)}
        new = {(r["at"], int(r["report_id"])): (r["at"], int(r["report_id"]), r["health_score"], r["codes"], r["serious"]) for r in rows}
        known.update(new)
        order = sorted(known)
        past = bisect.bisect_left(order, (timerValues.getCurrentWatermarkInMs() * 1000,))
        # before the watermark nothing can come any more: only the newest report there is still a predecessor
        self.seen.update((revision + 1, json.dumps([known[k] for k in order[max(past - 1, 0):]])))
        for before, this in zip([None, *order], order):  # noqa: B905
            if this not in new and before not in new:
                continue
            old, (_, report, score, _, serious) = known.get(before), known[this]
            codes = None if old is None else set((old[3] or "").split(","))
            fresh = sorted(c.rstrip("!") for c in (serious or "").split(",") if c and (c.endswith("!") if codes is None else c.rstrip("!") not in codes))
            drop = old[2] - score if old is not None and old[2] is not None and score is not None and old[2] > score else None
            yield Row(company_id=int(key[0]), report_id=report, score_drop=drop, new_signals=",".join(fresh), revision=revision + 1)

    def close(self) -> None:
        pass


def report_alerts(reports: DataFrame, delay: str = "800 days") -> DataFrame:
    """reports: (company_id, report_id, generated_at, health_score, codes, serious) -> judgements with a revision number.

    Reports may come up to `delay` late; of older ones the state keeps one a company. `settled` keeps the latest judgement of each report;
    watchers are joined afterwards as in the batch form."""
    timed = reports.withWatermark("generated_at", delay).withColumn("at", F.unix_micros("generated_at"))
    return timed.groupBy("company_id").transformWithState(
        Reports(), "company_id bigint, report_id bigint, score_drop int, new_signals string, revision bigint", "Append", "EventTime")


def settled(judgements: DataFrame) -> DataFrame:
    """The latest judgement of each report."""
    return serving.latest_per_key(judgements, ["company_id", "report_id"], ["revision"]).drop("revision")


class PointStore:
    """A table of score points that micro-batches merge into: delta files by key range, a manifest, merge on read and compaction.

    A batch writes its own folded points, into the key ranges it touches, and then one manifest row for each of them; a replayed batch overwrites
    its own files. What is not in the manifest is not read. Readers fold the newest base of a range and the deltas after it (the fold is a maximum, so
    its order does not matter). `compact` rewrites the ranges that have deltas, no others.
    """

    def __init__(self, path: str, ranges: int = 16):
        self.path, self.ranges = path, ranges

    def log(self, spark: SparkSession, kind: str, number: int, touched: list[int]) -> None:
        rows = spark.createDataFrame([(kind, number, r) for r in touched], "kind string, number bigint, key_range int")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def put(self, points: DataFrame, kind: str, number: int) -> None:
        spark, out = points.sparkSession, f"{self.path}/{kind}/number={number}"
        ranged = points.withColumn("key_range", F.pmod(F.xxhash64("company_id"), F.lit(self.ranges)).cast("int"))
        ranged.repartition("key_range").write.mode("overwrite").partitionBy("key_range").parquet(out)
        touched = [r[0] for r in spark.read.parquet(out).select("key_range").distinct().collect()] if not points.isEmpty() else []
        if touched:
            self.log(spark, kind, number, touched)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        self.put(serving.upsert_points(batch.limit(0), batch), "delta", epoch)

    def files(self, spark: SparkSession) -> tuple[list[str], dict[int, int], int]:
        """Folders to read, the number of deltas after each range's base, and the newest delta."""
        rows = spark.read.parquet(f"{self.path}/manifest").distinct().collect()               # a row for each range and batch
        base = {r: max(m["number"] for m in rows if m["kind"] == "base" and m["key_range"] == r) for r in {m["key_range"] for m in rows if m["kind"] == "base"}}
        after = [(m["number"], m["key_range"]) for m in rows if m["kind"] == "delta" and m["number"] > base.get(m["key_range"], -1)]
        folders = [f"{self.path}/base/number={n}/key_range={r}" for r, n in base.items()] + [f"{self.path}/delta/number={n}/key_range={r}" for n, r in after]
        pending: dict[int, int] = {}
        for _, r in after:
            pending[r] = pending.get(r, 0) + 1
        return sorted(folders), pending, max((m["number"] for m in rows if m["kind"] == "delta"), default=-1)

    def read(self, spark: SparkSession, ranges: list[int] | None = None) -> DataFrame:
        folders = [f for f in self.files(spark)[0] if ranges is None or int(f.rsplit("=", 1)[1]) in ranges]
        stored = spark.read.parquet(*folders)
        return serving.upsert_points(stored.limit(0), stored)

    def compact(self, spark: SparkSession) -> list[int]:
        """Ranges that were rewritten."""
        _, pending, newest = self.files(spark)
        if pending:
            self.put(self.read(spark, list(pending)), "base", newest)
        return sorted(pending)


def upsert_stream(points: DataFrame, store: PointStore, checkpoint: str):
    """Each micro-batch merges into the store."""
    return points.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint)


def replay(spark: SparkSession, df: DataFrame, path: str, files_per_batch: int = 4, parts: int = 8, order: str | None = None) -> DataFrame:
    """Write rows as files and read them back as a file stream.

    With `order`, a timestamp, the rows come in as many slices of time as there are batches, one slice a micro-batch, as live data would.
    """
    if order is None:
        df.repartition(parts).write.mode("overwrite").parquet(path)
    else:
        slices = -(-parts // files_per_batch)
        low, high = df.agg(F.min(F.unix_micros(order)), F.max(F.unix_micros(order))).first()
        width = ((high or 0) - (low or 0)) // slices + 1
        for k in range(slices):
            here = F.floor((F.unix_micros(order) - F.lit(low or 0)) / width) == k
            df.where(here).repartition(files_per_batch).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run over everything available and return the result table.

    Append mode writes each row once. Update mode writes, for each trigger, the rows that changed; the newest row of each of `keys` counts.
    """
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
            availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")                         # a replayed trigger rewrites its own rows

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.option("basePath", path).parquet(path)
    return serving.latest_per_key(changed, keys, ["epoch"]).select(*stream.columns)
