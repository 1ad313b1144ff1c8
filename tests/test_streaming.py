"""Streams against their batch form: several batches, any order of arrival, stored bytes and bounded state."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import serving
from keelson.streaming import feeds

T0 = dt.datetime(2024, 1, 1, 9)


def reports(seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(60):
        codes = sorted(rng.sample("ABCD", rng.randint(0, 3)))
        serious = [c + ("!" if c == "A" else "") for c in codes if c != "D"]
        out.append((i % 3, i, T0 + dt.timedelta(days=rng.randrange(400)), rng.choice([None, *range(20, 90, 10)]), ",".join(codes), ",".join(serious)))
    return out


def judged(rows):
    want = {}
    for company in {r[0] for r in rows}:
        before = None
        for r in sorted((r for r in rows if r[0] == company), key=lambda r: (r[2], r[1])):
            serious = [c for c in r[5].split(",") if c]
            known = None if before is None else set(before[4].split(","))
            fresh = [c.rstrip("!") for c in serious if (c.endswith("!") if known is None else c.rstrip("!") not in known)]
            drop = before[3] - r[3] if before is not None and before[3] is not None and r[3] is not None and before[3] > r[3] else None
            want[r[1]] = (drop, ",".join(sorted(fresh)))
            before = r
    return want


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_alerts_in_any_order_equal_the_batch_form(spark, tmp_path, batches):
    rows = reports()
    random.Random(batches).shuffle(rows)
    schema = "company_id bigint, report_id bigint, generated_at timestamp, health_score int, codes string, serious string"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = feeds.run_to_table(feeds.report_alerts(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["report_id"]: (r["score_drop"], r["new_signals"]) for r in feeds.settled(table).collect()}
    assert got == judged(rows)


def test_alert_state_is_one_row_a_company(spark, tmp_path):
    rows = [(1, i, T0 + dt.timedelta(hours=i), 50 - i % 7, "A", "A!") for i in range(600)]
    schema = "company_id bigint, report_id bigint, generated_at timestamp, health_score int, codes string, serious string"
    stream = feeds.replay(spark, spark.createDataFrame(rows, schema), str(tmp_path / "in"), 1, 3, order="generated_at")
    query = feeds.report_alerts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 1
    got = {r["report_id"]: (r["score_drop"], r["new_signals"]) for r in feeds.settled(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == judged(rows)


def points(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), dt.date(2024, 1, 1 + rng.randrange(3)), rng.randrange(100), rng.choice(["LIVE", "BACKFILL"]), T0 + dt.timedelta(minutes=rng.randrange(9999)))
            for _ in range(n)]
    return spark.createDataFrame(rows, "company_id bigint, as_of date, score int, source string, generated_at timestamp")


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_point_store_equals_one_upsert(spark, tmp_path, batches):
    store, parts = feeds.PointStore(str(tmp_path), 4), [points(spark, 30, k) for k in range(batches)]
    for k, p in enumerate(parts):
        store.merge(p, k)
        if k == 3:
            store.compact(spark)
    store.merge(parts[-1], batches - 1)                            # a replayed batch
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    want = sorted(map(tuple, serving.upsert_points(every.limit(0), every).collect()))
    assert sorted(map(tuple, store.read(spark).collect())) == want
    assert store.compact(spark) and sorted(map(tuple, store.read(spark).collect())) == want and store.compact(spark) == []


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    store = feeds.PointStore(str(tmp_path), 8)
    store.merge(points(spark, 500, 1), 0)
    store.compact(spark)
    one = points(spark, 500, 2).where("company_id = 7").limit(1)
    store.merge(one, 1)
    touched = [d for d in os.listdir(tmp_path / "delta" / "number=1") if d.startswith("key_range")]
    assert len(touched) == 1 and store.compact(spark) == [int(touched[0].split("=")[1])]
    store.merge(one.where("false"), 2)
    assert store.compact(spark) == []


def test_sliding_windows_close_once_and_leave_the_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [(T0 + dt.timedelta(hours=6 * i), "m", {"x": rng.random()}) for i in range(400)]
    log = spark.createDataFrame(rows, "logged_at timestamp, model string, features map<string,double>")
    edges = spark.createDataFrame([("m", "x", [0.5])], "model string, feature string, edges array<double>")
    stream = feeds.replay(spark, log, str(tmp_path / "in"), 1, 8, order="logged_at")
    bins = feeds.drift_bins(stream, edges, "30 days", "10 days")
    query = bins.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(
        availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 2 * 6                                      # open windows x bins, whatever the traffic
    closed = spark.read.parquet(str(tmp_path / "out")).groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("bins")).collect()
    newest = max(r[0] for r in rows) - dt.timedelta(days=1)
    for r in closed:
        assert r["w"]["end"] <= newest and r["n"] == sum(r["w"]["start"] <= x[0] < r["w"]["end"] for x in rows) and r["bins"] <= 2
    assert len(closed) >= 8
