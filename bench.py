"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into a no-op sink (all rows and columns are produced, none is collected). One small warm-up
query starts the JVM before the clock; `values` other than seconds are rates derived from the same runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from keelson.plans import registry
from keelson.session import build_session

HEADLINE = ["distress_dataset", "snapshot_at_annual_filings", "facts_known_at_each_annual_filing", "peer_quantile_tables",
            "event_features", "canonical_events", "robust_z_scores", "market_metrics", "story_pairs", "merged_events",
            "watchlist_alerts", "score_points_upserted", "visible_history", "drift_report", "rank_metrics", "forecast_rows",
            "facts_from_documents", "stream_usage_counters"]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["platform_counts"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if not only or n in only]:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    rates = {}
    if "distress_dataset" in times:
        from keelson.plans.pointintime import annual_filings
        asofs = annual_filings(spark, sf_dir).select("cik", "filed").distinct().count()
        rates = {"annual_asof_dates": asofs, "snapshots_per_sec": round(asofs / times["snapshot_at_annual_filings"], 1)
                 if "snapshot_at_annual_filings" in times else None}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), **rates}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
