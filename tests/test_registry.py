"""Registered queries against their oracle on the smallest tables (the full set: tools/check_oracle.py)."""

import pytest

from keelson.plans import registry
from tools.check_oracle import duck, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["facts_first_filed", "facts_known_as_of", "quarterly_series", "financial_features", "canonical_events", "event_features", "bankruptcy_labels",
         "price_splits", "robust_z_scores", "market_metrics", "story_pairs", "merged_events", "employee_index_trend", "watchlist_alerts", "radar_points",
         "score_points_upserted", "visible_history", "population_stability", "rank_metrics", "precision_at_top_fraction", "filings_from_parallel_arrays", "forecast_rows",
         "stream_usage_counters", "stream_report_alerts"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    df = registry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(registry.oracles()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_flagship_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and {"cik", "accn", "label", "altman_z2", "ev_late_filing"} <= set(df.columns)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prepare_accepts_a_session_made_elsewhere(spark):
    """Static options cannot be set on a running session, so preparing one must not try."""
    from keelson.session import RUNTIME_CONF, STATIC_CONF, prepare
    prepare(spark)
    assert all(spark.conf.isModifiable(k) for k in RUNTIME_CONF) and not any(spark.conf.isModifiable(k) for k in STATIC_CONF)
