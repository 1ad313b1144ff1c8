"""Price queries over hourly bars (daily analogue) and six-hour bars (weekly analogue) of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import market
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query

AS_OF = "2024-01-30"
TICKERS = ["click", "error", "purchase", "signup", "view"]


def bars(spark, sf, seconds: int = 3600):
    e = views.table(spark, sf, "events")
    bar = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    order = F.struct("ts", "event_id")
    return (e.groupBy(F.col("event_type").alias("ticker"), bar.alias("bar"))
            .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")))


def _bars_sql(hours):
    return (f"SELECT event_type AS ticker, time_bucket(INTERVAL {hours} HOUR, ts) AS bar, arg_min(value, (ts, event_id)) AS open, "
            "max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume "
            "FROM events GROUP BY 1, 2")


view("prices_p", _bars_sql(1))
view("weekly_p", _bars_sql(6))
_factor = " ".join(f"WHEN abs(r * {k} - 1) <= 0.03::DOUBLE THEN ln(1.0::DOUBLE / {k}) WHEN abs(r / {k} - 1) <= 0.03::DOUBLE THEN ln({k}.0::DOUBLE)"
                   for k in market.SPLIT_RATIOS)
_label = " ".join(f"WHEN abs(r * {k} - 1) <= 0.03::DOUBLE THEN '{k}:1' WHEN abs(r / {k} - 1) <= 0.03::DOUBLE THEN '1:{k}'"
                  for k in market.SPLIT_RATIOS)
view("splits_p", f"""SELECT *, CASE WHEN r > 0 THEN CASE {_factor} END END AS lf, CASE WHEN r > 0 THEN CASE {_label} END END
  AS split_ratio FROM (SELECT *, open / lag(close) OVER (PARTITION BY ticker ORDER BY bar) AS r FROM prices_p)""")


@query("price_bars", "SELECT * FROM prices_p")
def price_bars(spark, sf):
    return bars(spark, sf)


@query("price_splits", "SELECT ticker, bar, split_ratio FROM splits_p WHERE split_ratio IS NOT NULL")
def price_splits(spark, sf):
    return market.split_events(bars(spark, sf)).where("split_ratio is not null").select("ticker", "bar", "split_ratio")


@query("split_adjusted_prices", """SELECT ticker, bar, round(ln(close) + a, 6) AS log_close, round(ln(open) + a, 6) AS log_open,
  round(ln(high) + a, 6) AS log_high, round(ln(low) + a, 6) AS log_low, round(ln(volume) - a, 6) AS log_volume
FROM (SELECT *, coalesce(sum(lf) OVER (PARTITION BY ticker ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS a
      FROM splits_p)""")
def split_adjusted(spark, sf):
    adj = market.adjust_splits(bars(spark, sf))
    return adj.select("ticker", "bar", *[F.round(F.ln(c), 6).alias(f"log_{c}") for c in
                                         ("close", "open", "high", "low", "volume")])


_Z = {"ret_z": "ret", "volume_z": "lv", "range_z": "rng", "gap_z": "gap"}
_hist = ", ".join(f"list({c}) OVER w AS h_{z}, count({c}) OVER w AS n_{z}" for z, c in _Z.items())
_zs = ", ".join(f"CASE WHEN n_{z} >= 30 THEN ({c} - list_median(h_{z})) / nullif(1.4826::DOUBLE * list_median(list_transform(h_{z}, "
                f"lambda x: abs(x - list_median(h_{z})))), 0) END AS {z}" for z, c in _Z.items())
view("robust_p", f"""SELECT ticker, bar, ret, {', '.join(_Z)}, abs(ret_z) AS abs_ret_z FROM (SELECT *, {_zs} FROM (
  SELECT *, {_hist} FROM (SELECT *, ln(close / lag(close) OVER o) AS ret, ln(1 + volume) AS lv, (high - low) / close AS rng,
    ln(open / lag(close) OVER o) AS gap FROM prices_p WINDOW o AS (PARTITION BY ticker ORDER BY bar))
  WINDOW w AS (PARTITION BY ticker ORDER BY bar ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)))
  WHERE ret_z IS NOT NULL AND volume_z IS NOT NULL AND range_z IS NOT NULL AND gap_z IS NOT NULL""")
view("maxz_p", "SELECT *, greatest(abs_ret_z, abs(volume_z), abs(range_z), abs(gap_z)) AS max_z FROM robust_p")


@query("robust_z_scores", "SELECT ticker, bar, " + ", ".join(f"round({z}, 5) AS {z}" for z in (*_Z, "abs_ret_z", "ret"))
       + " FROM robust_p")
def robust_z(spark, sf):
    z = market.robust_z(bars(spark, sf))
    return z.select("ticker", "bar", *[F.round(c, 5).alias(c) for c in (*_Z, "abs_ret_z", "ret")])


@query("market_anomaly_rule", """SELECT ticker, bar, round(max_z, 5) AS max_z, round(least(1, max_z / 10), 5) AS score
FROM maxz_p WHERE max_z >= 5""")
def market_rule(spark, sf):
    z = market.max_abs_z(market.robust_z(bars(spark, sf))).where("flagged")
    return z.select("ticker", "bar", F.round("max_z", 5).alias("max_z"), F.round("score", 5).alias("score"))


@query("background_days", "SELECT ticker, max_z < 4 AS ordinary, count(*) AS n FROM maxz_p GROUP BY 1, 2")
def background(spark, sf):
    z = market.background_days(market.robust_z(bars(spark, sf)))
    return z.groupBy("ticker", "ordinary").agg(F.count("*").alias("n"))


def _metrics_sql(src, per_year, vol):
    n6, n12 = per_year // 2, per_year
    return (f"SELECT ticker, bar, close, row_number() OVER o AS bars, close / lag(close, {n6}) OVER o - 1 AS return_6m, "
            f"close / lag(close, {n12}) OVER o - 1 AS return_12m, 1 - close / max(close) OVER (PARTITION BY ticker ORDER BY bar "
            f"ROWS BETWEEN {n12} PRECEDING AND CURRENT ROW) AS drawdown_52w, stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY bar "
            f"ROWS BETWEEN {vol - 1} PRECEDING AND CURRENT ROW) AS sd FROM (SELECT *, ln(close / lag(close) OVER "
            f"(PARTITION BY ticker ORDER BY bar)) AS lr FROM {src}) WINDOW o AS (PARTITION BY ticker ORDER BY bar)")


view("weekly_metrics", _metrics_sql("weekly_p", 52, 13))
view("daily_metrics", _metrics_sql("prices_p", 252, 63))


@query("trailing_returns", """SELECT ticker, bar, bars, round(return_6m, 6) AS return_6m, round(return_12m, 6) AS return_12m,
  round(drawdown_52w, 6) AS drawdown_52w, round(sd * sqrt(52), 6) AS volatility FROM weekly_metrics""")
def trailing_returns(spark, sf):
    m = market.series_metrics(bars(spark, sf, 21600), 52, 13)
    return m.select("ticker", "bar", F.col("bars").cast("bigint").alias("bars"), F.round("return_6m", 6).alias("return_6m"),
                    F.round("return_12m", 6).alias("return_12m"), F.round("drawdown_52w", 6).alias("drawdown_52w"),
                    F.round(F.col("_sd") * F.sqrt(F.lit(52.0)), 6).alias("volatility"))


def ticker_asofs(spark, sf):
    """Every ticker at every day of the stream, against the alphabetically next ticker as its benchmark."""
    pairs = dict(zip(TICKERS, TICKERS[1:] + TICKERS[:1]))
    from keelson.functions.dims import map_literal
    days = views.table(spark, sf, "events").select(F.to_date("ts").alias("as_of"), F.col("event_type").alias("ticker")).distinct()
    return days.withColumn("benchmark", F.element_at(map_literal(pairs), F.col("ticker")))


_next = "CASE ticker " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(TICKERS, TICKERS[1:] + TICKERS[:1])) + " END"
_pick = ("SELECT a.ticker, a.as_of, arg_max(m, m.bar) AS m FROM market_asofs a JOIN {src} m ON m.ticker = a.{key} AND "
         "CAST(m.bar AS DATE) <= a.as_of AND date_diff('day', CAST(m.bar AS DATE), a.as_of) <= 10 GROUP BY a.ticker, a.as_of")
view("market_asofs", f"SELECT DISTINCT event_type AS ticker, CAST(ts AS DATE) AS as_of, {_next.replace('ticker', 'event_type')} "
                     "AS benchmark FROM events")
view("market_p", f"""SELECT a.ticker, a.as_of, a.benchmark,
  CASE WHEN w.m.bars >= 53 THEN 'weekly adjusted close' ELSE 'daily close (split-adjusted)' END AS basis,
  CASE WHEN w.m.bars >= 53 THEN w.m.return_6m ELSE d.m.return_6m END AS return_6m,
  CASE WHEN w.m.bars >= 53 THEN w.m.return_12m ELSE d.m.return_12m END AS return_12m,
  CASE WHEN w.m.bars >= 53 THEN w.m.drawdown_52w ELSE d.m.drawdown_52w END AS drawdown_52w,
  CASE WHEN w.m.bars >= 53 THEN w.m.close ELSE d.m.close END AS last_close,
  CASE WHEN d.m.bars >= 63 THEN d.m.sd * sqrt(252::DOUBLE) ELSE w.m.sd * sqrt(52::DOUBLE) END AS vol_90d,
  CASE WHEN w.m.bars >= 53 AND b.m.bars > 52 THEN w.m.return_6m - b.m.return_6m END AS excess_6m,
  CASE WHEN w.m.bars >= 53 AND b.m.bars > 52 THEN w.m.return_12m - b.m.return_12m END AS excess_12m
FROM market_asofs a LEFT JOIN ({_pick.format(src='weekly_metrics', key='ticker')}) w USING (ticker, as_of)
LEFT JOIN ({_pick.format(src='daily_metrics', key='ticker')}) d USING (ticker, as_of)
LEFT JOIN ({_pick.format(src='weekly_metrics', key='benchmark')}) b USING (ticker, as_of)
WHERE w.m.bars >= 53 OR d.m.bars >= 253""")
_MC = ["return_6m", "return_12m", "drawdown_52w", "vol_90d", "excess_6m", "excess_12m"]


@query("market_metrics", "SELECT ticker, as_of, benchmark, basis, last_close, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _MC) + " FROM market_p")
def market_metrics(spark, sf):
    m = market.market_metrics(bars(spark, sf), bars(spark, sf, 21600), ticker_asofs(spark, sf))
    return m.select("ticker", "as_of", "benchmark", "basis", "last_close", *[F.round(c, 6).alias(c) for c in _MC])


@query("earnings_day_match", """SELECT d.cik, d.day, EXISTS (SELECT 1 FROM filings_p f WHERE f.cik = d.cik AND f.form LIKE '8-K%'
  AND contains(f.items, '2.02') AND (f.filed = d.day OR f.filed + 1 = d.day)) AS is_event
FROM (SELECT DISTINCT cik, filed AS day FROM filings_p) d""")
def earnings_days(spark, sf):
    f = views.filings(spark, sf)
    return market.match_days(f.select("cik", F.col("filed").alias("day")).distinct(), f).select("cik", "day", "is_event")
