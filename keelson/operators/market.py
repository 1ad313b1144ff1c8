"""Price operators. Series are unique per (ticker, bar), so a ticker's window is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.numeric import let, sorted_median

SPLIT_RATIOS = [2, 3, 4, 5, 8, 10, 15, 20, 25, 30, 40, 50]     # fixed values
Z_COLUMNS = ["ret_z", "volume_z", "range_z", "gap_z"]


def by_ticker():
    return W.partitionBy("ticker").orderBy("bar")


def split_events(prices: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Adds split_factor (what earlier prices are multiplied by) and split_ratio where an overnight jump is near k:1."""
    r = F.col("open") / F.nullif(F.lag("close").over(by_ticker()), F.lit(0.0))
    factor, label = F.when(F.lit(False), F.lit(1.0)), F.when(F.lit(False), F.lit(""))
    for k in SPLIT_RATIOS:
        down, up = F.abs(F.col("_r") * k - 1) <= tolerance, F.abs(F.col("_r") / k - 1) <= tolerance
        factor = factor.when(down, F.lit(1.0 / k)).when(up, F.lit(float(k)))
        label = label.when(down, F.lit(f"{k}:1")).when(up, F.lit(f"1:{k}"))
    usable = F.col("_r") > 0
    return (prices.withColumn("_r", r)
            .withColumn("split_factor", F.when(usable, factor)).withColumn("split_ratio", F.when(usable, label)).drop("_r"))


def adjust_splits(prices: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Back-adjust prices for every later split; volume moves the other way."""
    later = by_ticker().rowsBetween(1, W.unboundedFollowing)
    jumps = split_events(prices, tolerance)
    adj = jumps.withColumn("adjustment", F.exp(F.coalesce(F.sum(F.ln("split_factor")).over(later), F.lit(0.0))))
    scaled = {c: F.col(c) * F.col("adjustment") for c in ("open", "high", "low", "close")}
    return adj.withColumns({**scaled, "volume": F.col("volume") / F.col("adjustment")})


def robust_z(prices: DataFrame, window: int = 60) -> DataFrame:
    """Trailing robust z-scores against the previous `window` bars, of which half must have a value; rows with any NULL dropped."""
    w = by_ticker()
    prev_close = F.lag("close").over(w)
    base = prices.withColumns({
        "ret": F.ln(F.try_divide("close", prev_close)), "_volume": F.log1p("volume"),
        "_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "_gap": F.ln(F.try_divide("open", prev_close))})
    past = w.rowsBetween(-window, -1)
    sources = {"ret_z": "ret", "volume_z": "_volume", "range_z": "_range", "gap_z": "_gap"}
    base = base.withColumns({f"_h_{z}": F.collect_list(c).over(past) for z, c in sources.items()})

    def z(x: Column, hist: Column) -> Column:
        def scaled(h):
            return let(sorted_median(h), lambda med: (x - med) / F.nullif(
                sorted_median(F.transform(h, lambda v: F.abs(v - med))) * 1.4826, F.lit(0.0)))
        return F.when(F.size(hist) >= window // 2, let(hist, scaled))

    out = base.withColumns({name: z(F.col(c), F.col(f"_h_{name}")) for name, c in sources.items()})
    out = out.withColumn("abs_ret_z", F.abs("ret_z")).dropna(subset=[*Z_COLUMNS, "abs_ret_z"])
    return out.drop(*[f"_h_{z}" for z in sources], "_volume", "_range", "_gap")


def max_abs_z(zs: DataFrame) -> DataFrame:
    """Rule detector: the largest deviation flags a bar from 5 on, scored as a tenth of it up to 1."""
    top = F.greatest(*[F.abs(c) for c in ("abs_ret_z", "volume_z", "range_z", "gap_z")])
    return zs.withColumn("max_z", top).withColumns(
        {"flagged": F.col("max_z") >= 5.0, "score": F.least(F.lit(1.0), F.col("max_z") / 10.0)})


def background_days(zs: DataFrame, limit: float = 4.0) -> DataFrame:
    """Marks ordinary bars (max z below the limit) as the negatives of an injection benchmark."""
    return max_abs_z(zs).withColumn("ordinary", F.col("max_z") < limit)


def series_metrics(prices: DataFrame, per_year: int, vol_window: int) -> DataFrame:
    """Per bar: bars so far, half- and full-year return, drawdown, volatility of the last vol_window log returns."""
    w = by_ticker()
    n6, n12 = per_year // 2, per_year
    logret = F.ln(F.col("close") / F.lag("close").over(w))
    df = prices.withColumn("_lr", logret)
    return df.select(
        "ticker", "bar", "close", F.row_number().over(w).alias("bars"),
        (F.col("close") / F.lag("close", n6).over(w) - 1).alias("return_6m"),
        (F.col("close") / F.lag("close", n12).over(w) - 1).alias("return_12m"),
        (1 - F.col("close") / F.max("close").over(w.rowsBetween(-n12, 0))).alias("drawdown_52w"),
        F.stddev_samp("_lr").over(w.rowsBetween(1 - vol_window, 0)).alias("_sd"))


def latest_within(asofs: DataFrame, rows: DataFrame, days: int = 10) -> DataFrame:
    """Newest row of each ticker dated on or before as_of, if at most `days` old (equality join on ticker and day)."""
    probes = asofs.select("ticker", "as_of").distinct().withColumn(
        "_d", F.explode(F.sequence(F.date_sub("as_of", days), F.col("as_of"))))
    keyed = rows.withColumn("_d", F.to_date("bar"))
    cols = [c for c in rows.columns if c != "ticker"]
    return (probes.join(keyed, ["ticker", "_d"]).groupBy("ticker", "as_of")
            .agg(F.max_by(F.struct(*cols), "bar").alias("r")).select("ticker", "as_of", "r.*"))


def market_metrics(daily: DataFrame, weekly: DataFrame, asofs: DataFrame) -> DataFrame:
    """Factors as of a date: the weekly series where it is long and fresh, else a long daily one, else no row.

    Volatility prefers the last 63 daily returns, otherwise 13 weekly ones. asofs may carry `benchmark`, another ticker of
    the weekly series, for the excess returns.
    """
    w = latest_within(asofs, series_metrics(weekly, 52, 13)).where(F.col("bars") >= 53)
    d = latest_within(asofs, series_metrics(daily, 252, 63)).where(F.col("bars") >= 63)
    keys = ["ticker", "as_of"]
    names = ["return_6m", "return_12m", "drawdown_52w", "close", "bar"]
    j = (w.select(*keys, *[F.col(c).alias(f"w_{c}") for c in names], F.col("_sd").alias("w_sd"))
         .join(d.select(*keys, *[F.col(c).alias(f"d_{c}") for c in names], F.col("_sd").alias("d_sd"),
                        F.col("bars").alias("d_bars")), keys, "full_outer"))
    use_w = F.col("w_bar").isNotNull()
    j = j.where(use_w | (F.col("d_bars") >= 253))
    out = j.select(*keys, *[F.when(use_w, F.col(f"w_{c}")).otherwise(F.col(f"d_{c}")).alias(
        {"close": "last_close", "bar": "last_bar"}.get(c, c)) for c in names],
        F.coalesce(F.col("d_sd") * F.sqrt(F.lit(252.0)), F.col("w_sd") * F.sqrt(F.lit(52.0))).alias("vol_90d"),
        F.when(use_w, "weekly adjusted close").otherwise("daily close (split-adjusted)").alias("basis"))
    if "benchmark" not in asofs.columns:
        return out
    bench = (latest_within(asofs.select(F.col("benchmark").alias("ticker"), "as_of"), series_metrics(weekly, 52, 13))
             .where(F.col("bars") > 52)
             .select(F.col("ticker").alias("benchmark"), "as_of", F.col("return_6m").alias("b6"),
                     F.col("return_12m").alias("b12")))
    weekly_basis = F.col("basis").startswith("weekly")
    return (asofs.select("ticker", "as_of", "benchmark").distinct().join(out, keys)
            .join(bench, ["benchmark", "as_of"], "left")
            .withColumns({"excess_6m": F.when(weekly_basis, F.col("return_6m") - F.col("b6")),
                          "excess_12m": F.when(weekly_basis, F.col("return_12m") - F.col("b12"))}).drop("b6", "b12"))


def match_days(days: DataFrame, filings: DataFrame, item: str = "2.02") -> DataFrame:
    """Flag (cik, day) rows that fall on, or one day after, an 8-K reporting the item."""
    hits = (filings.where(F.col("form").startswith("8-K") & F.col("items").contains(item))
            .select("cik", F.explode(F.array("filed", F.date_add("filed", 1))).alias("day")).distinct()
            .withColumn("is_event", F.lit(True)))
    return days.join(hits, ["cik", "day"], "left").withColumn("is_event", F.coalesce("is_event", F.lit(False)))
