"""Rule-based warning signals for every company of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: code, event types, window in days, severity, message ---------------------------------------
EVENT_RULES = [
    ("BANKRUPTCY", ["BANKRUPTCY"], 365, "CRITICAL", "Bankruptcy or receivership disclosed (8-K Item 1.03)"),
    ("RESTATEMENT", ["RESTATEMENT"], 365, "HIGH", "Non-reliance on previously issued financial statements (8-K Item 4.02)"),
    ("DELISTING", ["DELISTING_NOTICE"], 365, "HIGH", "Exchange delisting notice / listing-rule failure (8-K Item 3.01)"),
    ("LATE_FILING", ["LATE_FILING"], 365, "HIGH", "Notification of late filing (NT 10-K / NT 10-Q)"),
    ("DEBT_ACCELERATION", ["DEBT_ACCELERATION"], 365, "HIGH", "Event accelerating a financial obligation (8-K Item 2.04)"),
    ("AUDITOR_CHANGE", ["AUDITOR_CHANGE"], 365, "MEDIUM", "Change of certifying accountant (8-K Item 4.01)"),
    ("LAYOFFS", ["RESTRUCTURING", "LAYOFFS"], 90, "MEDIUM", "Layoffs or restructuring disclosed in the last 90 days"),
    ("CYBER_INCIDENT", ["CYBER_INCIDENT"], 365, "MEDIUM", "Material cybersecurity incident disclosed"),
]
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)


def event_signals(load: DataFrame) -> DataFrame:
    """load: events aged 0..365 (cik, as_of, type, date, age). One signal per rule that has a hit, dated at the latest."""
    rules = F.array_compact(F.array(*[
        F.when(F.col("type").isin(types) & (F.col("age") <= days),
               F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(msg).alias("message")))
        for code, types, days, sev, msg in EVENT_RULES]))
    return (load.select("cik", "as_of", "date", F.inline(rules)).groupBy("cik", "as_of", "code", "severity", "message")
            .agg(F.max("date").alias("date")).withColumn("kind", F.lit("Rule"))
            .select("cik", "as_of", "code", "severity", "kind", "date", "message"))


def turnover_signals(load: DataFrame) -> DataFrame:
    """Three or more director/officer changes in 180 days."""
    g = (load.where((F.col("type") == "EXEC_DEPARTURE") & (F.col("age") <= 180)).groupBy("cik", "as_of")
         .agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("date")).where("n >= 3"))
    msg = F.concat(F.col("n").cast("string"), F.lit(" director/officer change filings (8-K Item 5.02) in 180 days"))
    return g.select("cik", "as_of", F.lit("EXEC_TURNOVER").alias("code"), F.lit("MEDIUM").alias("severity"),
                    F.lit("Rule").alias("kind"), "date", msg.alias("message"))


def value_signals(inputs: DataFrame) -> DataFrame:
    """inputs: one row per (cik, as_of) with bank, the feature columns, drawdown_52w, market_anomaly_max,
    statement_anomaly, distress_probability, distress_band, sentiment_shock (NULL where not known)."""
    c = F.col

    def signal(when, code, severity, kind, message):
        sev = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(code).alias("code"), sev.alias("severity"), F.lit(kind).alias("kind"),
                                     F.lit(None).cast("date").alias("date"), message.alias("message")))

    fs = F.format_string
    found = F.array_compact(F.array(
        signal(~c("bank") & (c("altman_z2") < 1.1), "ALTMAN_DISTRESS", "HIGH", "Stat",
               fs("Altman Z''-score %.2f is in the distress zone (< 1.1)", c("altman_z2"))),
        signal((c("current_ratio") < 1.0) & (c("neg_fcf_quarters") >= 2), "LIQUIDITY_SQUEEZE", "HIGH", "Stat",
               fs("Current ratio %.2f with negative free cash flow in %d of the last 4 quarters", c("current_ratio"),
                  c("neg_fcf_quarters").cast("int"))),
        signal(c("negative_equity") == 1.0, "NEGATIVE_EQUITY", "MEDIUM", "Stat",
               F.lit("Total liabilities exceed total assets (negative shareholders' equity)")),
        signal(c("bank") & (c("securities_loss_equity") > 0.5), "SECURITIES_LOSSES", "HIGH", "Stat",
               fs("Unrealised securities losses equal %.0f%% of equity", c("securities_loss_equity") * 100)),
        signal(c("bank") & (c("deposit_growth") < -0.10), "DEPOSIT_OUTFLOW", "HIGH", "Stat",
               fs("Deposits fell %.0f%% year over year", F.abs("deposit_growth") * 100)),
        signal(c("drawdown_52w") >= 0.30, "DRAWDOWN", "MEDIUM", "Stat",
               fs("Share price %.0f%% below its 52-week high", c("drawdown_52w") * 100)),
        signal(c("market_anomaly_max") >= 0.99, "MARKET_ANOMALY", "LOW", "ML",
               F.lit("Unusual trading pattern in the last 14 days (market anomaly detector)")),
        signal(c("statement_anomaly") >= 0.95, "STATEMENT_ANOMALY", "MEDIUM", "ML",
               F.lit("Year-over-year changes in the latest statements are unusual (top 5% anomaly score)")),
        signal(c("distress_band").isin("HIGH", "ELEVATED"), "DISTRESS_MODEL",
               F.when(c("distress_band") == "HIGH", "HIGH").otherwise("MEDIUM"), "ML",
               fs("Distress model estimates a %.1f%% probability of a bankruptcy filing within 12 months (%s band)",
                  c("distress_probability") * 100, F.lower("distress_band"))),
        signal(c("sentiment_shock"), "SENTIMENT_SHOCK", "MEDIUM", "ML",
               F.lit("News sentiment in the last 7 days is more than 2 standard deviations below its 90-day baseline"))))
    return inputs.select("cik", "as_of", F.inline(found))


def ordered(signals: DataFrame) -> DataFrame:
    """Position of each signal in its company's list: severity first, then the newest date, then the code."""
    listed = signals.groupBy("cik", "as_of").agg(F.array_sort(F.collect_list(F.struct(
        severity_rank(F.col("severity")).alias("r"), (-F.coalesce(F.datediff("date", F.lit("1970-01-01")), F.lit(-1_000_000))).alias("d"),
        "code", "severity", "kind", "date", "message"))).alias("s"))
    return (listed.select("cik", "as_of", F.posexplode("s").alias("position", "x"))
            .select("cik", "as_of", "position", "x.code", "x.severity", "x.kind", "x.date", "x.message"))


def statement_anomaly_events(scores: DataFrame, filings: DataFrame) -> DataFrame:
    """Anomaly score >= 0.95: a penalty-10 event at the latest periodic filing known at as_of (else at as_of itself)."""
    hot = scores.where(F.col("statement_anomaly") >= 0.95).select("cik", "as_of")
    periodic = filings.where(F.col("form").rlike(r"^10-[KQ]")).select("cik", "filed")
    known = hot.join(periodic, "cik", "left").groupBy("cik", "as_of").agg(
        F.max(F.when(F.col("filed") <= F.col("as_of"), F.col("filed"))).alias("filed"))
    return known.select("cik", "as_of", F.coalesce("filed", "as_of").alias("date"), F.lit("STATEMENT_ANOMALY").alias("type"),
                        F.lit("Unusual year-over-year statement changes (ML)").alias("label"), F.lit("MEDIUM").alias("severity"),
                        F.lit(10.0).alias("penalty"), F.lit(None).cast("double").alias("cap"))
