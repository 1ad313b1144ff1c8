"""Point-in-time facts, series, snapshots, features, events, labels and the distress dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.functions.numeric import finite
from keelson.operators import events as ev
from keelson.operators import pit, ratios, series
from keelson.operators.snapshot import snapshot
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.registry import query

AS_OF = "2000-06-30"
FIRST, LAST = "1995-01-01", "2001-12-31"
MAX_AGE = 400
ANNUAL_FORMS = ["10-K", "10-KT"]
IN = lambda names: ", ".join(f"'{n}'" for n in names)


def one_date(spark, sf, as_of: str = AS_OF):
    return views.companies(spark, sf).select("cik", F.lit(as_of).cast("date").alias("as_of"))


def annual_filings(spark, sf):
    f = views.filings(spark, sf)
    return f.where(F.col("form").isin(ANNUAL_FORMS) & F.col("filed").between(FIRST, LAST))


view("asofs_one", f"SELECT cik, DATE '{AS_OF}' AS as_of FROM companies_p")
view("annual_p", f"SELECT * FROM filings_p WHERE form IN ({IN(ANNUAL_FORMS)}) AND filed BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
view("asofs_ak", "SELECT DISTINCT cik, filed AS as_of FROM annual_p")


# ------------------------------------------------------------------ oracle text for resolution, series, snapshot
def _latest(items: str, s: str, base: str, target: str, tol: str) -> str:
    return (f"SELECT cik, as_of, item, arg_max(val, \"end\") AS val FROM (SELECT i.*, p.period_end FROM {base} i "
            f"JOIN pe_{s} p USING (cik, as_of) WHERE i.item IN ({items}) AND i.\"end\" <= {target}) GROUP BY cik, as_of, item "
            f"HAVING date_diff('day', max(\"end\"), any_value({target})) <= {tol}")


def _near(s: str, base: str, col: str, target: str) -> str:
    return (f"SELECT cik, as_of, item, arg_max_null({col}, \"end\") AS val FROM (SELECT i.*, p.period_end FROM {base} i "
            f"JOIN pe_{s} p USING (cik, as_of) WHERE i.\"end\" <= {target} + 50) GROUP BY cik, as_of, item "
            f"HAVING abs(date_diff('day', max(\"end\"), any_value({target}))) <= 50")


def register_asof_views(s: str) -> None:
    view(f"known_{s}", f"""SELECT cik, as_of, item, start, "end", rank, filed, val FROM (
      SELECT a.cik, a.as_of, f.item, f.start, f."end", f.rank, f.filed, f.val, row_number() OVER (PARTITION BY a.cik,
        a.as_of, f.item, f.start, f."end" ORDER BY f.rank, f.filed DESC, f.val DESC) AS rn
      FROM (SELECT DISTINCT cik, as_of FROM asofs_{s}) a JOIN facts_p f ON f.cik = a.cik AND f.filed <= a.as_of) WHERE rn = 1""")
    pick = ("SELECT cik, as_of, item, \"end\", val FROM (SELECT *, row_number() OVER (PARTITION BY cik, as_of, item, "
            "\"end\" ORDER BY rank, start NULLS FIRST) AS rn FROM known_{s}{w}) WHERE rn = 1")
    view(f"inst_{s}", pick.format(s=s, w=""))
    view(f"annu_{s}", pick.format(s=s, w=" WHERE date_diff('day', start, \"end\") BETWEEN 340 AND 390"))
    view(f"quar_{s}", f"""SELECT cik, as_of, item, "end", val FROM (
      SELECT *, lead("end") OVER (PARTITION BY cik, as_of, item ORDER BY "end") AS nxt FROM (
        SELECT cik, as_of, item, "end", v AS val, row_number() OVER (PARTITION BY cik, as_of, item, "end"
            ORDER BY pri, start) AS rn
        FROM (SELECT *, CASE WHEN date_diff('day', start, "end") BETWEEN 75 AND 105 THEN 0 ELSE 1 END AS pri,
                CASE WHEN date_diff('day', start, "end") BETWEEN 75 AND 105 THEN val
                     WHEN date_diff('day', pend, "end") BETWEEN 75 AND 105 THEN val - pval END AS v
              FROM (SELECT *, lag("end") OVER c AS pend, lag(val) OVER c AS pval FROM known_{s} WHERE start IS NOT NULL
                    WINDOW c AS (PARTITION BY cik, as_of, item, start ORDER BY "end")))
        WHERE v IS NOT NULL) WHERE rn = 1) WHERE nxt IS NULL OR date_diff('day', "end", nxt) > 20""")
    view(f"roll_{s}", f"""SELECT *, CASE WHEN date_diff('day', lag("end", 3) OVER w, "end") BETWEEN 240 AND 300
      THEN lag(val, 3) OVER w + lag(val, 2) OVER w + lag(val, 1) OVER w + val END AS year_sum
      FROM quar_{s} WINDOW w AS (PARTITION BY cik, as_of, item ORDER BY "end")""")
    view(f"pe_{s}", f"""SELECT cik, as_of, max("end") AS period_end FROM inst_{s}
      WHERE item = 'TotalAssets' AND "end" <= as_of GROUP BY cik, as_of""")
    stocks, flows = IN(dims.STOCK_ITEMS), IN(dims.FLOW_ITEMS)
    tol = "any_value(CASE WHEN item = 'PublicFloat' THEN 400 ELSE 45 END)"
    for side, target in (("v", "period_end"), ("p", "period_end - 365")):
        view(f"side_{side}_{s}", f"""SELECT cik, as_of, item, val FROM ({_latest(stocks, s, f'inst_{s}', f'{target} + 5', tol)})
          UNION ALL SELECT cik, as_of, item, coalesce(a.val, q.val) FROM ({_near(s, f'annu_{s}', 'val', target)}) a
          FULL JOIN ({_near(s, f'roll_{s}', 'year_sum', target)}) q USING (cik, as_of, item) WHERE item IN ({flows})""")
    def wide(side):
        cols = ", ".join(f"max(CASE WHEN item = '{i}' THEN val END) AS {side}_{i}" for i in dims.FLOW_ITEMS + dims.STOCK_ITEMS)
        return f"(SELECT cik, as_of, {cols} FROM side_{side}_{s} GROUP BY cik, as_of)"
    fill = ", ".join(f"coalesce({x}_TotalLiabilities, {x}_LiabilitiesAndEquity - {x}_StockholdersEquity) AS {x}_TotalLiabilities, "
                     f"coalesce({x}_GrossProfit, {x}_Revenue - {x}_CostOfRevenue) AS {x}_GrossProfit" for x in "vp")
    drop = "v_TotalLiabilities, v_GrossProfit, p_TotalLiabilities, p_GrossProfit"
    view(f"snap_{s}", f"""SELECT w.* EXCLUDE ({drop}), {fill} FROM (SELECT * FROM pe_{s} LEFT JOIN {wide('v')}
      USING (cik, as_of) LEFT JOIN {wide('p')} USING (cik, as_of)) w""")
    view(f"negq_{s}", f"""SELECT cik, as_of, CASE WHEN count(*) = 4 THEN CAST(sum(CASE WHEN val - cap < 0 THEN 1 ELSE 0 END)
        AS DOUBLE) END AS neg_fcf_quarters FROM (SELECT o.*, coalesce(c.val, 0) AS cap, row_number() OVER (PARTITION BY
        o.cik, o.as_of ORDER BY o."end" DESC) AS rn FROM quar_{s} o LEFT JOIN (SELECT * FROM quar_{s} WHERE item = 'CapEx') c
        ON c.cik = o.cik AND c.as_of = o.as_of AND c."end" = o."end" WHERE o.item = 'OperatingCashFlow') WHERE rn <= 4
        GROUP BY cik, as_of""")
    view(f"slope8_{s}", f"""SELECT a.cik, a.as_of, quantile_cont((b.val - a.val) / (a.rn - b.rn), 0.5)
        / nullif(any_value(a.scale), 0) AS revenue_slope_8q
      FROM (SELECT *, avg(abs(val)) OVER (PARTITION BY cik, as_of) AS scale, count(*) OVER (PARTITION BY cik, as_of) AS n
            FROM rev8_{s}) a JOIN rev8_{s} b ON a.cik = b.cik AND a.as_of = b.as_of AND b.rn < a.rn
      WHERE a.n >= 4 GROUP BY a.cik, a.as_of""")
    view(f"rev8_{s}", f"""SELECT * FROM (SELECT cik, as_of, val, row_number() OVER (PARTITION BY cik, as_of ORDER BY "end" DESC)
        AS rn FROM quar_{s} WHERE item = 'Revenue') WHERE rn <= 8""")
    view(f"ratios_{s}", f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in RATIO_SQL2.items())} FROM ("
         f"SELECT s.*, {', '.join(f'{e} AS {n}' for n, e in RATIO_SQL.items())}, n.neg_fcf_quarters, r.revenue_slope_8q "
         f"FROM snap_{s} s LEFT JOIN negq_{s} n USING (cik, as_of) LEFT JOIN slope8_{s} r USING (cik, as_of))")


def _d(a, b):
    return f"(({a}) / nullif({b}, 0))"


def _up(a, b, op=">"):
    return f"{_d(f'v_{a}', f'v_{b}')} {op} {_d(f'p_{a}', f'p_{b}')}"


RATIO_SQL = {
    "log_assets": "CASE WHEN v_TotalAssets > 0 THEN log10(v_TotalAssets) END",
    "net_margin": _d("v_NetIncome", "v_Revenue"), "roa": _d("v_NetIncome", "v_TotalAssets"),
    "ebit_assets": _d("v_OperatingIncome", "v_TotalAssets"), "gross_margin": _d("v_GrossProfit", "v_Revenue"),
    "current_ratio": _d("v_CurrentAssets", "v_CurrentLiabilities"), "cash_assets": _d("v_Cash", "v_TotalAssets"),
    "debt_equity": f"CASE WHEN v_StockholdersEquity > 0 THEN {_d('v_LongTermDebt', 'v_StockholdersEquity')} END",
    "liabilities_assets": _d("v_TotalLiabilities", "v_TotalAssets"),
    "interest_coverage": _d("v_OperatingIncome", "abs(v_InterestExpense)"),
    "negative_equity": "CAST(v_StockholdersEquity < 0 AS DOUBLE)",
    "ocf_liabilities": _d("v_OperatingCashFlow", "v_TotalLiabilities"),
    "fcf_margin": _d("v_OperatingCashFlow - coalesce(v_CapEx, 0)", "v_Revenue"),
    "revenue_yoy": f"CASE WHEN p_Revenue > 0 THEN {_d('v_Revenue', 'p_Revenue')} - 1 END",
    "d_net_margin": f"{_d('v_NetIncome', 'v_Revenue')} - {_d('p_NetIncome', 'p_Revenue')}",
    "d_current_ratio": f"{_d('v_CurrentAssets', 'v_CurrentLiabilities')} - {_d('p_CurrentAssets', 'p_CurrentLiabilities')}",
    "wc_ta": _d("v_CurrentAssets - v_CurrentLiabilities", "v_TotalAssets"), "re_ta": _d("v_RetainedEarnings", "v_TotalAssets"),
    "be_tl": _d("v_StockholdersEquity", "v_TotalLiabilities"),
    "float_liabilities": _d("v_PublicFloat", "v_TotalLiabilities"),
    "bn_dsri": _d(_d("v_Receivables", "v_Revenue"), _d("p_Receivables", "p_Revenue")),
    "bn_gmi": _d(_d("p_GrossProfit", "p_Revenue"), _d("v_GrossProfit", "v_Revenue")),
    "bn_aqi": _d(f"1 - {_d('v_CurrentAssets + v_PPE', 'v_TotalAssets')}", f"1 - {_d('p_CurrentAssets + p_PPE', 'p_TotalAssets')}"),
    "bn_sgi": _d("v_Revenue", "p_Revenue"),
    "bn_depi": _d(_d("p_Depreciation", "p_Depreciation + p_PPE"), _d("v_Depreciation", "v_Depreciation + v_PPE")),
    "bn_sgai": _d(_d("v_SGA", "v_Revenue"), _d("p_SGA", "p_Revenue")),
    "bn_lvgi": _d(_d("v_TotalLiabilities", "v_TotalAssets"), _d("p_TotalLiabilities", "p_TotalAssets")),
    "bn_tata": _d("v_NetIncome - v_OperatingCashFlow", "v_TotalAssets"),
    "piotroski_f": f"CASE WHEN {_d('v_NetIncome', 'v_TotalAssets')} IS NOT NULL THEN " + " + ".join(
        f"CAST(coalesce({c}, false) AS DOUBLE)" for c in (
            f"{_d('v_NetIncome', 'v_TotalAssets')} > 0", "v_OperatingCashFlow > 0", _up("NetIncome", "TotalAssets"),
            "v_OperatingCashFlow > v_NetIncome", _up("LongTermDebt", "TotalAssets", "<"),
            _up("CurrentAssets", "CurrentLiabilities"),
            "NOT coalesce(v_SharesOutstanding > p_SharesOutstanding * 1.02::DOUBLE, false)",
            _up("GrossProfit", "Revenue"), _up("Revenue", "TotalAssets"))) + " END",
    "equity_assets": _d("v_StockholdersEquity", "v_TotalAssets"),
    "securities_loss_equity": _d(
        "CASE WHEN v_HtmAmortizedCost - v_HtmFairValue IS NOT NULL OR v_AfsAmortizedCost - v_AfsFairValue IS NOT NULL THEN "
        "coalesce(CASE WHEN v_HtmAmortizedCost - v_HtmFairValue > 0 THEN v_HtmAmortizedCost - v_HtmFairValue ELSE 0 END, 0) + "
        "coalesce(CASE WHEN v_AfsAmortizedCost - v_AfsFairValue > 0 THEN v_AfsAmortizedCost - v_AfsFairValue ELSE 0 END, 0) END",
        "v_StockholdersEquity"),
    "deposit_growth": f"{_d('v_Deposits', 'p_Deposits')} - 1", "loans_deposits": _d("v_Loans", "v_Deposits"),
    "bank_roa": _d("v_NetIncome", "v_TotalAssets"),
}
RATIO_SQL2 = {
    "altman_z2": "6.56::DOUBLE * wc_ta + 3.26::DOUBLE * re_ta + 6.72::DOUBLE * ebit_assets + 1.05::DOUBLE * be_tl",
    "ohlson_o": "CASE WHEN v_TotalAssets > 0 THEN -1.32::DOUBLE - 0.407::DOUBLE * ln(v_TotalAssets / 1e6) + 6.03::DOUBLE * "
                "liabilities_assets - 1.43::DOUBLE * wc_ta + 0.0757::DOUBLE * (v_CurrentLiabilities / nullif(v_CurrentAssets, 0)) "
                "- 1.72::DOUBLE * CAST(v_TotalLiabilities > v_TotalAssets AS DOUBLE) - 2.37::DOUBLE * roa - 1.83::DOUBLE * "
                "coalesce(ocf_liabilities, 0) + 0.285::DOUBLE * CAST(coalesce(v_NetIncome < 0 AND p_NetIncome < 0, false) AS DOUBLE) "
                "- 0.521::DOUBLE * coalesce((v_NetIncome - p_NetIncome) / nullif(abs(v_NetIncome) + abs(p_NetIncome), 0), 0) END",
    "beneish_m": "-4.84::DOUBLE + 0.920::DOUBLE * bn_dsri + 0.528::DOUBLE * bn_gmi + 0.404::DOUBLE * bn_aqi + 0.892::DOUBLE * bn_sgi "
                 "+ 0.115::DOUBLE * bn_depi - 0.172::DOUBLE * bn_sgai + 4.679::DOUBLE * bn_tata - 0.327::DOUBLE * bn_lvgi",
}
for _s in ("one", "ak"):
    register_asof_views(_s)

DEC = 6


def rounded(df, cols, d=DEC):
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


def sql_rounded(cols, d=DEC, prefix=""):
    return ", ".join(f"round({prefix}{c}, {d}) AS {c}" for c in cols)


# ------------------------------------------------------------------ facts
@query("facts_first_filed", 'SELECT cik, item, rank, start, "end", val, filed, accn FROM facts_p')
def facts_first_filed(spark, sf):
    return views.facts(spark, sf, with_accn=True)


@query("facts_sane_and_whitelisted", f"""
SELECT form, count(*) AS n, min(filed) AS first_filed, max("end") AS last_end FROM facts_raw_p
WHERE form IN ({IN(pit.FACT_FORMS)}) AND filed >= DATE '1997-01-01'
  AND "end" BETWEEN DATE '1990-01-01' AND DATE '2100-01-01' AND filed BETWEEN DATE '1990-01-01' AND DATE '2100-01-01'
  AND (start IS NULL OR start BETWEEN DATE '1990-01-01' AND DATE '2100-01-01') GROUP BY form""")
def facts_sane(spark, sf):
    f = pit.sane_dates(pit.fact_filter(views.facts_raw(spark, sf), "1997-01-01"))
    return f.groupBy("form").agg(F.count("*").alias("n"), F.min("filed").alias("first_filed"), F.max("end").alias("last_end"))


@query("facts_known_as_of", 'SELECT cik, as_of, item, start, "end", rank, filed, val FROM known_one')
def facts_known_as_of(spark, sf):
    return pit.known_as_of(views.facts(spark, sf), one_date(spark, sf))


@query("facts_known_at_each_annual_filing", """
SELECT cik, as_of, item, count(*) AS periods, max("end") AS last_end, min(rank) AS best_rank, max(filed) AS last_filed,
       max(val) AS max_val, min(val) AS min_val FROM known_ak GROUP BY cik, as_of, item""")
def facts_known_many(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    return (pit.known_as_of(views.facts(spark, sf), asofs).groupBy("cik", "as_of", "item")
            .agg(F.count("*").alias("periods"), F.max("end").alias("last_end"), F.min("rank").alias("best_rank"),
                 F.max("filed").alias("last_filed"), F.max("val").alias("max_val"),
                 F.min("val").alias("min_val")))


# ------------------------------------------------------------------ series
def _known_one(spark, sf):
    return pit.known_as_of(views.facts(spark, sf), one_date(spark, sf))


KEYS = ["cik", "as_of"]
_SERIES = 'SELECT cik, as_of, item, "end", val FROM {v} WHERE item IN ({i})'


@query("instant_series", _SERIES.format(v="inst_one", i=IN(dims.STOCK_ITEMS)))
def instant(spark, sf):
    known = _known_one(spark, sf).where(F.col("item").isin(dims.STOCK_ITEMS))
    return series.instant_series(known, KEYS)


@query("annual_series", _SERIES.format(v="annu_one", i=IN(dims.FLOW_ITEMS)))
def annual(spark, sf):
    return series.annual_series(_known_one(spark, sf), KEYS)


@query("quarterly_series", _SERIES.format(v="quar_one", i=IN(dims.FLOW_ITEMS)))
def quarterly(spark, sf):
    return series.quarterly_series(_known_one(spark, sf), KEYS)


@query("trailing_twelve_months", """
SELECT cik, as_of, item, val AS ttm FROM side_v_one WHERE item IN ('Revenue', 'NetIncome', 'OperatingCashFlow')
  AND val IS NOT NULL""")
def trailing(spark, sf):
    snap = snapshot(views.facts(spark, sf), one_date(spark, sf))
    items = ["Revenue", "NetIncome", "OperatingCashFlow"]
    entries = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"v_{i}").alias("ttm")) for i in items])
    return snap.select("cik", "as_of", F.inline(entries)).where("ttm is not null")


@query("latest_balance_within_age", f"""
SELECT cik, as_of, item, val FROM side_v_one WHERE item IN ({IN(dims.STOCK_ITEMS)})""")
def latest_within(spark, sf):
    """Newest balance on or before the period end + 5 days, at most 45 days old (400 for the public float)."""
    known = _known_one(spark, sf).where(F.col("item").isin(dims.STOCK_ITEMS))
    inst = series.instant_series(known, KEYS)
    pe = (inst.where((F.col("item") == "TotalAssets") & (F.col("end") <= F.col("as_of")))
          .groupBy(*KEYS).agg(F.max("end").alias("period_end")))
    tol = F.when(F.col("item") == "PublicFloat", 400).otherwise(45)
    out = inst.join(pe, KEYS).groupBy(*KEYS, "item").agg(
        series.latest_value(F.col("val"), F.col("end"), F.date_add("period_end", 5), F.max(tol)).alias("val"))
    return out.where("val is not null")


# ------------------------------------------------------------------ snapshots and features
_SNAP = [f"{s}_{i}" for s in "vp" for i in dims.FLOW_ITEMS + dims.STOCK_ITEMS]


@query("snapshot_at_annual_filings", f"SELECT cik, as_of, period_end, {", ".join(_SNAP)} FROM snap_ak")
def snapshot_many(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    snap = snapshot(views.facts(spark, sf), asofs)
    return snap.select("cik", "as_of", "period_end", *_SNAP)


_PLAIN = [f for f in ratios.FEATURES if f != "filing_lag_days"] + ratios.FORENSIC


@query("statement_ratios", "SELECT cik, as_of, period_end, " + sql_rounded(
    ["net_margin", "roa", "ebit_assets", "gross_margin", "current_ratio", "liabilities_assets"]) + " FROM ratios_one")
def statement_ratios(spark, sf):
    """The smallest end-to-end slice: facts at one date -> snapshot -> profitability and solvency ratios."""
    snap = snapshot(views.facts(spark, sf), one_date(spark, sf))
    cols = {**ratios.profitability(), **ratios.solvency()}
    keep = ["net_margin", "roa", "ebit_assets", "gross_margin", "current_ratio", "liabilities_assets"]
    return rounded(snap.select("cik", "as_of", "period_end", *[cols[c].alias(c) for c in keep]), keep)


@query("financial_features", f"SELECT cik, as_of, period_end, {sql_rounded(_PLAIN)} FROM ratios_one")
def financial_features(spark, sf):
    snap = ratios.without_filing(snapshot(views.facts(spark, sf), one_date(spark, sf)))
    return rounded(ratios.compute_features(snap).select("cik", "as_of", "period_end", *_PLAIN), _PLAIN)


@query("bank_features", f"""SELECT r.cik, as_of, {sql_rounded(ratios.BANK_FEATURES)} FROM ratios_one r
JOIN companies_s c USING (cik) WHERE c.bank""")
def bank_features(spark, sf):
    banks = views.companies(spark, sf).where("bank").select("cik")
    asofs = one_date(spark, sf).join(banks, "cik", "left_semi")
    facts = views.facts(spark, sf).join(banks, "cik", "left_semi")
    snap = ratios.bank_features(snapshot(facts, asofs))
    return rounded(snap.select("cik", "as_of", *ratios.BANK_FEATURES), ratios.BANK_FEATURES)


# ------------------------------------------------------------------ events and labels
@query("canonical_events", "SELECT * FROM events_p")
def canonical(spark, sf):
    return views.events(spark, sf)


_EV_SUM = ", ".join(f"round(coalesce(sum(CASE WHEN e.event = '{k}' THEN exp(-date_diff('day', e.filed, a.as_of) / 180.0::DOUBLE) END), 0), 6)"
                    f" AS {v}" for k, v in dims.EVENT_FEATURES.items())
view("evfeat_ak", f"""SELECT a.cik, a.as_of, {_EV_SUM} FROM asofs_ak a LEFT JOIN events_p e ON e.cik = a.cik
  AND e.filed <= a.as_of AND e.filed >= a.as_of - 365 GROUP BY a.cik, a.as_of""")


@query("event_features", "SELECT * FROM evfeat_ak")
def event_features(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    return rounded(ev.event_features(asofs, views.events(spark, sf)), list(dims.EVENT_FEATURES.values()))


@query("events_in_window", """
SELECT a.cik, a.as_of, e.event, e.filed, count(*) AS n, date_diff('day', e.filed, a.as_of) AS age
FROM asofs_ak a JOIN events_p e ON e.cik = a.cik AND e.filed BETWEEN a.as_of - 365 AND a.as_of
GROUP BY a.cik, a.as_of, e.event, e.filed""")
def events_window(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    return (ev.events_in_window(asofs, views.events(spark, sf))
            .select("cik", "as_of", "event", "filed", "n", F.col("age").cast("bigint").alias("age")))


def _label_sql(event):
    return (f"SELECT a.cik, a.as_of, CAST(count(e.filed) > 0 AS INT) AS label, min(e.filed) AS label_date FROM asofs_ak a "
            f"LEFT JOIN events_p e ON e.cik = a.cik AND e.event = '{event}' AND e.filed > a.as_of AND e.filed <= a.as_of + 365 "
            f"GROUP BY a.cik, a.as_of")


view("label_ak", _label_sql("BANKRUPTCY"))
view("restated_ak", _label_sql("RESTATEMENT"))


@query("bankruptcy_labels", "SELECT * FROM label_ak")
def bankruptcy_labels(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    return ev.first_event_between(asofs, views.events(spark, sf), "BANKRUPTCY", 365)


@query("restatement_labels", "SELECT cik, as_of, label AS restated FROM restated_ak")
def restatement_labels(spark, sf):
    asofs = annual_filings(spark, sf).select("cik", F.col("filed").alias("as_of"))
    out = ev.first_event_between(asofs, views.events(spark, sf), "RESTATEMENT", 365, "restated")
    return out.select("cik", "as_of", "restated")


view("eligible_ak", """SELECT * FROM annual_p a WHERE NOT EXISTS (SELECT 1 FROM events_p e WHERE e.cik = a.cik
  AND e.event = 'BANKRUPTCY' AND e.filed <= a.filed AND e.filed > a.filed - 730)""")


@query("filings_without_prior_bankruptcy", "SELECT cik, accn, filed AS as_of FROM eligible_ak")
def without_prior(spark, sf):
    asofs = annual_filings(spark, sf).withColumnRenamed("filed", "as_of")
    return ev.exclude_prior(asofs, views.events(spark, sf), "BANKRUPTCY", 730).select("cik", "accn", "as_of")


@query("companies_with_sector", "SELECT cik, name, sic, sector, bank, financial FROM companies_s")
def companies_with_sector(spark, sf):
    return views.companies(spark, sf).select("cik", "name", "sic", "sector", "bank", "financial")


@query("periodic_filers", """SELECT cik, name FROM companies_p
WHERE cik IN (SELECT cik FROM filings_p WHERE regexp_matches(form, '^10-[KQ]'))""")
def periodic_filers(spark, sf):
    return ev.periodic_filers(views.companies(spark, sf), views.filings(spark, sf)).select("cik", "name")


# ------------------------------------------------------------------ the flagship
STORED = ratios.FEATURES + list(dims.EVENT_FEATURES.values()) + ratios.FORENSIC


def distress_dataset(facts, filings, events, companies, first=FIRST, last=LAST):
    """One row per annual filing of a non-financial company: features, event counts and label as known when filed."""
    universe = (companies.where(dims.sic_number("sic").isNotNull() & ~dims.is_financial("sic"))
                .select("cik", "name", "sic"))
    annual = (filings.where(F.col("form").isin(ANNUAL_FORMS) & F.col("filed").between(first, last))
              .select("cik", "accn", "filed", "report_date").withColumn("as_of", F.col("filed"))
              .join(universe, "cik"))
    asofs = annual.select("cik", "as_of").distinct()
    context = ev.event_summary(asofs, events).where(~F.col("had_prior")).drop("had_prior")
    snap = snapshot(facts, asofs, max_age=MAX_AGE)
    wide = annual.join(context, ["cik", "as_of"]).join(snap, ["cik", "as_of"])
    out = ratios.compute_features(wide).withColumns(
        {"sector": dims.sector_for_sic("sic"), "year": F.year("as_of")})
    return out.select("cik", "accn", "as_of", "period_end", "label", "label_date",
                      *[finite(c).alias(c) for c in STORED], "name", "sic", "sector", "year")


def run_distress(spark, sf):
    return distress_dataset(views.facts(spark, sf), views.filings(spark, sf), views.events(spark, sf),
                            views.companies(spark, sf))


_R = [c for c in ratios.FEATURES + ratios.FORENSIC if c != "filing_lag_days"]
view("distress_p", f"""
SELECT e.cik, e.accn, e.filed AS as_of, r.period_end, l.label, l.label_date, {sql_rounded(_R, prefix='r.')},
  CAST(date_diff('day', e.report_date, e.filed) AS DOUBLE) AS filing_lag_days,
  {', '.join('v.' + c for c in dims.EVENT_FEATURES.values())}, c.name, c.sic, c.sector, year(e.filed) AS year
FROM eligible_ak e JOIN companies_s c ON c.cik = e.cik AND NOT c.financial
JOIN ratios_ak r ON r.cik = e.cik AND r.as_of = e.filed AND date_diff('day', r.period_end, e.filed) <= {MAX_AGE}
JOIN evfeat_ak v ON v.cik = e.cik AND v.as_of = e.filed JOIN label_ak l ON l.cik = e.cik AND l.as_of = e.filed""")


@query("distress_dataset", "SELECT * FROM distress_p")
def distress(spark, sf):
    return rounded(run_distress(spark, sf), STORED)
