"""Feature formulas over a snapshot's v_<Item> (now) and p_<Item> (a year earlier). Missing inputs give NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import safe_div
from keelson.operators.snapshot import negative_cash_quarters, revenue_slope

FEATURES = ["log_assets", "net_margin", "roa", "ebit_assets", "gross_margin", "current_ratio", "cash_assets",
            "debt_equity", "liabilities_assets", "interest_coverage", "negative_equity", "ocf_liabilities", "fcf_margin",
            "neg_fcf_quarters", "revenue_yoy", "d_net_margin", "d_current_ratio", "revenue_slope_8q", "wc_ta", "re_ta",
            "be_tl", "altman_z2", "ohlson_o", "piotroski_f", "beneish_m", "float_liabilities", "filing_lag_days"]
FORENSIC = ["bn_dsri", "bn_gmi", "bn_aqi", "bn_sgi", "bn_depi", "bn_sgai", "bn_lvgi", "bn_tata"]
BANK_FEATURES = ["equity_assets", "securities_loss_equity", "deposit_growth", "loans_deposits", "bank_roa"]


def v(item: str) -> Column:
    return F.col(f"v_{item}")


def p(item: str) -> Column:
    return F.col(f"p_{item}")


def profitability() -> dict[str, Column]:
    return {"net_margin": safe_div(v("NetIncome"), v("Revenue")), "roa": safe_div(v("NetIncome"), v("TotalAssets")),
            "ebit_assets": safe_div(v("OperatingIncome"), v("TotalAssets")),
            "gross_margin": safe_div(v("GrossProfit"), v("Revenue")),
            "log_assets": F.when(v("TotalAssets") > 0, F.log10(v("TotalAssets")))}


def solvency() -> dict[str, Column]:
    equity, interest = v("StockholdersEquity"), v("InterestExpense")
    return {"current_ratio": safe_div(v("CurrentAssets"), v("CurrentLiabilities")),
            "cash_assets": safe_div(v("Cash"), v("TotalAssets")),
            "debt_equity": F.when(equity > 0, safe_div(v("LongTermDebt"), equity)),
            "liabilities_assets": safe_div(v("TotalLiabilities"), v("TotalAssets")),
            "interest_coverage": F.when(F.abs(interest) > 0, safe_div(v("OperatingIncome"), F.abs(interest))),
            "negative_equity": (equity < 0).cast("double")}


def cash_flow() -> dict[str, Column]:
    free = v("OperatingCashFlow") - F.coalesce(v("CapEx"), F.lit(0.0))
    return {"ocf_liabilities": safe_div(v("OperatingCashFlow"), v("TotalLiabilities")),
            "fcf_margin": safe_div(free, v("Revenue")), "neg_fcf_quarters": negative_cash_quarters()}


def growth() -> dict[str, Column]:
    return {"revenue_yoy": F.when(p("Revenue") > 0, safe_div(v("Revenue"), p("Revenue")) - 1),
            "d_net_margin": safe_div(v("NetIncome"), v("Revenue")) - safe_div(p("NetIncome"), p("Revenue")),
            "d_current_ratio": safe_div(v("CurrentAssets"), v("CurrentLiabilities"))
            - safe_div(p("CurrentAssets"), p("CurrentLiabilities")),
            "revenue_slope_8q": revenue_slope()}


def altman() -> dict[str, Column]:
    wc = safe_div(v("CurrentAssets") - v("CurrentLiabilities"), v("TotalAssets"))
    re = safe_div(v("RetainedEarnings"), v("TotalAssets"))
    be = safe_div(v("StockholdersEquity"), v("TotalLiabilities"))
    ebit = safe_div(v("OperatingIncome"), v("TotalAssets"))
    return {"wc_ta": wc, "re_ta": re, "be_tl": be, "altman_z2": 6.56 * wc + 3.26 * re + 6.72 * ebit + 1.05 * be}


def ohlson() -> dict[str, Column]:
    ta, tl, ni, ni_p = v("TotalAssets"), v("TotalLiabilities"), v("NetIncome"), p("NetIncome")
    size = F.ln(ta / 1e6)
    swing = F.abs(ni) + F.abs(ni_p)
    loss_both = F.coalesce((ni < 0) & (ni_p < 0), F.lit(False)).cast("double")
    change = F.coalesce(F.when(swing > 0, (ni - ni_p) / swing), F.lit(0.0))
    score = (-1.32 - 0.407 * size + 6.03 * safe_div(tl, ta)
             - 1.43 * safe_div(v("CurrentAssets") - v("CurrentLiabilities"), ta)
             + 0.0757 * safe_div(v("CurrentLiabilities"), v("CurrentAssets")) - 1.72 * (tl > ta).cast("double")
             - 2.37 * safe_div(ni, ta) - 1.83 * F.coalesce(safe_div(v("OperatingCashFlow"), tl), F.lit(0.0))
             + 0.285 * loss_both - 0.521 * change)
    return {"ohlson_o": F.when(ta > 0, score)}


def piotroski() -> dict[str, Column]:
    """Nine yes/no signals. A comparison with a missing side scores 0, except the dilution test, which then scores 1."""
    roa, roa_p = safe_div(v("NetIncome"), v("TotalAssets")), safe_div(p("NetIncome"), p("TotalAssets"))

    def up(a, b):
        return safe_div(v(a), v(b)) > safe_div(p(a), p(b))

    diluted = F.coalesce(v("SharesOutstanding") > p("SharesOutstanding") * 1.02, F.lit(False))
    signals = [roa > 0, v("OperatingCashFlow") > 0, roa > roa_p, v("OperatingCashFlow") > v("NetIncome"),
               safe_div(v("LongTermDebt"), v("TotalAssets")) < safe_div(p("LongTermDebt"), p("TotalAssets")),
               up("CurrentAssets", "CurrentLiabilities"), ~diluted, up("GrossProfit", "Revenue"),
               up("Revenue", "TotalAssets")]
    total = sum((F.coalesce(s, F.lit(False)).cast("double") for s in signals), F.lit(0.0))
    return {"piotroski_f": F.when(roa.isNotNull(), total)}


def beneish() -> dict[str, Column]:
    def quality(side):
        return 1 - safe_div(side("CurrentAssets") + side("PPE"), side("TotalAssets"))

    def wear(side):
        return safe_div(side("Depreciation"), side("Depreciation") + side("PPE"))

    def ratio(a, b, num=v, den=p):
        return safe_div(safe_div(num(a), num(b)), safe_div(den(a), den(b)))

    i = {"bn_dsri": ratio("Receivables", "Revenue"), "bn_gmi": ratio("GrossProfit", "Revenue", p, v),
         "bn_aqi": safe_div(quality(v), quality(p)), "bn_sgi": safe_div(v("Revenue"), p("Revenue")),
         "bn_depi": safe_div(wear(p), wear(v)), "bn_sgai": ratio("SGA", "Revenue"),
         "bn_lvgi": ratio("TotalLiabilities", "TotalAssets"),
         "bn_tata": safe_div(v("NetIncome") - v("OperatingCashFlow"), v("TotalAssets"))}
    i["beneish_m"] = beneish_score(i)
    return i


def beneish_score(i: dict[str, Column]) -> Column:
    return (-4.84 + 0.920 * i["bn_dsri"] + 0.528 * i["bn_gmi"] + 0.404 * i["bn_aqi"] + 0.892 * i["bn_sgi"]
            + 0.115 * i["bn_depi"] - 0.172 * i["bn_sgai"] + 4.679 * i["bn_tata"] - 0.327 * i["bn_lvgi"])


def filing_features() -> dict[str, Column]:
    """Needs report_date and filed of the latest periodic filing."""
    return {"float_liabilities": safe_div(v("PublicFloat"), v("TotalLiabilities")),
            "filing_lag_days": F.datediff("filed", "report_date").cast("double")}


def bank() -> dict[str, Column]:
    def loss(cost, fair):
        gap = v(cost) - v(fair)
        return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))

    htm, afs = loss("HtmAmortizedCost", "HtmFairValue"), loss("AfsAmortizedCost", "AfsFairValue")
    losses = F.when(htm.isNotNull() | afs.isNotNull(), F.coalesce(htm, F.lit(0.0)) + F.coalesce(afs, F.lit(0.0)))
    return {"equity_assets": safe_div(v("StockholdersEquity"), v("TotalAssets")),
            "securities_loss_equity": safe_div(losses, v("StockholdersEquity")),
            "deposit_growth": safe_div(v("Deposits"), p("Deposits")) - 1,
            "loans_deposits": safe_div(v("Loans"), v("Deposits")),
            "bank_roa": safe_div(v("NetIncome"), v("TotalAssets"))}


def compute_features(snap: DataFrame) -> DataFrame:
    """All features of a snapshot that carries report_date and filed (NULL where no filing is attached)."""
    cols = {**profitability(), **solvency(), **cash_flow(), **growth(), **altman(), **ohlson(), **piotroski(),
            **beneish(), **filing_features()}
    return snap.withColumns(cols)


def bank_features(snap: DataFrame) -> DataFrame:
    return snap.withColumns(bank())


def without_filing(snap: DataFrame) -> DataFrame:
    """Snapshot with no filing attached (peer tables): the filing lag stays NULL."""
    none = F.lit(None).cast("date")
    return snap.withColumns({"report_date": none, "filed": none})
