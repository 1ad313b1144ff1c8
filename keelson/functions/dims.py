"""Mapping dimensions. The tables below are fixed values: results only agree when they are exactly these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: financial-statement items and their ranked tags (first tag = best rank) -----------------
DURATION_TAGS = {
    "Revenue": ["us-gaap:Revenues", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax",
                "us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax", "us-gaap:SalesRevenueNet",
                "us-gaap:SalesRevenueGoodsNet", "us-gaap:SalesRevenueServicesNet",
                "us-gaap:RevenuesNetOfInterestExpense"],
    "CostOfRevenue": ["us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold", "us-gaap:CostOfGoodsSold",
                      "us-gaap:CostOfServices"],
    "GrossProfit": ["us-gaap:GrossProfit"],
    "OperatingIncome": ["us-gaap:OperatingIncomeLoss"],
    "NetIncome": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss",
                  "us-gaap:NetIncomeLossAvailableToCommonStockholdersBasic"],
    "InterestExpense": ["us-gaap:InterestExpense", "us-gaap:InterestExpenseNonoperating",
                        "us-gaap:InterestExpenseDebt"],
    "SGA": ["us-gaap:SellingGeneralAndAdministrativeExpense"],
    "Depreciation": ["us-gaap:DepreciationDepletionAndAmortization", "us-gaap:DepreciationAndAmortization",
                     "us-gaap:Depreciation", "us-gaap:DepreciationAmortizationAndAccretionNet"],
    "OperatingCashFlow": ["us-gaap:NetCashProvidedByUsedInOperatingActivities",
                          "us-gaap:NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "CapEx": ["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap:PaymentsToAcquireProductiveAssets"],
}
INSTANT_TAGS = {
    "TotalAssets": ["us-gaap:Assets"],
    "CurrentAssets": ["us-gaap:AssetsCurrent"],
    "CurrentLiabilities": ["us-gaap:LiabilitiesCurrent"],
    "TotalLiabilities": ["us-gaap:Liabilities"],
    "StockholdersEquity": ["us-gaap:StockholdersEquity",
                           "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "LiabilitiesAndEquity": ["us-gaap:LiabilitiesAndStockholdersEquity"],
    "RetainedEarnings": ["us-gaap:RetainedEarningsAccumulatedDeficit"],
    "Cash": ["us-gaap:CashAndCashEquivalentsAtCarryingValue",
             "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "us-gaap:Cash"],
    "LongTermDebt": ["us-gaap:LongTermDebtNoncurrent", "us-gaap:LongTermDebt",
                     "us-gaap:LongTermDebtAndCapitalLeaseObligations"],
    "Inventory": ["us-gaap:InventoryNet"],
    "Receivables": ["us-gaap:AccountsReceivableNetCurrent"],
    "PPE": ["us-gaap:PropertyPlantAndEquipmentNet"],
    "SharesOutstanding": ["dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding"],
    "PublicFloat": ["dei:EntityPublicFloat"],
    "Deposits": ["us-gaap:Deposits"],
    "Loans": ["us-gaap:LoansAndLeasesReceivableNetReportedAmount",
              "us-gaap:FinancingReceivableExcludingAccruedInterestAfterAllowanceForCreditLoss",
              "us-gaap:LoansAndLeasesReceivableNetOfDeferredIncome"],
    "HtmAmortizedCost": ["us-gaap:HeldToMaturitySecurities",
                         "us-gaap:DebtSecuritiesHeldToMaturityAmortizedCostAfterAllowanceForCreditLoss",
                         "us-gaap:HeldToMaturitySecuritiesAmortizedCostAfterAllowanceForCreditLoss"],
    "HtmFairValue": ["us-gaap:HeldToMaturitySecuritiesFairValue", "us-gaap:DebtSecuritiesHeldToMaturityFairValue"],
    "AfsAmortizedCost": ["us-gaap:AvailableForSaleDebtSecuritiesAmortizedCostBasis",
                         "us-gaap:AvailableForSaleSecuritiesAmortizedCost",
                         "us-gaap:AvailableForSaleSecuritiesDebtSecuritiesAmortizedCost"],
    "AfsFairValue": ["us-gaap:AvailableForSaleSecuritiesDebtSecurities", "us-gaap:AvailableForSaleSecurities"],
}
SHARE_ITEMS = ["SharesOutstanding"]     # reported in shares; every other item in USD
FLOW_ITEMS = list(DURATION_TAGS)
STOCK_ITEMS = list(INSTANT_TAGS)

# ---- fixed values: 8-K item codes -> event (label, penalty, severity, cap) ----------------------------------
ITEM_EVENTS = [
    ("1.01", "MATERIAL_AGREEMENT", "Entry into a material definitive agreement", 0.0, "LOW", None),
    ("1.02", "AGREEMENT_TERMINATED", "Termination of a material definitive agreement", 5.0, "LOW", None),
    ("1.03", "BANKRUPTCY", "Bankruptcy or receivership", 100.0, "CRITICAL", 10.0),
    ("1.05", "CYBER_INCIDENT", "Material cybersecurity incident", 15.0, "MEDIUM", None),
    ("2.01", "M_AND_A", "Completion of acquisition or disposition of assets", 0.0, "LOW", None),
    ("2.04", "DEBT_ACCELERATION", "Triggering events that accelerate a financial obligation", 30.0, "HIGH", None),
    ("2.05", "RESTRUCTURING", "Costs associated with exit or disposal activities", 15.0, "MEDIUM", None),
    ("2.06", "IMPAIRMENT", "Material impairments", 15.0, "MEDIUM", None),
    ("3.01", "DELISTING_NOTICE", "Notice of delisting or failure to satisfy a listing rule", 35.0, "HIGH", None),
    ("4.01", "AUDITOR_CHANGE", "Changes in registrant's certifying accountant", 15.0, "MEDIUM", None),
    ("4.02", "RESTATEMENT", "Non-reliance on previously issued financial statements", 40.0, "HIGH", None),
    ("5.01", "CONTROL_CHANGE", "Changes in control of registrant", 0.0, "LOW", None),
    ("5.02", "EXEC_DEPARTURE", "Departure/appointment of directors or certain officers", 5.0, "LOW", None),
]
FORM_EVENTS = [
    ("NT 10-K", "LATE_FILING", "Notification of late filing (annual report)", 20.0, "HIGH", None),
    ("NT 10-Q", "LATE_FILING", "Notification of late filing (quarterly report)", 10.0, "MEDIUM", None),
    ("25-NSE", "SECURITY_REMOVED", "Exchange removal of a listed security (equity or debt)", 0.0, "LOW", None),
    ("15-12B", "DEREGISTRATION", "Termination of registration", 0.0, "LOW", None),
    ("15-12G", "DEREGISTRATION", "Termination of registration", 0.0, "LOW", None),
]
EVENT_FEATURES = {
    "RESTATEMENT": "ev_restatement", "AUDITOR_CHANGE": "ev_auditor_change", "EXEC_DEPARTURE": "ev_exec_departure",
    "RESTRUCTURING": "ev_restructuring", "IMPAIRMENT": "ev_impairment", "DELISTING_NOTICE": "ev_delisting_notice",
    "DEBT_ACCELERATION": "ev_debt_acceleration", "LATE_FILING": "ev_late_filing",
    "CYBER_INCIDENT": "ev_cyber_incident",
}

# ---- fixed values: ordered SIC ranges -> sector (first match wins) ------------------------------------------
SIC_RANGES = [
    (2830, 2836, "Health Care"), (3840, 3851, "Health Care"), (8000, 8099, "Health Care"), (5122, 5122, "Health Care"),
    (3570, 3579, "Information Technology"), (3600, 3699, "Information Technology"),
    (3820, 3829, "Information Technology"), (7370, 7379, "Information Technology"),
    (3710, 3716, "Consumer Discretionary"),
    (4800, 4899, "Communication Services"), (2710, 2799, "Communication Services"),
    (7810, 7819, "Communication Services"),
    (4900, 4999, "Utilities"), (6500, 6553, "Real Estate"), (6798, 6798, "Real Estate"),
    (6000, 6399, "Financials"), (6400, 6799, "Financials"),
    (1300, 1399, "Energy"), (2900, 2999, "Energy"), (4610, 4619, "Energy"),
    (2840, 2844, "Consumer Staples"), (100, 999, "Consumer Staples"), (2000, 2199, "Consumer Staples"),
    (5400, 5499, "Consumer Staples"), (5900, 5912, "Consumer Staples"),
    (1000, 1299, "Materials"), (1400, 1499, "Materials"), (2600, 2699, "Materials"), (2800, 2899, "Materials"),
    (3200, 3399, "Materials"),
    (1500, 1799, "Industrials"), (3400, 3569, "Industrials"), (3580, 3599, "Industrials"), (3700, 3799, "Industrials"),
    (4000, 4799, "Industrials"), (8700, 8748, "Industrials"), (7300, 7369, "Industrials"), (7380, 7389, "Industrials"),
    (2200, 2599, "Consumer Discretionary"), (3000, 3199, "Consumer Discretionary"),
    (3630, 3659, "Consumer Discretionary"), (3900, 3999, "Consumer Discretionary"),
    (5000, 5199, "Industrials"), (5200, 5999, "Consumer Discretionary"), (7000, 7299, "Consumer Discretionary"),
    (7800, 7999, "Consumer Discretionary"), (8200, 8299, "Consumer Discretionary"),
]
DEFAULT_SECTOR = "Other"

# ---- fixed values: sector -> benchmark series ---------------------------------------------------------------
SECTOR_ETF = {
    "Information Technology": "XLK", "Financials": "XLF", "Health Care": "XLV", "Energy": "XLE", "Industrials": "XLI",
    "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Utilities": "XLU", "Materials": "XLB",
    "Real Estate": "XLRE", "Communication Services": "XLC",
}
BENCHMARK = "SPY"

# ---- fixed values: plan limits ------------------------------------------------------------------------------
# plan, max watchlists, max items, max compare, history days (-1 = all), analyses/day, export to PDF, API calls/day
PLANS = [("FREE", 1, 5, 2, 365, 5, False, 0), ("PRO", 10, 50, 4, -1, 100, True, 1000),
         ("ENTERPRISE", 100, 500, 8, -1, 2000, True, 50000)]


def sic_number(sic: str) -> Column:
    """Integer code, NULL for anything that is not a whole number."""
    return F.expr(f"try_cast({sic} AS INT)")


def sector_for_sic(sic: str) -> Column:
    """First matching range wins, as an ordered CASE; no match or no number gives the default."""
    cases = " ".join(f"WHEN try_cast({sic} AS INT) BETWEEN {lo} AND {hi} THEN '{s}'" for lo, hi, s in SIC_RANGES)
    return F.expr(f"CASE {cases} ELSE '{DEFAULT_SECTOR}' END")


def is_bank(sic: str) -> Column:
    return F.expr(f"coalesce(try_cast({sic} AS INT) BETWEEN 6000 AND 6399, false)")


def is_financial(sic: str) -> Column:
    return F.expr(f"coalesce(try_cast({sic} AS INT) BETWEEN 6000 AND 6999, false)")


EVENT_SPEC = "key string, event string, label string, penalty double, severity string, cap double"


def item_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEM_EVENTS, EVENT_SPEC)


def form_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORM_EVENTS, EVENT_SPEC)


def tag_map(spark: SparkSession) -> DataFrame:
    """(taxonomy, tag, unit, item, rank): the ranked tags of every canonical item."""
    rows = [(*tag.split(":"), "shares" if item in SHARE_ITEMS else "USD", item, rank)
            for item, tags in {**DURATION_TAGS, **INSTANT_TAGS}.items() for rank, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "taxonomy string, tag string, unit string, item string, rank tinyint")


def plan_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLANS, "plan string, max_watchlists int, max_items int, max_compare int, history_days int, "
               "analyses_per_day int, pdf_export boolean, api_calls_per_day int")


def map_literal(mapping: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def sector_benchmark(sector: Column | str) -> Column:
    c = F.col(sector) if isinstance(sector, str) else sector
    return F.coalesce(F.try_element_at(map_literal(SECTOR_ETF), c), F.lit(BENCHMARK))
