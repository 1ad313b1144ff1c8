"""Proxy views over the driver tables, in Spark and (next to it) as oracle text.

Every view is a pure function of the driver tables. Plain views are one SQL text both engines read; where the idiomatic
Spark form differs (exploding fact variants) the two are written out separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import dims
from keelson.plans.oracle import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def run_shared(spark: SparkSession, sf: str, sql: str, *tables: str, **extra: DataFrame) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf, t) for t in tables}, **extra)


def _shared(name: str, sql: str, tables: list[str]):
    """Register the oracle view and return the same text with Spark placeholders."""
    view(name, sql)
    text = sql
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        text = text.replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    return text


# ------------------------------------------------------------------ companies
COMPANIES = _shared("companies_p", """
SELECT s.s_suppkey + 1 AS cik, s.s_name AS name, CAST(100 + (s.s_suppkey * 137) % 8000 AS INT) AS sic,
       n.n_name AS nation, r.r_name AS region
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""", ["supplier", "nation", "region"])


def companies(spark, sf) -> DataFrame:
    df = run_shared(spark, sf, COMPANIES, "supplier", "nation", "region")
    return df.withColumns({"sector": dims.sector_for_sic("sic"), "bank": dims.is_bank("sic"),
                           "financial": dims.is_financial("sic")})


view("companies_s", "SELECT *, CASE "
     + " ".join(f"WHEN sic BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in dims.SIC_RANGES)
     + " ELSE 'Other' END AS sector, sic BETWEEN 6000 AND 6399 AS bank, sic BETWEEN 6000 AND 6999 AS financial "
       "FROM companies_p")

# ------------------------------------------------------------------ facts
# One row per company-quarter with revenue in cents (r) and a small pseudo-random k; items are integer multiples of r,
# so both engines hold exactly the same doubles.
QUARTERS = _shared("quarters_p", """
SELECT q.*, (cik * 7 + (fy * 4 + fq) * 13) % 1000 AS k, 100 + ((cik - 1) * 137) % 8000 BETWEEN 6000 AND 6399 AS bank,
       make_date(fy, fq * 3 - 2, 1) AS q_start, make_date(fy, 1, 1) AS y_start,
       make_date(fy, fq * 3, CASE fq WHEN 1 THEN 31 WHEN 2 THEN 30 WHEN 3 THEN 30 ELSE 31 END) AS q_end
FROM (SELECT l.l_suppkey + 1 AS cik, CAST(year(o.o_orderdate) AS INT) AS fy, CAST(quarter(o.o_orderdate) AS INT) AS fq,
             CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS r
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
      GROUP BY l.l_suppkey + 1, CAST(year(o.o_orderdate) AS INT), CAST(quarter(o.o_orderdate) AS INT)) q
""", ["lineitem", "orders"])

FLOW_X = {
    "Revenue": "r * 100", "CostOfRevenue": "r * (50 + k % 31)",
    "GrossProfit": "CASE WHEN cik % 3 = 0 THEN r * (50 - k % 31) END",
    "OperatingIncome": "r * (k % 23 - 6)", "NetIncome": "r * (k % 19 - 6)", "InterestExpense": "r * (k % 4)",
    "SGA": "r * (10 + k % 6)", "Depreciation": "r * (2 + k % 3)", "OperatingCashFlow": "r * (k % 17 - 5)",
    "CapEx": "CASE WHEN cik % 5 <> 0 THEN r * (k % 7) END",
}
CUMULATIVE_ONLY = ["OperatingCashFlow", "CapEx"]
_TA = "r * (3 + cik % 7)"
STOCK_X = {
    "TotalAssets": f"{_TA} * 100", "CurrentAssets": f"{_TA} * (30 + k % 25)",
    "CurrentLiabilities": f"{_TA} * (20 + k % 37)",
    "TotalLiabilities": f"CASE WHEN cik % 4 <> 1 THEN {_TA} * (45 + k % 60) END",
    "StockholdersEquity": f"{_TA} * (55 - k % 60)", "LiabilitiesAndEquity": f"{_TA} * 100",
    "RetainedEarnings": f"{_TA} * (k % 41 - 12)", "Cash": f"{_TA} * (2 + k % 15)",
    "LongTermDebt": f"{_TA} * (k % 33)", "Inventory": f"{_TA} * (k % 9)", "Receivables": f"{_TA} * (4 + k % 11)",
    "PPE": f"{_TA} * (15 + k % 21)",
    "SharesOutstanding": "CASE WHEN cik % 9 <> 4 THEN (1000000 + cik * 1000 + (fy * 4 + fq - 7980) * (cik % 5) * 6000)"
                         " * 10000 END",
    "PublicFloat": f"CASE WHEN fq = 2 THEN {_TA} * (20 + k % 90) END",
    "Deposits": f"CASE WHEN bank THEN {_TA} * (50 + k % 25) END", "Loans": f"CASE WHEN bank THEN {_TA} * (30 + k % 40) END",
    "HtmAmortizedCost": f"CASE WHEN bank AND cik % 2 = 0 THEN {_TA} * (10 + k % 12) END",
    "HtmFairValue": f"CASE WHEN bank AND cik % 2 = 0 THEN {_TA} * (8 + k % 13) END",
    "AfsAmortizedCost": f"CASE WHEN bank THEN {_TA} * (5 + k % 10) END",
    "AfsFairValue": f"CASE WHEN bank AND k % 3 <> 0 THEN {_TA} * (4 + k % 11) END",
}
_flow_cols = ", ".join(f"CAST({x} AS BIGINT) AS q_{i}, CAST(sum({x}) OVER (PARTITION BY cik, fy ORDER BY fq) AS BIGINT)"
                       f" AS y_{i}" for i, x in FLOW_X.items())
_stock_cols = ", ".join(f"CAST({x} AS BIGINT) AS s_{i}" for i, x in STOCK_X.items())
WIDE = f"SELECT quarters_p.*, {_flow_cols}, {_stock_cols} FROM quarters_p"
view("quarters_wide", WIDE)
_BASE = "cik, fy, fq, k, q_end AS \"end\""
view("facts_base", " UNION ALL ".join(
    [f"SELECT cik, fy, fq, k, '{i}' AS item, q_start AS start, q_end AS \"end\", q_{i} AS x FROM quarters_wide "
     f"WHERE q_{i} IS NOT NULL AND fq < 4" for i in FLOW_X if i not in CUMULATIVE_ONLY]
    + [f"SELECT cik, fy, fq, k, '{i}' AS item, y_start AS start, q_end AS \"end\", y_{i} AS x FROM quarters_wide "
       f"WHERE y_{i} IS NOT NULL AND (fq > 1 OR {i in CUMULATIVE_ONLY})" for i in FLOW_X]
    + [f"SELECT cik, fy, fq, k, '{i}' AS item, CAST(NULL AS DATE) AS start, q_end AS \"end\", s_{i} AS x "
       f"FROM quarters_wide WHERE s_{i} IS NOT NULL" for i in STOCK_X]))
# variants: as reported; a second-ranked tag; a restatement 200 days later; an unchanged comparative a year later
_ROW = ("cik, item, CAST({rank} AS TINYINT) AS rank, start, \"end\", CAST(x AS DOUBLE) / 1e4{f} AS val, fy, "
        "'Q' || fq AS fp, CASE WHEN fq = 4 THEN '10-K' ELSE '10-Q' END || '{a}' AS form, "
        "\"end\" + CAST(30 + k % 45 + {d} AS INT) AS filed, cik || '-' || (fy * 4 + fq) || '-{v}' AS accn")
view("facts_raw_p", " UNION ALL ".join([
    f"SELECT {_ROW.format(rank=0, f='', a='', d=0, v='o')} FROM facts_base",
    f"SELECT {_ROW.format(rank=1, f=' * 97e-2', a='', d=0, v='o')} FROM facts_base WHERE (cik + fy * 4 + fq) % 3 = 0",
    f"SELECT {_ROW.format(rank=0, f=' * 105e-2', a='/A', d=200, v='r')} FROM facts_base WHERE (cik + fy * 4 + fq) % 5 = 0",
    f"SELECT {_ROW.format(rank=0, f='', a='', d=365, v='c')} FROM facts_base WHERE (cik + fy * 4 + fq) % 2 = 0"]))
view("facts_p", 'SELECT cik, item, rank, start, "end", val, min(filed) AS filed, arg_min(accn, (filed, accn)) AS accn '
                'FROM facts_raw_p GROUP BY cik, item, rank, start, "end", val')


LINES_PER_TASK = 500_000            # of the line items that the quarters are made from


def quarters(spark, sf) -> DataFrame:
    return run_shared(spark, sf, QUARTERS, "lineitem", "orders")


def facts_raw(spark, sf, lines_per_task: int = LINES_PER_TASK) -> DataFrame:
    """As-filed facts: the same (period, value) may be filed more than once.

    Quarters are spread by company before they are multiplied, so no later grouping by company shuffles the facts themselves.
    """
    from keelson.operators.pit import spread, tasks_for
    by_company = spread(quarters(spark, sf), "cik", tasks=-(-tasks_for(table(spark, sf, "lineitem"), lines_per_task) // 2) * 2)
    wide = spark.sql(WIDE.replace("FROM quarters_p", "FROM {q} AS quarters_p"), q=by_company)
    entry = "named_struct('item', '{i}', 'start', {s}, 'x', if({c}, {v}, null))"
    entries = ([entry.format(i=i, s="q_start", v=f"q_{i}", c="fq < 4") for i in FLOW_X if i not in CUMULATIVE_ONLY]
               + [entry.format(i=i, s="y_start", v=f"y_{i}", c="true" if i in CUMULATIVE_ONLY else "fq > 1")
                  for i in FLOW_X]
               + [entry.format(i=i, s="cast(null as date)", v=f"s_{i}", c="true") for i in STOCK_X])
    long = (wide.selectExpr("cik", "fy", "fq", "k", "q_end", f"inline(array({', '.join(entries)}))")
            .where("x is not null"))
    q = "(cik + fy * 4 + fq)"
    variants = ("inline(array("
                "named_struct('rank', 0, 'f', 1e0, 'd', 0, 'v', 'o', 'a', '', 'keep', true),"
                f"named_struct('rank', 1, 'f', 97e-2, 'd', 0, 'v', 'o', 'a', '', 'keep', {q} % 3 = 0),"
                f"named_struct('rank', 0, 'f', 105e-2, 'd', 200, 'v', 'r', 'a', '/A', 'keep', {q} % 5 = 0),"
                f"named_struct('rank', 0, 'f', 1e0, 'd', 365, 'v', 'c', 'a', '', 'keep', {q} % 2 = 0)))")
    return (long.selectExpr("*", variants).where("keep")
            .selectExpr("cik", "item", "cast(rank as tinyint) as rank", "start", "q_end as end",
                        "cast(x as double) / 1e4 * f as val", "fy", "'Q' || fq as fp",
                        "if(fq = 4, '10-K', '10-Q') || a as form",
                        "date_add(q_end, cast(30 + k % 45 + d as int)) as filed",
                        "cik || '-' || (fy * 4 + fq) || '-' || v as accn"))


def facts(spark, sf, with_accn: bool = False) -> DataFrame:
    from keelson.operators.pit import first_filed
    return first_filed(facts_raw(spark, sf), with_accn)


# ------------------------------------------------------------------ filings and events
_CODES = "1.01 1.02 1.03 1.05 2.01 2.04 2.05 2.06 3.01 4.01 4.02 5.01 5.02".split()
_CODES2 = "5.02 2.02 9.01 5.02 7.01 2.05 4.02".split()


def _pick(expr: str, codes: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes)) + " END"


FILINGS = _shared("filings_p", f"""
SELECT cik, accn, filed, CASE WHEN okey % 17 = 0 THEN NULL ELSE
         make_date(year(filed), quarter(filed) * 3 - 2, 1) - 1 END AS report_date,
       form, CASE WHEN form = '8-K' THEN
         (CASE WHEN {_pick('okey % 13', _CODES)} = '1.03' AND cik % 10 <> 1 THEN '9.01'
               ELSE {_pick('okey % 13', _CODES)} END) || ', ' || {_pick('okey % 7', _CODES2)} ELSE '' END AS items,
       'doc' || accn || '.htm' AS primary_document
FROM (SELECT 1 + o_custkey % (SELECT count(*) FROM supplier) AS cik, o_orderkey AS okey,
             CAST(o_orderkey AS STRING) AS accn, CAST(o_orderdate AS DATE) AS filed,
             CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-K' WHEN '3-MEDIUM' THEN '10-Q'
                  WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'NT 10-K' WHEN o_orderkey % 4 = 1
                  THEN 'NT 10-Q' ELSE '8-K' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN '10-K/A' WHEN o_orderkey % 3 = 1
                  THEN '10-KT' ELSE '25-NSE' END END AS form
      FROM orders) f
""", ["supplier", "orders"])


def filings(spark, sf) -> DataFrame:
    return run_shared(spark, sf, FILINGS, "supplier", "orders")


def events(spark, sf) -> DataFrame:
    from keelson.operators.events import canonical_events
    return canonical_events(filings(spark, sf))


def _values(rows) -> str:
    q = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)")
    return ", ".join("(" + ", ".join(q(v.replace("'", "''") if isinstance(v, str) else v) for v in r) + ")" for r in rows)


view("item_events_d", f"SELECT * FROM (VALUES {_values(dims.ITEM_EVENTS)}) AS d(code, event, label, penalty, severity, cap)")
view("form_events_d", f"SELECT * FROM (VALUES {_values(dims.FORM_EVENTS)}) AS d(code, event, label, penalty, severity, cap)")
view("events_p", """
SELECT f.cik, f.filed, f.accn, '8-K Item ' || d.code AS source, d.event, d.label, d.penalty, d.severity, d.cap
FROM (SELECT DISTINCT cik, filed, accn, trim(c) AS code
      FROM (SELECT cik, filed, accn, unnest(string_split(items, ',')) AS c FROM filings_p
            WHERE form LIKE '8-K%' AND items <> '')) f JOIN item_events_d d ON f.code = d.code
UNION ALL
SELECT f.cik, f.filed, f.accn, f.form, d.event, d.label, d.penalty, d.severity, d.cap
FROM filings_p f JOIN form_events_d d ON f.form = d.code""")
