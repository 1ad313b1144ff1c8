"""Peer tables, percentile lookup and company-versus-peers queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import peers, pit, ratios
from keelson.plans import views
from keelson.plans.oracle import view
from keelson.plans.pointintime import DEC, register_asof_views, rounded, sql_rounded
from keelson.plans.registry import query
from keelson.session import materialise, shared

DATES = ["1998-12-31", "2000-06-30"]
ALL_FEATS = [f for f in ratios.FEATURES if f != "filing_lag_days"]


def table_dates(spark):
    return spark.createDataFrame([(d,) for d in DATES], "d string").select(F.to_date("d").alias("as_of"))


view("asofs_grid", " UNION ALL ".join(f"SELECT cik, DATE '{d}' AS as_of FROM companies_p" for d in DATES))
register_asof_views("grid")
_BANK = ", ".join(f"CASE WHEN c.bank THEN r.{f} END AS {f}" for f in ratios.BANK_FEATURES)
view("peers_p", f"""SELECT r.cik, r.as_of, r.period_end, c.sector, c.bank, {', '.join('r.' + f for f in ALL_FEATS)}, {_BANK}
FROM ratios_grid r JOIN companies_s c USING (cik) WHERE date_diff('day', r.period_end, r.as_of) <= 500""")
_LONG = " UNION ALL ".join(f"SELECT cik, as_of, sector, bank, '{f}' AS feature, {f} AS v FROM peers_p"
                           for f in ALL_FEATS + ratios.BANK_FEATURES)
view("peers_long", f"SELECT * FROM ({_LONG}) WHERE v IS NOT NULL")
view("peer_group_long", f"""SELECT as_of, grp AS "group", feature, v FROM (
  SELECT *, 'ALL' AS grp FROM peers_long UNION ALL SELECT *, sector FROM peers_long
  UNION ALL SELECT *, 'BANKS' FROM peers_long WHERE bank)
  WHERE feature NOT IN ({', '.join(f"'{b}'" for b in ratios.BANK_FEATURES)}) OR grp = 'BANKS'""")
_PROBS = "[" + ", ".join(f"{i}/100.0::DOUBLE" for i in range(101)) + "]"
view("peer_tables_p", f"""SELECT as_of, "group", feature, count(*) AS n,
  list_transform(quantile_cont(v, {_PROBS}), lambda x: round_even(x, 6)) AS quantiles
  FROM peer_group_long GROUP BY as_of, "group", feature HAVING count(*) >= 5""")


def dataset(spark, sf):
    return peers.peer_dataset(views.facts(spark, sf), views.companies(spark, sf), table_dates(spark))


def stored_dataset(spark, sf):
    """The peer dataset as a stored table, for the queries that start from it."""
    return shared(spark, f"peers:{sf}", lambda: materialise(dataset(spark, sf)))


def stored_tables(spark, sf):
    return shared(spark, f"peer_tables:{sf}", lambda: materialise(peers.peer_tables(stored_dataset(spark, sf), min_n=5)))


def tables(spark, sf):
    return peers.peer_tables(dataset(spark, sf), min_n=5)


@query("peer_dataset", f"SELECT cik, as_of, period_end, sector, bank, {sql_rounded(ALL_FEATS + ratios.BANK_FEATURES)} FROM peers_p")
def peer_dataset(spark, sf):
    cols = ALL_FEATS + ratios.BANK_FEATURES
    return rounded(dataset(spark, sf).drop("filing_lag_days"), cols)


@query("peer_quantile_tables", """SELECT as_of, "group", feature, n, quantiles[1] AS q0,
  quantiles[26] AS q25, quantiles[51] AS q50, quantiles[92] AS q91, quantiles[101] AS q100 FROM peer_tables_p""")
def peer_quantile_tables(spark, sf):
    q = F.col("quantiles")
    at = lambda i: F.get(q, F.lit(i))
    return tables(spark, sf).select(
        "as_of", "group", "feature", "n", at(0).alias("q0"), at(25).alias("q25"), at(50).alias("q50"), at(91).alias("q91"),
        at(100).alias("q100"))


@query("peer_tables_of_fifteen", """SELECT as_of, "group", feature, n, quantiles[51] AS q50 FROM peer_tables_p WHERE n >= 15""")
def peer_tables_of_fifteen(spark, sf):
    """Tables with the least group size that scoring asks for by default."""
    return peers.peer_tables(stored_dataset(spark, sf)).select("as_of", "group", "feature", "n", F.get("quantiles", F.lit(50)).alias("q50"))


@query("peer_table_choice", f"""SELECT f.accn, f.filed AS as_of, coalesce(max(d) FILTER (d <= f.filed), min(d)) AS table_date,
  max(d) FILTER (d <= f.filed) AS table_date_pit
FROM filings_p f CROSS JOIN (VALUES {', '.join(f"(DATE '{d}')" for d in DATES)}) AS t(d) GROUP BY f.accn, f.filed""")
def peer_table_choice(spark, sf):
    t = table_dates(spark)
    f = views.filings(spark, sf).select("accn", F.col("filed").alias("as_of"))
    return peers.with_table_date(peers.with_table_date(f, "as_of", t), "as_of", t, True, "table_date_pit")


_INV = ("least(1.0::DOUBLE, (len(list_filter({q}, lambda x: x < {v})) + len(list_filter({q}, lambda x: x <= {v}))) / 2.0::DOUBLE / 100)")
view("pct_p", f"""SELECT l.cik, l.as_of, l.feature, l.v AS value,
  CASE WHEN o.n IS NOT NULL THEN l.own_group WHEN a.n IS NOT NULL THEN 'ALL' END AS peer_group,
  coalesce(o.n, a.n, 0) AS peer_n, CASE WHEN coalesce(o.n, a.n) IS NOT NULL THEN {_INV.format(q='coalesce(o.quantiles, a.quantiles)', v='l.v')} END AS pct
FROM (SELECT *, CASE WHEN bank THEN 'BANKS' ELSE sector END AS own_group FROM peers_long) l
LEFT JOIN peer_tables_p o ON o.as_of = l.as_of AND o."group" = l.own_group AND o.feature = l.feature
LEFT JOIN peer_tables_p a ON a.as_of = l.as_of AND a."group" = 'ALL' AND a.feature = l.feature""")


def with_percentiles(spark, sf):
    """Every company feature against its own group's table at the same date, else the market's."""
    from keelson.operators import ranking
    feats = stored_dataset(spark, sf)
    long = ranking.melt(feats, ["cik", "as_of", "sector", "bank"], ALL_FEATS + ratios.BANK_FEATURES, value="value")
    vals = long.select("cik", "as_of", F.col("as_of").alias("table_date"),
                       F.when(F.col("bank"), "BANKS").otherwise(F.col("sector")).alias("own_group"), "feature", "value")
    return peers.percentiles(vals, stored_tables(spark, sf))


@query("peer_percentiles", f"""SELECT cik, as_of, feature, round(value, {DEC}) AS value, peer_group, peer_n,
  round(pct, 4) AS pct FROM pct_p""")
def peer_percentiles(spark, sf):
    p = with_percentiles(spark, sf)
    return p.select("cik", "as_of", "feature", F.round("value", DEC).alias("value"), "peer_group", "peer_n",
                    F.round("pct", 4).alias("pct"))


@query("company_versus_group", f"""SELECT l.cik, l.as_of, l.feature, round(l.v, {DEC}) AS value, t."group", t.n,
  t.quantiles[26] AS p25, t.quantiles[51] AS p50, t.quantiles[76] AS p75
FROM peers_long l JOIN peer_tables_p t ON t.as_of = l.as_of AND t."group" = l.sector AND t.feature = l.feature""")
def company_versus_group(spark, sf):
    from keelson.operators import ranking
    feats = stored_dataset(spark, sf)
    long = ranking.melt(feats, ["cik", "as_of", "sector"], ALL_FEATS + ratios.BANK_FEATURES, value="value")
    t = stored_tables(spark, sf)
    at = lambda i: F.get("quantiles", F.lit(i))
    j = long.withColumnRenamed("sector", "group").join(t, ["as_of", "group", "feature"])
    return j.select("cik", "as_of", "feature", F.round("value", DEC).alias("value"), "group", "n", at(25).alias("p25"),
                    at(50).alias("p50"), at(75).alias("p75"))
