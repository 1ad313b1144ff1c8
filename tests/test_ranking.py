"""Order statistics against NumPy, with a hot key and heavy ties."""

import numpy as np
from pyspark.sql import functions as F

from keelson.operators import drift, evaluate, ranking


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v double")


def test_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.concatenate([np.zeros(3000), rng.normal(0, 1e6, 500), rng.uniform(-1e-9, 1e-9, 500)]), "small": np.array([3.0, 1.0, 2.0]), "one": np.array([5.0])}
    df = frame(spark, [(k, float(x)) for k, v in data.items() for x in v])
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for r in ranking.quantiles(df, ["k"], "v", probs).collect():
        assert r["n"] == len(data[r["k"]]) and np.allclose(r["quantiles"], np.quantile(data[r["k"]], probs))


def test_bucket_numbers_never_reverse_the_order(spark):
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, np.nextafter(1.0, 2), 255.999, 256.0, -7.5, 1e12, -1e12])
    got = [r["b"] for r in spark.createDataFrame([(float(x),) for x in xs], "v double").select("v", ranking.bucket_of(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def test_rank_metrics_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    m = evaluate.rank_metrics(df, [], "s", "y").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = sum((y[s >= t].mean()) * ((y == 1) & (s == t)).sum() for t in set(s)) / (y == 1).sum()
    assert np.isclose(m["roc_auc"], auc) and np.isclose(m["pr_auc"], ap)


def test_top_k_cuts_inside_a_tie_by_id(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 6 else 0.5) for i in range(10)], "id bigint, s double")
    got = evaluate.top_k(df, [], "s", "id", F.lit(4)).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3]


def test_psi_same_and_shifted(spark):
    rng = np.random.default_rng(3)
    mk = lambda loc: spark.createDataFrame([("f", float(x)) for x in rng.normal(loc, 1, 5000)], "feature string, v double")
    ref = drift.reference_histogram(mk(0), ["feature"])
    assert drift.psi(ref, mk(0), ["feature"]).first()["psi"] < 0.02
    assert drift.psi(ref, mk(1.5), ["feature"]).first()["psi"] > 0.2


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(y), float(y * 0.4 + rng.uniform())) for i, y in enumerate(rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "id bigint, y int, s double")
    ci, m = evaluate.bootstrap_interval(df, [], "s", "y", "id", replicas=60).first(), evaluate.rank_metrics(df, [], "s", "y").first()
    assert ci["low"] < m["roc_auc"] < ci["high"] and ci["high"] - ci["low"] < 0.2


def test_a_narrow_range_of_values_is_spread(spark):
    n = 1_000_000
    df = spark.range(n).select((F.lit(1e6) + (F.col("id") * 7919) % n / 1000).alias("v"))
    ranked = ranking.prefix_sums(ranking.fold(df, [], "v"), [], "v", ["n"])
    wrong = ranked.where((F.col("n_before") != F.round((F.col("v") - 1e6) * 1000)) | (F.col("n_total") != n)).count()
    biggest = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert ranked.count() == n and wrong == 0 and biggest < n / 2


def test_infinities_and_nan_take_their_place(spark):
    inf, nan = float("inf"), float("nan")
    df = frame(spark, [("a", x) for x in (nan, inf, -inf, 0.0, -0.0, 2.0, nan)])
    rows = ranking.prefix_sums(ranking.fold(df, ["k"], "v"), ["k"], "v", ["n"]).orderBy("n_before").collect()
    assert [(str(r["v"]), r["n"], r["n_before"]) for r in rows] == [("-inf", 1, 0), ("0.0", 2, 1), ("2.0", 1, 3), ("inf", 1, 4), ("nan", 2, 5)]


def test_top_k_tells_large_ids_apart(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big + i, 1.0) for i in range(6)], "id bigint, s double")
    assert sorted(r["id"] - big for r in evaluate.top_k(df, [], "s", "id", F.lit(3)).collect()) == [0, 1, 2]
