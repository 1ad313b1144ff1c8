"""Isolation forest fitted per seeded subsample, scored with broadcast trees, and the injection benchmarks."""

from __future__ import annotations

import json
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # workers need no copy of this package
SUBSAMPLE = 256
FINANCIAL = ["bn_dsri", "bn_gmi", "bn_aqi", "bn_sgi", "bn_depi", "bn_sgai", "bn_lvgi", "bn_tata", "revenue_yoy", "d_net_margin", "d_current_ratio"]


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng) -> list:
    """Nested [feature, threshold, left, right] or [leaf path length]."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth >= limit or len(x) <= 1 or len(spread) == 0:
        return [depth + _average_path(len(x))]
    f = int(rng.choice(spread))
    t = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < t
    return [f, t, _grow(x[left], depth + 1, limit, rng), _grow(x[~left], depth + 1, limit, rng)]


def fit_forest(train: DataFrame, row_id: str, features: list[str], trees: int = 100, seed: int = 42) -> list[list]:
    """Each tree sees its own seeded subsample, picked by hash so a tree's group holds about SUBSAMPLE rows whatever the data size.
    The model is trees x at most 2 x SUBSAMPLE nodes, a fixed bound."""
    n = max(1, train.count())
    chance = min(1.0, SUBSAMPLE / n)

    def drawn(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(row_id), tree, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)))

    # only the trees that drew a row are written out for it
    pool = train.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)))

    def grow(key, pdf):
        rng = np.random.default_rng(seed + int(key[0]))
        x = pdf[features].to_numpy(dtype=float)
        return pd.DataFrame({"tree": [int(key[0])], "nodes": [json.dumps(_grow(x, 0, math.ceil(math.log2(max(2, len(x)))), rng))],
                             "size": [len(x)]})

    rows = pool.select("tree", *features).groupBy("tree").applyInPandas(grow, "tree int, nodes string, size int").orderBy("tree").collect()
    return [[json.loads(r["nodes"]), r["size"]] for r in rows]


def score_forest(df: DataFrame, features: list[str], forest: list[list], name: str = "raw_score") -> DataFrame:
    """2^(-mean path / average path): higher is more anomalous."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total, norm = np.zeros(len(x)), 0.0
        for nodes, size in shared.value:
            norm += _average_path(size)
            stack = [(nodes, np.arange(len(x)))]
            while stack:
                node, idx = stack.pop()
                if len(idx) == 0:
                    continue
                if len(node) == 1:
                    total[idx] += node[0]
                    continue
                left = x[idx, node[0]] < node[1]
                stack += [(node[2], idx[left]), (node[3], idx[~left])]
        return pd.Series(2.0 ** (-total / max(norm, 1e-9)))

    return df.withColumn(name, score(*[F.col(f) for f in features]))


def top_deviations(df: DataFrame, features: list[str], top: int = 3) -> DataFrame:
    """The largest standardised deviations of a row, best first."""
    parts = F.array(*[F.struct(F.abs(F.col(f)).alias("size"), F.lit(f).alias("feature"), F.col(f).alias("z")) for f in features])
    return df.withColumn("drivers", F.transform(F.slice(F.sort_array(parts, False), 1, top), lambda d: F.struct(d["feature"].alias("feature"), d["z"].alias("z"))))


def uniform(row_id: str, salt: str, lo: float = 0.0, hi: float = 1.0):
    u = F.conv(F.substring(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return lo + (hi - lo) * u


def inject_statements(df: DataFrame, row_id: str, fraction: float) -> DataFrame:
    """Labelled distortions: receivables, accruals, or margin with sales growth, on a hash-chosen share of the rows."""
    hit = uniform(row_id, "pick") < fraction
    kind = F.floor(uniform(row_id, "kind", 0, 3))
    def change(c, k, value):
        return F.when(hit & (kind == k), value).otherwise(F.col(c))
    return df.withColumns({
        "bn_dsri": change("bn_dsri", 0, F.coalesce("bn_dsri", F.lit(1.0)) * uniform(row_id, "a", 2.5, 4)),
        "bn_tata": change("bn_tata", 1, F.coalesce("bn_tata", F.lit(0.0)) + uniform(row_id, "b", 0.15, 0.3)),
        "bn_gmi": change("bn_gmi", 2, F.coalesce("bn_gmi", F.lit(1.0)) * uniform(row_id, "c", 1.8, 3)),
        "bn_sgi": change("bn_sgi", 2, F.coalesce("bn_sgi", F.lit(1.0)) * uniform(row_id, "d", 1.6, 2.5)), "injected": hit.cast("int")})


def inject_market(df: DataFrame, row_id: str, fraction: float) -> DataFrame:
    """Labelled shocks: price with volume, volume alone, or a gap with a wide range."""
    hit = uniform(row_id, "pick") < fraction
    kind = F.floor(uniform(row_id, "kind", 0, 3))
    sign = F.when(uniform(row_id, "sign") < 0.5, -1.0).otherwise(1.0)
    on = lambda k: hit & (kind == k)
    out = df.withColumns({
        "ret_z": F.when(on(0), sign * uniform(row_id, "a", 4, 8)).otherwise(F.col("ret_z")),
        "volume_z": F.when(on(0), F.col("volume_z") + uniform(row_id, "b", 2, 5)).when(on(1), F.col("volume_z") + uniform(row_id, "c", 4, 7)).otherwise(F.col("volume_z")),
        "gap_z": F.when(on(2), sign * uniform(row_id, "d", 4, 7)).otherwise(F.col("gap_z")),
        "range_z": F.when(on(2), F.col("range_z") + uniform(row_id, "e", 3, 5)).otherwise(F.col("range_z")), "injected": hit.cast("int")})
    return out.withColumn("abs_ret_z", F.abs("ret_z"))
