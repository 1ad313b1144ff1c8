"""Fitted preprocessing: winsor bounds, medians, robust scales and rank-normal scores. Fits are a few numbers per feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import signed_log
from keelson.operators.ranking import fold, melt, prefix_sums, quantiles


def fit_quantiles(df: DataFrame, features: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Exact quantiles per feature; the result is one short row per feature."""
    rows = quantiles(melt(df, [], features), ["feature"], "v", probs).collect()
    return {r["feature"]: list(r["quantiles"]) for r in rows}


def winsor_impute(df: DataFrame, features: list[str], fitted: dict[str, list[float]]) -> DataFrame:
    """fitted: [low, median, high] per feature. Adds `<f>` clipped and median-filled and `<f>_missing`."""
    cols = {}
    for f in features:
        lo, mid, hi = fitted.get(f, [0.0, 0.0, 0.0])
        cols[f"{f}_missing"] = F.col(f).isNull().cast("double")
        cols[f] = F.coalesce(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(f))), F.lit(mid)) if f in fitted else F.lit(0.0)
        cols[f] = F.when(F.col(f).isNull(), F.lit(mid)).otherwise(cols[f])
    return df.withColumns(cols)


def robust_scale(df: DataFrame, features: list[str], train: DataFrame) -> DataFrame:
    """Signed log, median fill, then (x - median) / (q90 - q10), all fitted on train."""
    logged = lambda d: d.withColumns({f: signed_log(f) for f in features})
    fit = fit_quantiles(logged(train), features, [0.1, 0.5, 0.9])
    out = {}
    for f in features:
        lo, mid, hi = fit.get(f, [0.0, 0.0, 1.0])
        out[f] = (F.coalesce(F.col(f), F.lit(mid)) - mid) / ((hi - lo) or 1.0)
    return logged(df).withColumns(out)


# Acklam's rational approximation of the normal quantile (public, fixed values)
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def _poly(x: Column, coef: list[float]) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _poly(tail, _C) / (_poly(tail, _D) * tail + 1)
    q = p - 0.5
    inner = _poly(q * q, _A) * q / (_poly(q * q, _B) * (q * q) + 1)
    return F.when(p < 0.02425, outer).when(p > 1 - 0.02425, -outer).otherwise(inner)


def rank_normal(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Median fill, average rank as a share, inverse normal (clipped to +-5.2). Ranks come from bucketed prefix sums."""
    fit = fit_quantiles(df, features, [0.5])
    full = df.withColumns({f: F.coalesce(F.col(f), F.lit(fit.get(f, [0.0])[0])) for f in features})
    long = melt(full, [key], features)
    ranks = prefix_sums(fold(long, ["feature"], "v"), ["feature"], "v", ["n"])
    share = (F.col("n_before") + (F.col("n") - 1) / 2.0) / F.greatest(F.col("n_total") - 1, F.lit(1))
    z = normal_quantile(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), share)))
    scored = long.join(ranks.select("feature", "v", z.alias("z")), ["feature", "v"])
    return scored.groupBy(key).pivot("feature", features).agg(F.first("z"))
