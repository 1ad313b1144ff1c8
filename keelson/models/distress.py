"""Distress classifiers on the point-in-time dataset: fit, choose, calibrate, explain."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.models.prepare import fit_quantiles, winsor_impute
from keelson.operators.evaluate import rank_metrics
from keelson.session import materialise

# fixed values: feature groups dropped one at a time in the ablation
GROUPS = {
    "profitability": ["net_margin", "roa", "ebit_assets", "gross_margin"],
    "liquidity_solvency": ["current_ratio", "cash_assets", "debt_equity", "liabilities_assets", "interest_coverage", "negative_equity", "wc_ta", "be_tl"],
    "cash_flow": ["ocf_liabilities", "fcf_margin", "neg_fcf_quarters"],
    "growth_trend": ["revenue_yoy", "d_net_margin", "d_current_ratio", "revenue_slope_8q"],
    "classic_scores": ["re_ta", "altman_z2", "ohlson_o", "piotroski_f", "beneish_m"],
    "events": ["ev_restatement", "ev_auditor_change", "ev_exec_departure", "ev_restructuring", "ev_impairment", "ev_delisting_notice",
               "ev_debt_acceleration", "ev_late_filing", "ev_cyber_incident", "filing_lag_days"],
    "market_size": ["log_assets", "float_liabilities"],
}


def prepared(df: DataFrame, features: list[str], winsor=(0.01, 0.99)) -> DataFrame:
    """Winsorised and median-filled on the train split, with missing marks and balanced class weights."""
    train = df.where("split = 'train'")
    fit = fit_quantiles(train, features, [winsor[0], 0.5, winsor[1]])
    n = train.agg(F.sum(F.col("label")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, total = max(1, n["p"] or 0), max(2, n["n"])
    w = F.when(F.col("label") == 1, total / (2.0 * pos)).otherwise(total / (2.0 * max(1, total - pos)))
    ready = winsor_impute(df, features, fit).withColumns({"weight": w, "label": F.col("label").cast("double")})
    return materialise(ready.select("cik", "accn", "as_of", "split", "label", "weight", *features, *[f"{f}_missing" for f in features]))


def stages(algo: str, features: list[str], **p):
    inputs = features + ([f"{f}_missing" for f in features] if algo == "logistic_regression" else [])
    vec = VectorAssembler(inputCols=inputs, outputCol="raw_features")
    if algo == "logistic_regression":
        return [vec, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
                LogisticRegression(weightCol="weight", regParam=p.get("reg", 0.01), maxIter=p.get("iterations", 30))]
    if algo == "random_forest":
        return [vec, RandomForestClassifier(featuresCol="raw_features", weightCol="weight", numTrees=p.get("trees", 40), minInstancesPerNode=20,
                                            maxDepth=p.get("depth", 6), seed=7)]
    return [vec, GBTClassifier(featuresCol="raw_features", weightCol="weight", maxIter=p.get("rounds", 15), maxDepth=p.get("depth", 4),
                               stepSize=p.get("step", 0.1), seed=7)]


def score(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("prob", vector_to_array("probability")[1])


def fit_candidates(ready: DataFrame, features: list[str], grid: dict[str, list[dict]]) -> tuple[dict, DataFrame]:
    """Every algorithm and setting fitted on train and measured on validation. Returns fitted models and one metric table."""
    train, models, tables = ready.where("split = 'train'"), {}, None
    for algo, settings in grid.items():
        for i, s in enumerate(settings):
            name = f"{algo}#{i}"
            models[name] = Pipeline(stages=stages(algo, features, **s)).fit(train)
            m = rank_metrics(score(models[name], ready.where("split <> 'train'")).select("split", "label", "prob"), ["split"], "prob", "label")
            m = m.withColumn("candidate", F.lit(name))
            tables = m if tables is None else tables.unionByName(m)
    return models, materialise(tables)


def best(table: DataFrame) -> str:
    return table.where("split = 'validation'").orderBy(F.desc_nulls_last("pr_auc"), "candidate").first()["candidate"]


def logit(p):
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.ln(q / (1 - q))


def platt(scored: DataFrame):
    """Logistic regression on the log-odds of the validation scores (monotone, so the ranking is kept)."""
    z = VectorAssembler(inputCols=["z"], outputCol="zv")
    return Pipeline(stages=[z, LogisticRegression(featuresCol="zv", labelCol="label", probabilityCol="cal", rawPredictionCol="cr", predictionCol="cp")]).fit(
        scored.withColumn("z", logit(F.col("prob"))))


def calibrated(calibrator, scored: DataFrame) -> DataFrame:
    return calibrator.transform(scored.withColumn("z", logit(F.col("prob")))).withColumn("calibrated", vector_to_array("cal")[1])


def isotonic(scored: DataFrame):
    return IsotonicRegression(featuresCol="prob", labelCol="label", predictionCol="isotonic").fit(scored)


def contributions(model, df: DataFrame, features: list[str], top: int = 8) -> DataFrame:
    """Linear model: coefficient x standardised value per feature; the largest `top` by size, best first."""
    coef = model.stages[-1].coefficients.toArray().tolist()[:len(features)]
    z = vector_to_array("features")
    parts = F.zip_with(F.array(*[F.lit(c) for c in coef]), F.slice(z, 1, len(features)), lambda c, x: c * x)
    named = F.zip_with(F.array(*[F.lit(f) for f in features]), parts,
                       lambda f, c: F.struct(F.abs(c).alias("size"), f.alias("feature"), c.alias("contribution")))
    return df.withColumn("drivers", F.transform(F.slice(F.sort_array(named, False), 1, top), lambda d: F.struct(
        d["feature"].alias("feature"), F.bround(d["contribution"], 4).alias("contribution"))))


def importance(drivers: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature over all rows."""
    return (drivers.select(F.explode("drivers").alias("d")).groupBy(F.col("d.feature").alias("feature"))
            .agg(F.avg(F.abs("d.contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs")))


def ablation(ready: DataFrame, features: list[str]) -> DataFrame:
    """Validation and test PR-AUC with one feature group left out."""
    out, train = None, ready.where("split = 'train'")
    for group, cols in GROUPS.items():
        keep = [f for f in features if f not in cols]
        model = Pipeline(stages=stages("logistic_regression", keep, iterations=15)).fit(train)
        m = rank_metrics(score(model, ready.where("split <> 'train'")).select("split", "label", "prob"), ["split"], "prob", "label")
        m = m.select(F.lit(group).alias("dropped"), "split", "pr_auc")
        out = m if out is None else out.unionByName(m)
    return out
