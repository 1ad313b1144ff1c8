"""Quarterly forecasting: origin rows, naive and damped-trend baselines, a global model and conformal intervals."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.operators.ranking import quantiles
from keelson.operators.series import regular_run

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # workers need no copy of this package
LAGS = 8
FEATURES = [f"lag_{k}" for k in range(LAGS)] + ["yoy_ratio", "growth_4q", "volatility", "quarter", "horizon", "log_scale"]


def forecast_rows(quarters: DataFrame, min_length: int = LAGS + 6) -> DataFrame:
    """quarters: (cik, end, val). One row per origin and horizon 1..4 over the latest regular run of each company."""
    run = regular_run(quarters, ["cik"])
    w = W.partitionBy("cik").orderBy("end")
    v = lambda k: F.lag("val", k).over(w)
    seasonal = F.abs(F.col("val") - v(4))
    df = run.withColumns({
        **{f"v{k}": v(k) for k in range(LAGS)}, **{f"f{h}": F.lead("val", h).over(w) for h in range(1, 5)},
        **{f"e{h}": F.lead("end", h).over(w) for h in range(1, 5)}, "idx": F.row_number().over(w),
        "length": F.count(F.lit(1)).over(W.partitionBy("cik")), "_s": seasonal})
    df = df.withColumn("mase_scale", F.avg("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    four = lambda a: sum((F.col(f"v{k}") for k in range(a + 1, a + 4)), F.col(f"v{a}"))
    size = sum((F.abs(F.col(f"v{k}")) for k in range(1, 4)), F.abs("v0")) / 4.0
    df = df.where((F.col("length") >= min_length) & (F.col("idx") >= LAGS)).withColumn("scale", size).where("scale > 0")
    steps = [(F.col(f"v{k}") - F.col(f"v{k + 1}")) / F.col("scale") for k in range(LAGS - 1)]
    mean = sum(steps[1:], steps[0]) / len(steps)
    var = sum(((s - mean) * (s - mean) for s in steps[1:]), (steps[0] - mean) * (steps[0] - mean)) / len(steps)
    targets = F.array_compact(F.array(*[F.when(F.col(f"f{h}").isNotNull(), F.struct(
        F.lit(h).alias("horizon"), F.col(f"f{h}").alias("y"), F.col(f"e{h}").alias("target_end"),
        F.col(f"v{4 - h}").alias("seasonal"))) for h in range(1, 5)]))
    base = df.select("cik", F.col("end").alias("origin"), "scale", "mase_scale", F.col("v0").alias("last"),
                     *[(F.col(f"v{k}") / F.col("scale")).alias(f"lag_{k}") for k in range(LAGS)],
                     F.when(F.col("v4") != 0, F.col("v0") / F.col("v4")).alias("yoy_ratio"),
                     F.when(four(4) > 0, four(0) / four(4) - 1).alias("growth_4q"), F.sqrt(var).alias("volatility"),
                     F.log10("scale").alias("log_scale"), F.explode(targets).alias("t"))
    return base.select(*[c for c in base.columns if c != "t"], "t.*").withColumns(
        {"quarter": F.quarter(F.date_add("origin", F.col("horizon") * 91)), "target": F.col("y") / F.col("scale")})


def fit_global(train: DataFrame, rounds: int = 20) -> object:
    """One boosted model for all series and horizons; absolute loss, targets clipped to +-5 scales."""
    ready = train.withColumn("clipped", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("target")))).na.fill(0.0, ["yoy_ratio", "growth_4q"])
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return Pipeline(stages=[vec, GBTRegressor(labelCol="clipped", lossType="absolute", maxIter=rounds, maxDepth=5, seed=7)]).fit(ready)


def predict(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows.na.fill(0.0, ["yoy_ratio", "growth_4q"])).drop("features").withColumnRenamed("prediction", "scaled")


def conformal(calib: DataFrame, predicted: DataFrame) -> DataFrame:
    """10/90% residual quantiles per horizon from the calibration split, applied to predictions."""
    res = calib.select("horizon", (F.col("target") - F.col("scaled")).alias("r"))
    q = quantiles(res, ["horizon"], "r", [0.1, 0.9]).select("horizon", F.get("quantiles", F.lit(0)).alias("q10"), F.get("quantiles", F.lit(1)).alias("q90"))
    s, k = F.col("scaled"), F.col("scale")
    return predicted.join(q, "horizon").withColumns({"p10": (s + F.col("q10")) * k, "p50": s * k, "p90": (s + F.col("q90")) * k})


GRID = list(itertools.product((0.2, 0.5, 0.8), (0.05, 0.2), (0.1, 0.4), (0.9, 0.98)))     # level, trend, season, damping
SEASON, AHEAD = 4, 4


class DampedTrend:
    """Damped additive trend and season of one series, all settings side by side as vectors; one step a value."""

    def __init__(self, grid: np.ndarray):
        self.a, self.b, self.g, self.phi = grid.T
        self.damp = np.cumsum(self.phi[:, None] ** np.arange(1, AHEAD + 1), axis=1)
        self.first: list[float] = []
        self.sse = np.zeros(len(grid))

    def step(self, y: float) -> None:
        past = self.level + self.phi * self.trend
        seasonal = self.season[0]
        self.sse += (y - past - seasonal) ** 2
        level = self.a * (y - seasonal) + (1 - self.a) * past
        self.trend = self.b * (level - self.level) + (1 - self.b) * self.phi * self.trend
        self.season = [*self.season[1:], self.g * (y - level) + (1 - self.g) * seasonal]
        self.level = level

    def add(self, y: float) -> list[float] | None:
        """The forecasts from this origin by the setting of least error so far; None before two seasons."""
        if self.first is not None:
            self.first.append(y)
            if len(self.first) < 2 * SEASON:
                return None
            start, later = np.array(self.first[:SEASON]), self.first[SEASON:]
            self.level = np.full(len(self.a), start.mean())
            self.trend = np.full(len(self.a), (np.mean(later) - start.mean()) / SEASON)
            self.season = [np.full(len(self.a), v) for v in start - start.mean()]
            self.first = None
            for v in later:
                self.step(v)
        else:
            self.step(y)
        k = int(np.argmin(self.sse))
        return [float(self.level[k] + self.damp[k, h] * self.trend[k] + self.season[h % SEASON][k]) for h in range(AHEAD)]


def damped_baseline(quarters: DataFrame, grid: list[tuple] = GRID, min_length: int = LAGS + 6) -> DataFrame:
    """(cik, origin, horizon, damped): forecasts from each origin, in one pass over the values of a company in time order.

    The state of all settings moves on with each value, so the work is linear in the length of a series. Rows stream through a task sorted
    by company and date; nothing of a company is held but its state.
    """
    run = regular_run(quarters, ["cik"]).withColumn("length", F.count(F.lit(1)).over(W.partitionBy("cik")))
    settings = np.array(grid, dtype=float)

    def forecasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company, state = None, None
        for b in batches:
            out: dict[str, list] = {"cik": [], "origin": [], "horizon": [], "damped": []}
            for cik, end, val, length in zip(*(b.column(c).to_pylist() for c in ("cik", "end", "val", "length")), strict=True):
                if state is None or cik != company:
                    company, state = cik, DampedTrend(settings)
                told = state.add(val)
                if told is not None and length >= min_length:
                    for h, v in enumerate(told):
                        out["cik"].append(cik), out["origin"].append(end), out["horizon"].append(h + 1), out["damped"].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["cik"], b.schema.field("cik").type), pa.array(out["origin"], pa.date32()), pa.array(out["horizon"], pa.int32()),
                                              pa.array(out["damped"], pa.float64())], names=list(out))

    key = run.schema["cik"].dataType.simpleString()
    return (run.select("cik", "end", "val", "length").repartition("cik").sortWithinPartitions("cik", "end")
            .mapInArrow(forecasts, f"cik {key}, origin date, horizon int, damped double"))
