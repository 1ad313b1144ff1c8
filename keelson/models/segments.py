"""Company segmentation: k chosen by silhouette, a mixture and the sector as comparisons, naming rule, soft membership."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES = ["net_margin", "roa", "revenue_yoy", "liabilities_assets", "current_ratio", "fcf_margin", "log_assets", "ocf_liabilities"]


def vectorise(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def silhouette(df: DataFrame, column: str) -> float:
    if df.select(column).distinct().limit(2).count() < 2:
        return -1.0
    return ClusteringEvaluator(predictionCol=column, featuresCol="features").evaluate(df)


def choose_k(z: DataFrame, grid=(4, 5, 6, 7), seed: int = 42):
    """Rows of (k, kmeans silhouette, mixture silhouette) and the best k-means model."""
    rows, best = [], None
    for k in grid:
        km = KMeans(k=k, seed=seed, maxIter=30).fit(z)
        gm = GaussianMixture(k=k, seed=seed, maxIter=20, predictionCol="gm", probabilityCol="gmp").fit(z)
        s = silhouette(km.transform(z), "prediction")
        rows.append((k, float(s), float(silhouette(gm.transform(z), "gm"))))
        if best is None or s > best[0]:
            best = (s, km)
    return rows, best[1]


def cluster_names(spark: SparkSession, centres: list[list[float]]) -> dict[int, str]:
    """Names from ranks over the k centroids: first by risk, then by growth, then by profit among those not named before."""
    frame = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], ["cluster", *FEATURES])
    strength = F.col("net_margin") + F.col("fcf_margin")
    frame = frame.withColumns({"risk": F.col("liabilities_assets") - F.col("current_ratio") - F.col("ocf_liabilities") - strength,
                               "growth": F.col("revenue_yoy"), "profit": strength + F.col("roa")})
    taken = F.lit(False)
    name = F.when(F.lit(False), F.lit(""))
    for label, measure in (("High Risk", "risk"), ("Growth", "growth"), ("Stable", "profit")):
        frame = frame.withColumn(f"_{measure}", F.row_number().over(Window.orderBy(taken, F.desc(measure), "cluster")))      # k rows
        name = name.when(F.col(f"_{measure}") == 1, label)
        taken = taken | (F.col(f"_{measure}") == 1)
    return {r["cluster"]: r["name"] for r in frame.select("cluster", name.otherwise("Watchlist").alias("name")).collect()}


def assign(z: DataFrame, centres: list[list[float]], names: dict[int, str]) -> DataFrame:
    """Nearest centre, its name, and softmax(-d^2) membership, as column expressions over k centres."""
    x = vector_to_array("features")
    centre = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    d2 = F.transform(centre, lambda c: F.aggregate(F.zip_with(c, F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    low = F.array_min("_d")
    weights = F.aggregate(F.transform("_d", lambda d: F.exp(F.col("_low") - d)), F.lit(0.0), lambda s, v: s + v)
    label = F.element_at(F.array(*[F.lit(names[i]) for i in range(len(centres))]), F.col("cluster") + 1)
    return (z.withColumn("_x", x).withColumn("_d", d2).withColumn("_low", low)
            .withColumn("cluster", (F.array_position("_d", F.col("_low")) - 1).cast("int"))
            .withColumn("membership", 1.0 / weights).withColumn("segment", label).drop("_x", "_d", "_low"))


def segment_profile(assigned: DataFrame, medians: list[str]) -> DataFrame:
    """Size, medians and label rate per segment; medians from exact bucketed quantiles."""
    from keelson.operators.ranking import melt, quantiles
    q = quantiles(melt(assigned, ["segment"], medians), ["segment", "feature"], "v", [0.5])
    wide = q.groupBy("segment").pivot("feature", medians).agg(F.first(F.get("quantiles", F.lit(0))))
    size = assigned.groupBy("segment").agg(F.count(F.lit(1)).alias("companies"), F.avg(F.col("label").cast("double")).alias("label_rate"))
    return size.join(wide, "segment", "left")


def davies_bouldin(z: DataFrame, cluster: str) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij; pairs are of centroids only."""
    x = z.select(F.col(cluster).alias("c"), vector_to_array("features").alias("x"))
    dims = x.select("c", F.posexplode("x").alias("i", "v"))
    centre = dims.groupBy("c", "i").agg(F.avg("v").alias("m"))
    centres = centre.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    spread = x.join(F.broadcast(centres), "c").groupBy("c", "m").agg(F.avg(dist(F.col("x"), F.col("m"))).alias("s"))   # k rows
    a, b = spread.alias("a"), spread.alias("b")
    worst = a.join(b, F.col("a.c") != F.col("b.c")).groupBy("a.c").agg(
        F.max((F.col("a.s") + F.col("b.s")) / dist(F.col("a.m"), F.col("b.m"))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def project(z: DataFrame, k: int = 2) -> DataFrame:
    p = PCA(k=k, inputCol="features", outputCol="pc").fit(z).transform(z)
    return p.withColumn("pc", vector_to_array("pc"))
