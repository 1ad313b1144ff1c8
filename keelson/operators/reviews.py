"""Employee reviews: firm mapping, quarterly sentiment index with bootstrap interval, theme shares, trend."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.functions.numeric import theil_sen
from keelson.functions.text import quarter_label

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # workers need no copy of this package
REPLICAS = 300
PART_VALUES = 50_000                              # distinct values that one task adds up
MIN_REVIEWS = 10


def map_firms(reviews: DataFrame, firm_map: DataFrame, as_of) -> DataFrame:
    """Reviews of mapped firms (several firm names may share one company) written on or before as_of."""
    return reviews.join(firm_map, "firm").where(F.col("date_review") <= F.lit(as_of).cast("date"))


def quarterly_index(reviews: DataFrame) -> DataFrame:
    return (reviews.groupBy("cik", quarter_label(F.col("date_review")).alias("quarter"))
            .agg(F.avg("polarity").alias("index"), F.count(F.lit(1)).alias("reviews"),
                 F.avg(F.col("overall_rating").cast("double")).alias("mean_rating")))


def bootstrap_interval(reviews: DataFrame, replicas: int = REPLICAS, seed: int = 42) -> DataFrame:
    """90% interval of the quarterly mean from Poisson replica weights.

    Reviews fold to (company, quarter, value) with a count first. A value that stands c times weighs Poisson(c) in each replica, which is the sum
    of its c Poisson(1) weights; the draw is keyed by a hash of the value, so it does not depend on the partitioning. Each part of a quarter (of
    `PART_VALUES` distinct values at most, on average) adds up to two vectors over the replicas, and the parts of a quarter to its interval:
    no row is written out per replica. A quarter with one review has a point interval.
    """
    keyed = reviews.select("cik", quarter_label(F.col("date_review")).alias("quarter"), F.col("polarity").cast("double").alias("v")).where("v is not null")
    folded = keyed.groupBy("cik", "quarter", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("h", F.xxhash64("cik", "quarter", "v", F.lit(seed)))
    groups = folded.groupBy("cik", "quarter").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("reviews"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("index"))
    parts = folded.join(groups.select("cik", "quarter", "d"), ["cik", "quarter"])
    parts = parts.withColumn("part", F.pmod("h", F.ceil(F.col("d") / PART_VALUES)).cast("int")).select("cik", "quarter", "part", "v", "c", "h")
    key = keyed.schema["cik"].dataType.simpleString()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of each (cik, quarter, part); its rows stand together."""
        at, sums = None, None
        for b in itertools.chain(batches, [None]):
            done: list[tuple] = []
            rows = zip(*(b.column(c).to_pylist() for c in ("cik", "quarter", "part", "v", "c", "h")), strict=True) if b is not None else [(None,) * 6]
            for cik, quarter, part, v, c, h in rows:
                if (cik, quarter, part) != at:
                    if sums is not None:
                        done.append((at[0], at[1], sums[0].tobytes(), sums[1].tobytes()))
                    at, sums = (cik, quarter, part), np.zeros((2, replicas))
                if b is not None:
                    w = np.random.Generator(np.random.Philox(key=h & (1 << 64) - 1)).poisson(c, replicas)
                    sums += np.stack([w, w * v])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kinds.field("cik").type), *[pa.array([d[k] for d in done], kinds.field(k).type) for k in (1, 2, 3)]],
                                                 schema=kinds)

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        w, s = (sum(np.frombuffer(x) for x in rows[c]) for c in ("w", "s"))
        low, high = np.quantile(s[w > 0] / w[w > 0], [0.05, 0.95]) if (w > 0).any() else (np.nan, np.nan)
        return pd.DataFrame({"cik": rows["cik"].iloc[:1], "quarter": rows["quarter"].iloc[:1], "low": [low], "high": [high]})

    schema = T.StructType([T.StructField("cik", keyed.schema["cik"].dataType), T.StructField("quarter", T.StringType()), T.StructField("w", T.BinaryType()),
                           T.StructField("s", T.BinaryType())])
    kinds = to_arrow_schema(schema)
    vectors = parts.repartition("cik", "quarter", "part").sortWithinPartitions("cik", "quarter", "part").mapInArrow(add_up, schema)
    ci = vectors.groupBy("cik", "quarter").applyInPandas(interval, f"cik {key}, quarter string, low double, high double")
    one = F.col("reviews") == 1
    return groups.join(ci, ["cik", "quarter"]).select("cik", "quarter", F.when(one, F.col("index")).otherwise(F.col("low")).alias("ci90_low"),
                                                      F.when(one, F.col("index")).otherwise(F.col("high")).alias("ci90_high"))


def usable_quarters(index: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    return index.where(F.col("reviews") >= min_reviews)


def index_trend(index: DataFrame) -> DataFrame:
    """Latest usable quarter and the Theil-Sen slope of the last four index values."""
    last4 = (index.withColumn("_k", F.row_number().over(W.partitionBy("cik").orderBy(F.desc("quarter"))))
             .where(F.col("_k") <= 4))
    g = last4.groupBy("cik").agg(
        F.array_sort(F.collect_list(F.struct("quarter", "index"))).alias("_s"), F.max("quarter").alias("quarter"),
        F.max_by("index", "quarter").alias("index"))
    values = F.transform("_s", lambda s: s["index"])
    return g.select("cik", "quarter", "index", F.bround(theil_sen(values), 4).alias("trend"))


def theme_shares(weights: DataFrame) -> DataFrame:
    """weights: (cik, review_id, theme, w >= 0). Row-normalised weights averaged per company and theme."""
    totals = weights.groupBy("cik", "review_id").agg(F.sum("w").alias("_t"))
    share = F.col("w") / F.greatest(F.col("_t"), F.lit(1e-12))
    rows = totals.groupBy("cik").agg(F.count(F.lit(1)).alias("_n"))
    return (weights.join(totals, ["cik", "review_id"]).withColumn("_s", share).groupBy("cik", "theme")
            .agg(F.sum("_s").alias("_sum")).join(rows, "cik")
            .select("cik", "theme", (F.col("_sum") / F.col("_n")).alias("share")))
