"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a text.

Each class has a mean and a covariance of the standardised statistics. A covariance is shrunk towards the pooled one and towards a
multiple of the identity; its Cholesky factor is computed once, and a score is the sigmoid of the difference of the two log densities
(Mahalanobis distances through the factors) plus the log of the class odds.

Sums for means and covariances are one Spark aggregation over all labelled rows; only two rows reach the driver.

Defined cases: null and empty texts have all counts zero and are scored like any text; a text of any length is read whole; without labels
every score is 0.5, with one class only it is that class's (0 or 1); several labels of one document each count; labels other than 0 and 1
and null labels are ignored; repeated rows give repeated results; extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import add_columns

STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "punctuation", "distinct", "repeated", "top_word", "short_words",
              "line_words")
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.05
FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
SCORE = T.StructType([T.StructField("quality_score", T.DoubleType())])
BYTES = np.arange(256)
UPPER, LOWER, DIGIT = (BYTES >= 65) & (BYTES <= 90), (BYTES >= 97) & (BYTES <= 122), (BYTES >= 48) & (BYTES <= 57)
LIGHT = np.isin(BYTES, [ord(c) for c in ".,;:'?\"-()"])
SYMBOL = (BYTES > 32) & (BYTES < 127) & ~(UPPER | LOWER | DIGIT | LIGHT)


def odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, chars = len(words), len(text)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeated = sum(map(str.__eq__, words[1:], words)) if n > 1 else 0
    upper, lower = int(counts[UPPER].sum()), int(counts[LOWER].sum())
    return [float(np.log1p(chars)), float(np.log1p(n)), float(np.log1p(sum(map(len, words)) / max(n, 1))), odds(upper, upper + lower),
            odds(int(counts[DIGIT].sum()), chars), odds(int(counts[SYMBOL].sum()), chars), odds(int(counts[LIGHT].sum()), chars),
            odds(len(seen), n), odds(repeated, n), odds(max(seen.values(), default=0), n), odds(sum(len(w) <= 3 for w in words), n),
            float(np.log1p(n / (int(counts[10]) + 1)))]


def with_features(df: DataFrame, column: str = "text") -> DataFrame:
    return add_columns(df, column, FEATURES, lambda: lambda texts: [[statistics(t) for t in texts]])


class Discriminant:
    """Fitted classes; picklable, and small (two means and two factors)."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """sums: label -> (rows, sum of features, sum of outer products)."""
        d = len(STATISTICS)
        self.n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        if not self.n[0] or not self.n[1]:
            return
        n = self.n[0] + self.n[1]
        self.centre = (sums[0][1] + sums[1][1]) / n
        spread = np.sqrt(np.maximum(np.diag(sums[0][2] + sums[1][2]) / n - self.centre ** 2, 0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        means = {c: (sums[c][1] / self.n[c] - self.centre) / self.scale for c in (0, 1)}
        covs = {}
        for c in (0, 1):
            second = (sums[c][2] / self.n[c] - np.outer(self.centre, sums[c][1] / self.n[c]) - np.outer(sums[c][1] / self.n[c], self.centre)
                      + np.outer(self.centre, self.centre)) / np.outer(self.scale, self.scale)
            covs[c] = second - np.outer(means[c], means[c])
        pooled = (self.n[0] * covs[0] + self.n[1] * covs[1]) / n
        self.classes = []
        for c in (0, 1):
            s = (1 - SHRINK_POOLED) * covs[c] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_IDENTITY) * s + SHRINK_IDENTITY * max(np.trace(s) / d, 1e-3) * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.classes.append((means[c], np.linalg.inv(chol), float(np.log(np.diag(chol)).sum()), float(np.log(self.n[c] / n))))

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.n[0] or not self.n[1]:
            return np.full(len(features), 0.5 if self.n[0] == self.n[1] else float(self.n[1] > 0))
        x = (features - self.centre) / self.scale
        log = [prior - det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, det, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", column: str = "text", key: str = "doc_id") -> Discriminant:
    """Class sums over every labelled row: one aggregation of features joined with labels on `key`."""
    d = len(STATISTICS)
    marked = labels.select(F.col(key), F.col(label).alias("label")).where("label in (0, 1)")
    rows = with_features(docs.select(key, column), column).select(key, "features").join(marked, key)
    at = [F.col("features")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(at[i]).alias(f"s{i}") for i in range(d)],
                                    *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    sums = {}
    for r in got:
        outer = np.zeros((d, d))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = r[f"p{i}_{j}"]
        sums[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), outer)
    return Discriminant(sums)


def score(df: DataFrame, model: Discriminant, column: str = "text") -> DataFrame:
    """`df` with quality_score in [0, 1], higher where label 1 is likelier."""

    def make():
        def compute(texts: list) -> list[list]:
            if not texts:
                return [[]]
            return [model.scores(np.array([statistics(t) for t in texts])).tolist()]
        return compute

    return add_columns(df, column, SCORE, make)
