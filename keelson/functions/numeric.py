"""Null-preserving numeric column helpers. Missing is always SQL NULL, never NaN and never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when either side is missing or the denominator is zero."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Bound x to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def winsorise(x: Column | str, lo: Column, hi: Column) -> Column:
    """Clip to fitted bounds given as columns; an unfitted bound leaves that side open."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def finite(x: Column | str) -> Column:
    """+-infinity and NaN become NULL."""
    return F.nullif(F.nullif(F.nanvl(col(x), F.lit(None).cast("double")), F.lit(float("inf"))), F.lit(float("-inf")))


def present_count(cols: list[str]) -> Column:
    """How many of the columns are not NULL in the row."""
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def min_present(df, cols: list[str], k: int):
    """Keep rows in which at least k of the columns are known."""
    return df.where(present_count(cols) >= k)


def signed_log(x: Column | str) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_median(arr: Column) -> Column:
    """Median of an array without NULLs, NULL when it is empty."""
    def middle(s):
        n = F.size(s)
        lo = F.floor((n - 1) / 2).cast("int")
        hi = F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2.0)

    return let(F.array_sort(arr), middle)


def theil_sen(values: Column) -> Column:
    """Median pairwise slope of an array at index spacing (NULL below four points)."""
    def slopes(v):
        n = F.size(v)
        return F.flatten(F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.transform(F.sequence(i + 1, n - 1),
                                  lambda j: (F.get(v, j) - F.get(v, i)) / (j - i).cast("double"))))

    return let(values, lambda v: F.when(F.size(v) >= 4, sorted_median(slopes(v))))


def total_of(arr: Column) -> Column:
    """Left-to-right sum of a double array."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean_of(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, total_of(a) / F.size(a)))
