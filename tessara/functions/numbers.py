"""Scalar and array statistics over columns."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column, alpha: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-x * alpha))


def scale_sigmoid(x: Column, alpha: float = 1.0, x0: float = 10.0) -> Column:
    """A sigmoid scaled so that x0 maps to 1 and -x0 to 0."""
    low, high = sigmoid(F.lit(-x0), alpha), sigmoid(F.lit(x0), alpha)
    return (sigmoid(x, alpha) - low) / (high - low)


def n_choose_k(n: Column, k: int) -> Column:
    """Exact for results below 2^53."""
    out = F.lit(1.0)
    for i in range(k):
        out = F.round(out * (n - i) / (i + 1))
    return F.when(n >= k, out).otherwise(0.0).cast("long")


def n_choose_k_value(n: int, k: int) -> int:
    return comb(n, k) if 0 <= k <= n else 0


def combinations(df: DataFrame, column: str, k: int) -> DataFrame:
    """Every choice of k different values of the column, ascending, as columns c1 .. ck. The result has n choose k rows
    by its nature; each next value is joined by a range of the values after it."""
    values = df.select(F.col(column).alias("c")).distinct()
    out = values.withColumnRenamed("c", "c1")
    for i in range(2, k + 1):
        out = out.join(values.withColumnRenamed("c", f"c{i}"), F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out


def truncate_cast(x: Column, low: int, high: int) -> Column:
    """x held to [low, high], then cut to a whole number."""
    return clip(x, low, high).cast("long")


def huber_weight(r: Column, k: float = 1.2) -> Column:
    return F.when(F.abs(r) < k, 1.0).otherwise(k / F.abs(r))


def huber_cost(r: Column, k: float = 1.2) -> Column:
    return F.when(F.abs(r) < k, r * r / 2).otherwise(k * (F.abs(r) - k / 2))


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def median(xs: Column) -> Column:
    """The middle of the sorted values, or the mean of the two in the middle."""
    s, n = F.array_sort(xs), F.size(xs)
    high = F.get(s, (n / 2).cast("int"))
    return F.when(n % 2 == 1, high).otherwise((high + F.get(s, (n / 2).cast("int") - 1)) / 2)


def upper_median(xs: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    return F.get(F.array_sort(xs), F.floor(F.size(xs) / 2).cast("int"))


def variance(xs: Column) -> Column:
    """Of a sample: over n - 1."""
    m = mean(xs)
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(xs) - 1)


def std_dev(xs: Column) -> Column:
    return F.sqrt(variance(xs))


def percentile(xs: Column, p: float) -> Column:
    """The value at the nearest rank round(p / 100 * (n - 1)) of the sorted values."""
    return F.get(F.array_sort(xs), F.round(F.lit(p / 100) * (F.size(xs) - 1)).cast("int"))


def any_less(xs: Column, th: float) -> Column:
    return F.exists(xs, lambda x: x < th)


def any_greater(xs: Column, th: float) -> Column:
    return F.exists(xs, lambda x: x > th)


def luma(r: Column, g: Column, b: Column) -> Column:
    """The weights of the channels."""
    return F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 0.5).cast("int")


def luma_three_digits(r: Column, g: Column, b: Column) -> Column:
    """The older weights."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def normal_to_rgb(n: Column) -> Column:
    return ((n * 0.5 + 0.5) * 255).cast("int")


def random_integer(low: int, high: int, seed: int = 0) -> Column:
    """From low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def random_real(low: float, high: float, seed: int = 0) -> Column:
    return F.rand(seed) * (high - low) + low


def random_gaussian(mean_: float, stddev: float, seed: int = 0) -> Column:
    return F.randn(seed) * stddev + mean_


def shuffled(xs: Column, n: int, seed: int = 0) -> Column:
    """n of the elements in random order."""
    return F.slice(F.shuffle(xs, F.lit(seed)), 1, n)
