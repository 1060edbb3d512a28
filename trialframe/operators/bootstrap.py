"""Bootstrap intervals of any metric, drawn by cell.

Trials that a metric can't tell apart form a cell: a true class, a predicted class and a confidence bin, say, or a rank. If every trial
weighs Poisson(1) in a draw, a cell of n trials weighs Poisson(n), so a draw costs cells instead of trials. A metric is a function
(w, c) → column: an aggregate of the cells under the weights ``w``, where ``c(name)`` is a column of the cells; with ``w`` = the cells'
sizes it gives the point estimate. Within a cell, means (of a confidence, say) are taken for all its trials.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions.columns import let, safe_div

Metric = Callable[[Column, Callable[[str], Column]], Column]

#: A cell's size is taken apart into the powers of two below this and the rest, whose weight is drawn by its normal expansion.
EXACT = 64


def poisson_limits(mean: int) -> list[int]:
    """Least 32-bit words for weights 1, 2, … of Poisson(mean) by inversion of its distribution."""
    term, total, out = math.exp(-mean), 0.0, []
    for k in range(10 * mean + 20):
        total += term
        limit = math.ceil(total * 2.0**32)
        if limit >= 2**32:
            break
        out.append(limit)
        term *= mean / (k + 1)
    return out


def cells(df: DataFrame, discrete: list[str], means: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by…, discrete…, means…, n): rows that agree in the discrete columns."""
    return df.groupBy(*(by or []), *discrete).agg(*[F.avg(m).alias(m) for m in means or []], F.count(F.lit(1)).alias("n"))


def poisson_weight(n: str = "n", digest: str = "_h") -> Column:
    """Poisson(n) from the eight 32-bit words of a SHA-256. Up to 63 exactly, one word per power of two; of the rest, a multiple of 64,
    the quantile of a normal number with the skewness term, which is off by less than one."""
    word = lambda j: F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("bigint")
    reached = lambda j: let(word(j), lambda u: F.size(F.filter(F.array(*[F.lit(k) for k in poisson_limits(1 << j)]), lambda k: k <= u)))
    parts = [F.when(F.col(n).bitwiseAND(F.lit(1 << j)) > 0, reached(j)).otherwise(0) for j in range(6)]
    rest = F.col(n) - F.pmod(F.col(n), F.lit(EXACT))
    z = F.sqrt(-2.0 * F.log((word(6) + 0.5) / 2.0**32)) * F.cos(2.0 * F.pi() * (word(7) / 2.0**32))
    large = F.greatest(F.floor(rest + F.sqrt(rest) * z + (z * z - 1.0) / 6.0 + 0.5), F.lit(0))
    return sum(parts[1:], parts[0]) + F.when(rest > 0, large).otherwise(0)


def draws(cell: DataFrame, keys: list[str], n_boot: int, seed=0) -> DataFrame:
    """``cell`` once per draw with its weight ``w``; ``keys`` name a cell."""
    d = cell.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    name = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return d.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "draw", *name), 256)).withColumn("w", poisson_weight()).drop("_h")


def interval(drawn: DataFrame, by: list[str], alpha: float, stat: str = "_s") -> DataFrame:
    """Percentile limits over the finite draws (linear interpolation)."""
    d = drawn.filter(F.col(stat).isNotNull() & ~F.isnan(stat))
    return d.groupBy(*by).agg(F.percentile(stat, F.lit(alpha / 2)).alias("lo"), F.percentile(stat, F.lit(1 - alpha / 2)).alias("hi"))


def _estimate(cell: DataFrame, value: Callable[[Column], Column], keys: list[str], by: list[str], n_boot: int, alpha: float, seed) -> DataFrame:
    drawn = draws(cell, [*by, *keys], n_boot, seed).groupBy(*by, "draw").agg(value(F.col("w")).cast("double").alias("_s"))
    ci, point = interval(drawn, by, alpha), cell.groupBy(*by).agg(value(F.col("n")).cast("double").alias("point"))
    if not by:
        return ci.select(point.scalar().alias("point"), "lo", "hi")
    return point.join(ci, by, "left").select(*by, "point", "lo", "hi")


def bootstrap(df: DataFrame, metric: Metric, discrete: list[str], means: list[str] | None = None, n_boot: int = 1000, alpha: float = 0.05,
              seed=0, by: list[str] | None = None) -> DataFrame:
    """(by…, point, lo, hi) of a metric. Draws in which it is undefined are left out; without any, the limits are null."""
    return _estimate(cells(df, discrete, means, by), lambda w: metric(w, F.col), discrete, by or [], n_boot, alpha, seed)


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, metric: Metric, discrete: list[str], means: list[str] | None = None, n_boot: int = 1000,
                     alpha: float = 0.05, seed=0) -> DataFrame:
    """b − a of a metric with the same weights for both arms, and a verdict; a trial in only one arm raises."""
    names = [*discrete, *(means or [])]
    arm = lambda df, tag: df.select(key, F.lit(True).alias(f"_{tag}"), *[F.col(c).alias(f"{tag}_{c}") for c in names])
    j = arm(a, "a").join(arm(b, "b"), key, "full_outer")
    lone = F.raise_error(F.lit("arms cover different trials")).cast("boolean")
    j = j.filter(F.when(F.col("_a").isNull() | F.col("_b").isNull(), lone).otherwise(True))
    both = lambda cols: [f"{tag}_{c}" for tag in "ab" for c in cols]
    value = lambda w: metric(w, lambda c: F.col(f"b_{c}")) - metric(w, lambda c: F.col(f"a_{c}"))
    out = _estimate(cells(j, both(discrete), both(means or [])), value, both(discrete), [], n_boot, alpha, seed)
    return out.withColumn("verdict", F.when(F.col("lo") > 0, "REAL").when(F.col("hi") >= 0, "noise").otherwise("REVERSED"))


def bootstrap_ci(df: DataFrame, value: str, n_boot: int = 1000, alpha: float = 0.05, seed=0, by: list[str] | None = None) -> DataFrame:
    """Interval of the mean of a column."""
    return bootstrap(df, mean_of(value), [value], None, n_boot, alpha, seed, by)


def paired_bootstrap_delta(a: DataFrame, b: DataFrame, key: str, value: str, n_boot: int = 1000, alpha: float = 0.05, seed=0) -> DataFrame:
    """Interval of the difference of two arms' means of a column."""
    return paired_bootstrap(a, b, key, mean_of(value), [value], None, n_boot, alpha, seed)


# ---- metrics ---------------------------------------------------------------------------------------------------

def mean_of(value: str) -> Metric:
    return lambda w, c: safe_div(F.sum(w * c(value)), F.sum(w))


def accuracy(w: Column, c) -> Column:
    return safe_div(F.sum(F.when(c("y") == c("yhat"), w).otherwise(0)), F.sum(w))


def kappa(n_classes: int) -> Metric:
    """Cohen's kappa of ``y`` and ``yhat`` in 0 … n_classes − 1; null where chance agreement is 1."""
    def value(w, c):
        total = F.sum(w).cast("double")
        share = lambda name, k: F.sum(F.when(c(name) == k, w).otherwise(0)).cast("double")
        chance = safe_div(sum(share("y", k) * share("yhat", k) for k in range(n_classes)), total * total)
        return safe_div(accuracy(w, c) - chance, 1 - chance)
    return value


def calibration_error(bins: int = 15) -> Metric:
    """Expected calibration error from ``y``, ``yhat``, ``bin`` and the mean ``conf`` of a cell; bin −1 counts only in the total."""
    def value(w, c):
        gap = lambda b: F.abs(F.sum(F.when(c("bin") == b, w * ((c("y") == c("yhat")).cast("int") - c("conf"))).otherwise(0.0)))
        return safe_div(sum(gap(b) for b in range(bins)), F.sum(w))
    return value


def recall_at(k: int, rank: str = "rank") -> Metric:
    return lambda w, c: safe_div(F.sum(F.when(c(rank) <= k, w).otherwise(0)), F.sum(w))
