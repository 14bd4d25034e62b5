"""Moments, the normal distribution and Sharpe-type statistics as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def skewness(x: Column) -> Column:
    """Bias-adjusted sample skewness; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; null below four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's; null where either side is constant, for which the built-in one fails under ANSI arithmetic."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """Phi by the Zelen-Severo polynomial, right to 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sharpe(r: Column, periods: float) -> Column:
    return F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * F.lit(periods**0.5))


def probabilistic_sharpe(sr: Column, target: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """P(true Sharpe > target), both per period; kurt is the excess kurtosis."""
    spread = 1 - skew * sr + (kurt + 2) / 4 * sr * sr
    return F.when((n >= 4) & (spread > 0), normal_cdf((sr - target) * F.sqrt(n - 1) / F.sqrt(spread)))


def expected_best(trials: int) -> float:
    """Expected largest of so many standard normal values."""
    if trials <= 1:
        return 0.0
    return (1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * 2.718281828459045))
