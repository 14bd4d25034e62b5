"""Inference on return series: autocorrelation-robust tests, sample sizes, Sharpe statistics, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import moments


#: Draws of a series that are made from one copy of its values.
DRAWS = 100


def newey_west(series: DataFrame, lags: int | None = None, by: str = "series", order: str = "date", value: str = "r") -> DataFrame:
    """(series, n, lags, mean, t_hac, p_hac, t_naive, inflation) for all series at once.

    Autocovariances come from an equi-join of each row with those up to `lags` before it (floor(4 (n/100)^(2/9)) by
    default, n - 2 at most), so that the work per series is n times lags. Under eight values the statistics are null.
    """
    x = series.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("r"), F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("k"))
    stats = x.groupBy(by).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"))
    rule = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))) if lags is None else F.lit(lags)
    stats = stats.withColumn("lags", F.greatest(F.lit(0), F.least(rule, F.col("n") - 2)).cast("long"))
    e = x.join(stats.select(by, "mean", "lags", "n"), by).select(by, "k", "lags", "n", (F.col("r") - F.col("mean")).alias("e"))
    shifted = e.select(by, F.col("e").alias("f"), F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("lag"), "k").select(by, "f", "lag", (F.col("k") + F.col("lag")).alias("k"))
    gamma = e.join(shifted, [by, "k"]).groupBy(by, "lag").agg((F.sum(F.col("e") * F.col("f")) / F.max("n")).alias("g"), F.max("lags").alias("l"))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("l") + 1)))
    lrv = gamma.groupBy(by).agg(F.sum(weight * F.col("g")).alias("v"), F.max(F.when(F.col("lag") == 0, F.col("g"))).alias("g0"))
    out = stats.join(lrv, by).withColumn("v", F.when(F.col("v") > 0, F.col("v")).otherwise(F.col("g0")))
    enough = lambda c: F.when(F.col("n") >= 8, c)
    t = F.col("mean") / F.nullif(F.sqrt(F.col("v") / F.col("n")), F.lit(0.0))
    naive = F.col("mean") / F.nullif(F.col("dev") / F.sqrt("n"), F.lit(0.0))
    out = out.select(by, "n", "lags", enough(F.col("mean")).alias("mean"), enough(t).alias("t_hac"), enough(naive).alias("t_naive"))
    return out.withColumns({"p_hac": 2 * (1 - moments.normal_cdf(F.abs("t_hac"))), "inflation": F.abs(F.col("t_naive") / F.nullif(F.col("t_hac"), F.lit(0.0)))})


def effective_sample(n: int | float, names, overlap, rho):
    """Independent observations behind n panel rows of `names` series that overlap in time and correlate by rho."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(0.999), rho))
    return F.greatest(F.lit(1.0), (n / names) / overlap * names / (1 + (names - 1) * r))


def average_correlation(returns: DataFrame) -> DataFrame:
    """(avg_corr, pairs) over pairs of tickers that trade on common dates, within 0 and 0.99."""
    a = returns.select("date", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    pairs = a.join(b, "date").filter("a < b").groupBy("a", "b").agg(moments.correlation("x", "y").alias("c")).filter("c IS NOT NULL")
    return pairs.agg(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.avg("c"))).alias("avg_corr"), F.count("*").alias("pairs"))


def sharpe_table(series: DataFrame, periods: float, by: str = "series", value: str = "r") -> DataFrame:
    """(series, n, sharpe, skew, kurt) of each series; skewness and excess kurtosis are bias-adjusted."""
    x = F.col(value)
    return series.groupBy(by).agg(F.count(x).alias("n"), moments.sharpe(x, periods).alias("sharpe"), moments.skewness(x).alias("skew"), moments.kurtosis(x).alias("kurt"))


def deflated(table: DataFrame, periods: float, trials: int) -> DataFrame:
    """table with psr (against zero), threshold, dsr and significant, for the best of so many trials."""
    sr, n = F.col("sharpe") / F.lit(periods**0.5), F.col("n").cast("double")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr
    threshold = F.lit(moments.expected_best(trials)) * F.sqrt(spread) / F.sqrt(n - 1)
    psr = lambda target: moments.probabilistic_sharpe(sr, target, n, F.col("skew"), F.col("kurt"))
    out = table.select("*", psr(F.lit(0.0)).alias("psr"), (threshold * F.lit(periods**0.5)).alias("threshold"), psr(threshold).alias("dsr"))
    return out.withColumn("significant", F.col("dsr") > 0.95)


def stationary_bootstrap(series: DataFrame, statistic: Callable, draws: int = 600, block: int = 21, seed: int = 7, level: float = 0.95, by: str = "series") -> DataFrame:
    """(series, draws, low, high): percentile interval of a statistic under resampled blocks of geometric length.

    Draws run apart: each has a seed of its own, and a series' values go to tasks as one array for each DRAWS of them. A
    series has one value a date, so an array is as long as the calendar.
    """
    import numpy as np
    import pandas as pd

    def draw(batches):
        for pdf in batches:
            out = []
            for name, begin, values in zip(pdf[by], pdf["draw"], pdf["values"], strict=True):
                x = np.asarray(values, float)
                for k in range(int(begin), min(int(begin) + DRAWS, draws + 1)):
                    rng, n = np.random.default_rng([seed, k]), len(x)
                    start, new = rng.integers(0, n, n), rng.random(n) < 1 / block
                    new[0] = True
                    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                    out.append((name, float(statistic(x[(start[first] + np.arange(n) - first) % n]))))
            yield pd.DataFrame(out, columns=[by, "s"])

    arrays = series.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "r"))), lambda v: v["r"]).alias("values"))
    tasks = arrays.select(by, "values", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAWS))).alias("draw"))
    s = tasks.repartition(by, "draw").mapInPandas(draw, f"{by} string, s double").filter("s IS NOT NULL AND NOT isnan(s)")
    tail = (1 - level) / 2
    return s.groupBy(by).agg(F.count("*").alias("draws"), F.percentile("s", tail).alias("low"), F.percentile("s", 1 - tail).alias("high")).filter(F.col("draws") >= draws / 2)
