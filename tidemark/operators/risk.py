"""Tail, market, factor and concentration risk of return series and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import moments

#: Fixed market shocks of the scenario table.
SHOCKS = {"gfc_2008_q4": -0.2260, "covid_crash_2020": -0.3390, "rates_shock_2022": -0.2520, "vol_spike_2018q4": -0.1400}


def tail_risk(series: DataFrame, p: float = 0.05) -> DataFrame:
    """(series, n, var_hist, var_normal, var_cornish, cvar), as positive losses at one level."""
    z = moments.normal_ppf(p)
    r = F.col("r")
    m = series.groupBy("series").agg(F.count(r).alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), moments.skewness(r).alias("s"), moments.kurtosis(r).alias("k"), F.percentile(r, F.lit(p)).alias("q"))
    s, k = F.col("s"), F.col("k")
    zc = z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    tail = series.join(m.select("series", "q"), "series").filter("r <= q").groupBy("series").agg((-F.avg("r")).alias("cvar"))
    out = m.select("series", "n", (-F.col("q")).alias("var_hist"), (-(F.col("mu") + z * F.col("sd"))).alias("var_normal"), (-(F.col("mu") + zc * F.col("sd"))).alias("var_cornish"))
    return out.join(tail, "series")


def market_exposure(series: DataFrame, benchmark: DataFrame, year: float) -> DataFrame:
    """(series, n, beta, alpha, r2, information_ratio) against `b` of the common dates; twenty at least."""
    j = series.join(benchmark, "date")
    active = F.col("r") - F.col("b")
    slope = F.covar_pop("r", "b") / F.nullif(F.var_pop("b"), F.lit(0.0))
    m = j.groupBy("series").agg(
        F.count("*").alias("n"), slope.alias("beta"), ((F.avg("r") - slope * F.avg("b")) * F.lit(year)).alias("alpha"), F.pow(moments.correlation("r", "b"), F.lit(2.0)).alias("r2"),
        (F.avg(active) / F.nullif(F.stddev_samp(active), F.lit(0.0)) * F.lit(year**0.5)).alias("information_ratio"),
    )
    return m.filter("n >= 20")


def factor_mimicking(long: DataFrame) -> DataFrame:
    """(factor, date, ret): return of the names in the top third of yesterday's factor less those in the bottom third.

    `long` holds factor, ticker, date, x and ret; rows without either are dropped before the lag.
    """
    w = Window.partitionBy("factor", "ticker").orderBy("date")
    day = Window.partitionBy("factor", "date")
    x = long.filter("x IS NOT NULL AND ret IS NOT NULL").withColumn("s", F.lag("x").over(w)).filter("s IS NOT NULL")
    q = x.select("factor", "date", "ret", "s", F.percentile("s", F.lit(0.67)).over(day).alias("hi"), F.percentile("s", F.lit(0.33)).over(day).alias("lo"), F.count("*").over(day).alias("n"))
    legs = q.filter("n >= 4").groupBy("factor", "date").agg((F.avg(F.when(F.col("s") >= F.col("hi"), F.col("ret"))) - F.avg(F.when(F.col("s") <= F.col("lo"), F.col("ret")))).alias("ret"))
    return legs.filter("ret IS NOT NULL").withColumn("k", F.count("*").over(Window.partitionBy("factor"))).filter("k > 20").drop("k")


def factor_shares(series: DataFrame, mimicking: DataFrame, factors: list[str]) -> DataFrame:
    """(series, factor, beta, share, r2): joint regression on factor returns. Cross products are summed in Spark, so each
    series brings one row of sums to the solver.
    """
    import numpy as np
    import pandas as pd

    k = len(factors)
    wide = mimicking.filter(F.col("factor").isin(factors)).groupBy("date").pivot("factor", factors).agg(F.max("ret")).na.drop()
    j = series.join(wide, "date").withColumn("_1", F.lit(1.0))
    names = ["_1", *factors]
    sums = j.groupBy("series").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col("r")) for a in names]).alias("xy"), F.sum(F.col("r") * F.col("r")).alias("yy"), F.sum("r").alias("y"),
    ).filter("n >= 40")

    def solve(batches):
        for pdf in batches:
            out = []
            for s, n, xx, xy, yy, y in zip(pdf["series"], pdf["n"], pdf["xx"], pdf["xy"], pdf["yy"], pdf["y"], strict=True):
                a, b = np.array(xx).reshape(k + 1, k + 1), np.array(xy)
                beta = np.linalg.lstsq(a, b, rcond=None)[0]
                total = yy - y * y / n
                cov = b[1:] - a[0, 1:] * y / n
                r2 = 1 - (yy - 2 * beta @ b + beta @ a @ beta) / total
                out += [(s, f, beta[i + 1], beta[i + 1] * cov[i] / total, r2) for i, f in enumerate(factors)]
            yield pd.DataFrame(out, columns=["series", "factor", "beta", "share", "r2"])

    return sums.mapInPandas(solve, "series string, factor string, beta double, share double, r2 double")


def scenarios(series: DataFrame, exposure: DataFrame) -> DataFrame:
    """(series, scenario, loss): moves of two and three deviations, the worst date and five dates, beta times fixed shocks."""
    w = Window.partitionBy("series").orderBy("date").rowsBetween(-4, 0)
    five = series.withColumn("_5", F.when(F.count("r").over(w) == 5, F.sum("r").over(w)))
    m = five.groupBy("series").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.min("r").alias("worst"), F.min("_5").alias("worst5"))
    m = m.join(exposure.select("series", "beta"), "series", "left")
    rows = [("two_sigma", F.col("mu") - 2 * F.col("sd")), ("three_sigma", F.col("mu") - 3 * F.col("sd")), ("worst_date", F.col("worst")), ("worst_five", F.col("worst5")), *((k, F.col("beta") * v) for k, v in SHOCKS.items())]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), v.alias("loss")) for k, v in rows]))
    return m.select("series", each.alias("s")).select("series", "s.*")


def concentration(book: DataFrame, aum: float = 1e7, participation: float = 0.2) -> DataFrame:
    """(strategy, names, gross, net, largest, hhi, effective_names, days_to_liquidate, concentrated, illiquid) of weights with
    each name's volume; days are those of the slowest name.
    """
    w = F.col("w")
    g = book.groupBy("strategy").agg(
        F.count("*").alias("names"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.sum(w * w).alias("_ww"), F.max(F.abs(w)).alias("largest"),
        F.max(F.abs(w) * aum / F.nullif(participation * F.col("adv"), F.lit(0.0))).alias("days_to_liquidate"),
    )
    hhi = F.col("_ww") / F.nullif(F.col("gross") * F.col("gross"), F.lit(0.0))
    out = g.select("strategy", "names", "gross", "net", "largest", hhi.alias("hhi"), (1 / F.nullif(hhi, F.lit(0.0))).alias("effective_names"), "days_to_liquidate")
    return out.withColumns({"concentrated": F.coalesce(F.col("hhi") > 0.25, F.lit(False)), "illiquid": F.coalesce("days_to_liquidate", F.lit(0.0)) > 3})
