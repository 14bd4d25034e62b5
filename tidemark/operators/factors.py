"""The factor panel: point-in-time features of each ticker and date, and statistics across tickers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.functions.windows import asof, average_rank, change, ffill, log_return, ordered, rolling
from tidemark.operators.inference import newey_west
from tidemark.storage import small, written

YEAR = 252.0


@dataclass(frozen=True)
class Lookbacks:
    """Rows that each feature looks back over; the defaults suit daily bars of several years."""

    long: int = 252
    skip: int = 21
    mid: int = 63
    mid_skip: int = 5
    short: int = 20
    slow: int = 60
    tail: int = 63
    tail_least: int = 21
    horizon: int = 21
    year: int = 252
    two_years: int = 504
    least_surprise: int = 120


#: For weekly bars of a few years, where a year of look-back would leave little to test on.
WEEKLY = Lookbacks(12, 1, 4, 1, 8, 16, 16, 6, 4, 52, 104, 26)
PRICE_FACTORS = ("momentum_12_1", "momentum_3m", "volatility_20d", "volatility_60d", "mean_reversion", "liquidity", "downside_ratio")
#: Reported quantities: flows add up over four quarters, levels are as last reported.
FLOWS = ("eps_diluted", "net_income", "revenue", "operating_income")
LEVELS = ("stockholders_equity", "total_assets", "total_liabilities", "shares_diluted")
FUNDAMENTAL_FACTORS = ("earnings_yield", "book_to_price", "return_on_equity", "operating_margin", "leverage", "asset_growth", "earnings_surprise")
MACRO_FACTORS = ("vix_percentile", "term_spread", "credit_spread")
ALL_FACTORS = (*PRICE_FACTORS, *FUNDAMENTAL_FACTORS, "sentiment_score", *MACRO_FACTORS)
#: Fixed weights of the composite score; those of factors that a panel has are used.
COMPOSITE = {
    "momentum_12_1": 0.30, "momentum_3m": 0.15, "earnings_yield": 0.20, "book_to_price": 0.10, "return_on_equity": 0.15,
    "operating_margin": 0.10, "mean_reversion": -0.10, "volatility_20d": -0.10, "leverage": -0.05,
}


def momentum(c: Column, back: int, skip: int, w) -> Column:
    return F.lag(c, skip).over(w) / F.lag(c, skip + back).over(w) - 1


def volatility(r: Column, n: int, w, year: float = YEAR) -> Column:
    return rolling(F.stddev_samp, r, n, w) * F.lit(year**0.5)


def price_factors(bars: DataFrame, b: Lookbacks = Lookbacks()) -> DataFrame:
    """ticker, date, close, ret_1d, the price factors and the label: one sort of each ticker's bars serves them all."""
    w = ordered()
    c = F.col("close")
    x = bars.select("ticker", "date", "close", "volume", log_return(c, w).alias("_r"))
    mean, dev = (rolling(f, c, b.short, w) for f in (F.avg, F.stddev_samp))
    down = F.when(F.col("_r") < 0, F.col("_r"))
    tail = lambda r: rolling(F.stddev_samp, r, b.tail, w, b.tail_least)
    return x.select(
        "ticker", "date", "close",
        change(c, w).alias("ret_1d"),
        momentum(c, b.long, b.skip, w).alias("momentum_12_1"),
        momentum(c, b.mid, b.mid_skip, w).alias("momentum_3m"),
        volatility(F.col("_r"), b.short, w).alias("volatility_20d"),
        volatility(F.col("_r"), b.slow, w).alias("volatility_60d"),
        ((c - mean) / F.nullif(dev, F.lit(0.0))).alias("mean_reversion"),
        F.ln(F.nullif(rolling(F.avg, F.col("volume") * c, b.short, w), F.lit(0.0))).alias("liquidity"),
        (tail(down) / F.nullif(tail(F.col("_r")), F.lit(0.0))).alias("downside_ratio"),
        (F.lead(c, b.horizon).over(w) / c - 1).alias("fwd_return"),
    )


def unpivoted(panel: DataFrame, factors: tuple[str, ...] = PRICE_FACTORS, keep: tuple[str, ...] = ("ticker", "date", "fwd_return")) -> DataFrame:
    """A row for each factor: `keep`, factor, x. All factors then go through one shuffle."""
    return panel.unpivot(list(keep), list(factors), "factor", "x")


def information_coefficients(long: DataFrame) -> DataFrame:
    """(factor, date, ic): rank correlation of factor and later return across tickers; four pairs at least."""
    pairs = long.filter("x IS NOT NULL AND fwd_return IS NOT NULL")
    by = ["factor", "date"]
    ranked = pairs.select(*by, average_rank(F.col("x"), by).alias("rx"), average_rank(F.col("fwd_return"), by).alias("ry"))
    ic = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), moments.correlation("rx", "ry")).alias("ic"))
    return ic.filter("n >= 4 AND ic IS NOT NULL").select(*by, "ic")


def ic_summary(ic: DataFrame) -> DataFrame:
    """Of each factor: dates, mean, deviation, ratio and share of positive coefficients; null below three dates."""
    enough = lambda x: F.when(F.count("*") >= 3, x)
    dev = F.stddev_samp("ic")
    return ic.groupBy("factor").agg(
        F.count("*").alias("n_dates"), enough(F.avg("ic")).alias("mean_ic"), enough(dev).alias("std_ic"),
        enough(F.avg("ic") / F.nullif(dev, F.lit(0.0))).alias("ic_ir"), enough(F.avg((F.round("ic", 12) > 0).cast("double"))).alias("hit_rate"),
    )


def cross_sectional_z(panel: DataFrame, factors: tuple[str, ...], clip: float | None = 3.0) -> DataFrame:
    """panel with z_<factor>: distance from the date's mean in its sample deviations, clipped."""
    w = Window.partitionBy("date")

    def z(f: str) -> Column:
        raw = (F.col(f) - F.avg(f).over(w)) / F.nullif(F.stddev_samp(f).over(w), F.lit(0.0))
        # greatest and least pass over nulls, which here must stay
        return F.when(raw.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), raw))) if clip else raw

    return panel.select("*", *[z(f).alias(f"z_{f}") for f in factors])


def composite_score(panel: DataFrame, weights: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """ticker, date, score: weighed sum of clipped z scores; null where one is."""
    weights = {f: w for f, w in (weights or COMPOSITE).items() if f in panel.columns}
    z = cross_sectional_z(panel, tuple(weights))
    total = sum((F.col(f"z_{f}") * w for f, w in weights.items()), F.lit(0.0))
    return z.select("ticker", "date", total.alias("score"), "fwd_return", "ret_1d", *keep)


def coverage(panel: DataFrame, factors: tuple[str, ...] = PRICE_FACTORS, least: float = 0.30) -> DataFrame:
    """(factor, coverage, varied, admitted): how many rows have it, the most values a ticker has, whether it may be used."""
    per = panel.groupBy("ticker").agg(F.count("*").alias("_n"), *[F.count(f).alias(f"n_{f}") for f in factors], *[F.count_distinct(f).alias(f"d_{f}") for f in factors])
    total = per.agg(F.sum("_n").alias("_n"), *[F.sum(f"n_{f}").alias(f"n_{f}") for f in factors], *[F.max(f"d_{f}").alias(f"d_{f}") for f in factors])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), (F.col(f"n_{f}") / F.col("_n")).alias("coverage"), F.col(f"d_{f}").alias("varied")) for f in factors]))
    out = total.select(each.alias("f")).select("f.*")
    return out.withColumn("admitted", (F.col("coverage") >= least) & (F.col("varied") > 1))


def pit_series(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with the value of the latest filing at or before its date; of one filing date the latest period counts."""
    per = facts.groupBy("ticker", "metric", "filed_date").agg(F.max_by("value", F.struct("period_end", "value")).alias("value"))
    return asof(grid, per, ["ticker", "metric"], "date", "filed_date", ["value"])


def as_of(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with the value of the latest period among all filings at or before its date, however old its filing."""
    keys = ["ticker", "metric"]
    per = facts.groupBy(*keys, "filed_date").agg(F.max(F.struct("period_end", "value")).alias("v"))
    run = Window.partitionBy(*keys).orderBy("filed_date").rowsBetween(Window.unboundedPreceding, 0)
    best = per.select(*keys, "filed_date", F.max("v").over(run).alias("v")).select(*keys, "filed_date", F.col("v.value").alias("value"), F.col("v.period_end").alias("period_end"))
    return asof(grid, best, keys, "date", "filed_date", ["value", "period_end"])


def first_reported(facts: DataFrame) -> DataFrame:
    """Of each metric and period, the first filing: later restatements weren't known then."""
    first = F.min(F.struct("filed_date", "accession", "value")).alias("f")
    return facts.groupBy("ticker", "metric", "period_end").agg(first).select("ticker", "metric", "period_end", "f.filed_date", "f.value")


def trailing_four(facts: DataFrame) -> DataFrame:
    """Sum of each filing and the three before it, by filing date; null before the fourth."""
    w = Window.partitionBy("ticker", "metric").orderBy("filed_date", "accession").rowsBetween(-3, 0)
    return facts.select("ticker", "metric", "filed_date", "accession", F.when(F.count("value").over(w) == 4, F.sum("value").over(w)).alias("ttm"))


def reported(facts: DataFrame) -> DataFrame:
    """(ticker, metric, period_end, filed_date, accession, value, form) of the first annual or quarterly report of each period."""
    first = F.min(F.struct("filed_date", "accession", "value", "form")).alias("f")
    return facts.filter(F.col("form").rlike("^10-[KQ]")).groupBy("ticker", "metric", "period_end").agg(first).select("ticker", "metric", "period_end", "f.*")


def known_quantities(facts: DataFrame) -> DataFrame:
    """(ticker, filed_date, the FLOWS and LEVELS known from that date on), from facts (ticker, metric, period_end, filed_date,
    accession, value, form).

    A flow is the sum of its last four quarterly reports, null before the fourth; one with fewer quarterly reports in all
    is its latest report's value. A level is that of the latest period among a filing date's reports.
    """
    rows = reported(facts).withColumn("quarterly", F.col("form").startswith("10-Q") & F.col("metric").isin(*FLOWS))
    order = F.struct("period_end", "accession")
    by_kind = Window.partitionBy("ticker", "metric", "quarterly")
    four = by_kind.orderBy("filed_date", "period_end", "accession").rowsBetween(-3, 0)
    rows = rows.withColumn("sum", F.when(F.count("value").over(four) == 4, F.sum("value").over(four))).withColumn("kind_rows", F.count("*").over(by_kind))
    quarters = F.max(F.when(F.col("quarterly"), F.col("kind_rows")).otherwise(0)).over(Window.partitionBy("ticker", "metric"))
    rows = rows.withColumn("quarters", quarters).filter("quarters < 4 OR quarterly")
    step = F.max_by(F.struct(F.when(F.col("quarters") < 4, F.col("value")).otherwise(F.col("sum")).alias("v")), order)
    steps = rows.groupBy("ticker", "metric", "filed_date").agg(step.alias("s"))
    names = (*FLOWS, *LEVELS)
    wide = steps.groupBy("ticker", "filed_date").agg(*[F.max(F.when(F.col("metric") == m, F.col("s.v"))).alias(m) for m in names])
    w = ordered("ticker", "filed_date")
    return wide.select("ticker", "filed_date", *[ffill(F.col(m), w).alias(m) for m in names])


def with_fundamentals(panel: DataFrame, facts: DataFrame, b: Lookbacks = Lookbacks()) -> DataFrame:
    """panel (ticker, date, close and others) with FUNDAMENTAL_FACTORS from what had been filed by each date; null where a divisor is 0."""
    names = (*FLOWS, *LEVELS)
    known = asof(panel, known_quantities(facts), ["ticker"], "date", "filed_date", list(names))
    w = ordered()
    over = lambda a, b: F.col(a) / F.nullif(b if isinstance(b, Column) else F.col(b), F.lit(0.0))
    yearly = F.col("eps_diluted") - F.lag("eps_diluted", b.year).over(w)
    spread = rolling(F.stddev_samp, F.col("eps_diluted"), b.two_years, w, b.least_surprise)
    return known.select(
        *panel.columns,
        over("eps_diluted", "close").alias("earnings_yield"),
        over("stockholders_equity", F.col("shares_diluted") * F.col("close")).alias("book_to_price"),
        over("net_income", "stockholders_equity").alias("return_on_equity"),
        over("operating_income", "revenue").alias("operating_margin"),
        over("total_liabilities", "total_assets").alias("leverage"),
        change(F.col("total_assets"), w, b.year).alias("asset_growth"),
        # A deviation of values that are all equal may differ from 0 by rounding.
        (yearly / F.when(spread > 1e-9 * F.abs("eps_diluted"), spread)).alias("earnings_surprise"),
    )


def full_panel(bars: DataFrame, facts: DataFrame, sentiment: DataFrame, macro: DataFrame, b: Lookbacks = Lookbacks()) -> DataFrame:
    """Price factors, fundamentals, sentiment and macro state of each ticker and date, with label and daily return.

    sentiment (ticker, known, sentiment_score) and macro (known, MACRO_FACTORS) hold from `known` on. Macro is one value for all
    names of a date, so it meets the few distinct dates. What isn't known yet is null.
    """
    rows = with_fundamentals(price_factors(bars, b), facts, b)
    rows = asof(rows, sentiment, ["ticker"], "date", "known", ["sentiment_score"])
    dates = bars.select("date").distinct().withColumn("_one", F.lit(1))  # the calendar and the series: a row a date
    state = asof(dates, macro.withColumn("_one", F.lit(1)), ["_one"], "date", "known", list(MACRO_FACTORS))
    return rows.join(small(state.drop("_one")), "date", "left").select("ticker", "date", "close", "ret_1d", *ALL_FACTORS, "fwd_return")


def fama_macbeth_univariate(long: DataFrame) -> DataFrame:
    """(factor, date, beta): slope of the later return on the standardised factor, date by date."""
    pairs = long.filter("x IS NOT NULL AND fwd_return IS NOT NULL")
    beta = F.when(F.min("x") < F.max("x"), F.covar_pop("x", "fwd_return") / F.nullif(F.stddev_pop("x"), F.lit(0.0)))
    return pairs.groupBy("factor", "date").agg(F.count("*").alias("n"), beta.alias("beta")).filter("n >= 4 AND beta IS NOT NULL").select("factor", "date", "beta")


def fama_macbeth_multivariate(panel: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """(date, factor, beta) of a joint regression on standardised factors, date by date.

    Covariances are summed in Spark, so a date brings one row to the solver, however many names it has. Dates with fewer
    than three names more than factors have no coefficients, nor has a factor on dates where all names have one value.
    """
    import numpy as np
    import pandas as pd

    k = len(factors)
    rows = panel.select("date", "fwd_return", *factors).na.drop()
    cov = [F.covar_pop(a, b) for a in factors for b in factors]
    varies = F.array(*[F.min(f) < F.max(f) for f in factors])
    sums = rows.groupBy("date").agg(F.count("*").alias("n"), F.array(*cov).alias("xx"), F.array(*[F.covar_pop(a, "fwd_return") for a in factors]).alias("xy"), varies.alias("varies")).filter(F.col("n") >= k + 3)

    def solve(batches):
        for pdf in batches:
            out = []
            for date, xx, xy, varies in zip(pdf["date"], pdf["xx"], pdf["xy"], pdf["varies"], strict=True):
                keep = np.flatnonzero(np.asarray(varies, bool))
                if len(keep):
                    c = np.array(xx).reshape(k, k)[np.ix_(keep, keep)]
                    dev = np.sqrt(np.diag(c))
                    beta = np.linalg.lstsq(c / np.outer(dev, dev), np.array(xy)[keep] / dev, rcond=None)[0]
                    out += [(date, factors[i], b) for i, b in zip(keep, beta, strict=True)]
            yield pd.DataFrame(out, columns=["date", "factor", "beta"])

    return sums.mapInPandas(solve, "date date, factor string, beta double")


def priced(betas: DataFrame, lags: int) -> DataFrame:
    """(factor, periods, premium, t_hac, p_hac, t_naive, inflation, significant, status) from (factor, date, beta): is a slope's mean
    over time other than zero? Standard errors allow for `lags` dates of overlap; factors with fewer than eight dates are not tested.
    """
    t = newey_west(betas.withColumnRenamed("beta", "r"), lags, by="factor")
    status = F.when(F.col("n") >= 8, "ok").otherwise("insufficient_periods")
    return t.select("factor", F.col("n").alias("periods"), F.col("mean").alias("premium"), "t_hac", "p_hac", "t_naive", "inflation", (F.col("p_hac") < 0.05).alias("significant"), status.alias("status"))


def fama_macbeth(panel: DataFrame, factors: tuple[str, ...], lags: int) -> DataFrame:
    """priced() for all factors, with mode, names and cross_sections: jointly where the panel has three names more than factors, else
    one by one, which doesn't control for the others. A factor without any coefficient has periods 0.
    """
    names = panel.agg(F.count_distinct("ticker")).first()[0]
    joint = names >= len(factors) + 3
    betas = fama_macbeth_multivariate(panel, factors) if joint else fama_macbeth_univariate(unpivoted(panel, factors))
    betas = written(betas.select("factor", "date", "beta"))
    dates = betas.agg(F.count_distinct("date").alias("cross_sections"))
    every = panel.sparkSession.createDataFrame([(f,) for f in factors], "factor string").join(F.broadcast(dates))
    out = every.join(priced(betas, lags), "factor", "left")
    filled = {"periods": F.coalesce("periods", F.lit(0)), "status": F.coalesce("status", F.lit("insufficient_periods")), "mode": F.lit("multivariate" if joint else "univariate"), "names": F.lit(names)}
    return out.withColumns(filled)
