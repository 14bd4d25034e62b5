"""Cost-aware long/short backtests as windows: all strategies run in one job, keyed by `strategy`.

Nothing is simulated day by day. Between rebalances a weight drifts as w0 G / sum |w0 G|, where G is the growth since the
rebalance, so positions, costs and returns are joins and window sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.functions.windows import asof
from tidemark.storage import small, written

#: Fixed values of the cost model and of the portfolio's shape.
LEG, SPREAD_COST, IMPACT, AUM, BORROW = 0.30, 0.0003, 1.0, 1e7, 0.005

#: What is left of a book that loses all or more in a date, so that its growth stays a number.
RUIN = 1e-9


def form_weights(signals: DataFrame) -> DataFrame:
    """(strategy, date, ticker, w): the top and bottom 30 % of names (half-even), equal weights, gross 1, net 0.

    Legs that would overlap give no weights. Equal scores are ordered by ticker.
    """
    by = Window.partitionBy("strategy", "date")
    k = F.greatest(F.lit(1), F.bround(F.col("n") * 0.3).cast("int"))
    ranked = signals.filter("score IS NOT NULL").select(
        "strategy", "date", "ticker", F.count("*").over(by).alias("n"),
        F.row_number().over(by.orderBy(F.desc("score"), "ticker")).alias("hi"), F.row_number().over(by.orderBy("score", F.desc("ticker"))).alias("lo"),
    ).withColumn("k", k)
    side = F.when(F.col("hi") <= F.col("k"), 1.0).when(F.col("lo") <= F.col("k"), -1.0)
    return ranked.filter("2 * k <= n").select("strategy", "date", "ticker", (side / (2 * F.col("k"))).alias("w")).filter("w IS NOT NULL")


def schedule(weights: DataFrame, dates: DataFrame, every: int, lag: int = 0) -> DataFrame:
    """(strategy, date, i, h, rebalanced, signal_date) of the trading dates from a strategy's first signal on.

    h numbers holding periods of `every` dates. A period holds the latest signal at or before its first date; with lag 1,
    before it, which a trader could act on.
    """
    signal = weights.select("strategy", F.col("date").alias("signal_date")).distinct()
    first = signal.groupBy("strategy").agg(F.min("signal_date").alias("first"))
    late = F.col("date") >= F.col("first") if not lag else F.col("date") > F.col("first")
    days = dates.select("date").distinct().join(small(written(first)), late).select("strategy", "date")
    i = F.row_number().over(Window.partitionBy("strategy").orderBy("date")) - 1
    days = days.withColumn("i", i.cast("long")).withColumn("h", F.floor(F.col("i") / every).cast("long"))
    starts = days.filter(F.col("i") % every == 0).select("strategy", "h", "date", F.date_sub("date", lag).alias("until"))
    held = asof(starts, signal, ["strategy"], "until", "signal_date", ["signal_date"]).select("strategy", "h", "signal_date")
    return days.join(held, ["strategy", "h"]).select("strategy", "date", "i", "h", (F.col("i") % every == 0).alias("rebalanced"), "signal_date")


def positions(weights: DataFrame, days: DataFrame, returns: DataFrame) -> DataFrame:
    """(strategy, date, h, ticker, w, ret, w_end): weights before and after each date's return; a missing return is 0."""
    target = weights.select("strategy", F.col("date").alias("signal_date"), "ticker", F.col("w").alias("w0"))
    p = days.join(target, ["strategy", "signal_date"]).join(returns.select("ticker", "date", "ret"), ["ticker", "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    path = Window.partitionBy("strategy", "h", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_a", F.col("w0") * F.exp(F.coalesce(F.sum(F.ln(1 + F.col("ret"))).over(path), F.lit(0.0))))
    book = Window.partitionBy("strategy", "date")
    p = p.withColumn("w", F.col("_a") / F.sum(F.abs("_a")).over(book))
    grown = F.col("w") * (1 + F.col("ret"))
    return p.withColumn("w_end", grown / F.sum(F.abs(grown)).over(book)).select("strategy", "date", "i", "h", "rebalanced", "ticker", "w0", "w", "ret", "w_end")


def trade_cost(change: Column, vol: Column, adv: Column) -> Column:
    """Spread plus square-root impact of trading `change` of the book; without volatility or volume no impact."""
    part = F.least(F.abs(change) * AUM / F.nullif(adv, F.lit(0.0)), F.lit(1.0))
    return F.abs(change) * SPREAD_COST + F.coalesce(F.abs(change) * IMPACT * vol * F.sqrt(part), F.lit(0.0))


def rebalance_costs(pos: DataFrame, liquidity: DataFrame) -> DataFrame:
    """(strategy, h, turnover, cost): from the drifted book of the period before to the new one, name by name."""
    last = Window.partitionBy("strategy", "h")
    old = pos.withColumn("_last", F.max("date").over(last)).filter("date = _last").select("strategy", (F.col("h") + 1).alias("h"), "ticker", F.col("w_end").alias("old"))
    new = pos.filter("rebalanced").select("strategy", "h", "ticker", F.col("w0").alias("new"))
    days = pos.filter("rebalanced").select("strategy", "h", "date").distinct()
    both = new.join(old, ["strategy", "h", "ticker"], "full").join(days, ["strategy", "h"])
    delta = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    priced = both.withColumn("delta", delta).join(liquidity.select("ticker", "date", "vol", "adv"), ["ticker", "date"], "left")
    return priced.groupBy("strategy", "h").agg(F.sum(F.abs("delta")).alias("turnover"), F.sum(trade_cost(F.col("delta"), F.col("vol"), F.col("adv"))).alias("cost"))


def daily_pnl(pos: DataFrame, costs: DataFrame, year: float) -> DataFrame:
    """(strategy, date, gross, cost, borrow, net); costs fall on the rebalance date, borrow on short notional each date."""
    day = pos.groupBy("strategy", "date", "h", "rebalanced").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"), (F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)) * BORROW / F.lit(year)).alias("borrow"))
    j = day.join(costs, ["strategy", "h"], "left")
    cost = F.when(F.col("rebalanced"), F.coalesce("cost", F.lit(0.0))).otherwise(0.0)
    return j.select("strategy", "date", "gross", cost.alias("cost"), "borrow", (F.col("gross") - cost - F.col("borrow")).alias("net"), F.when(F.col("rebalanced"), F.col("turnover")).alias("turnover"))


def run(signals: DataFrame, returns: DataFrame, liquidity: DataFrame, every: int, year: float, lag: int = 0) -> DataFrame:
    """Daily results of all strategies. Several joins read the weights and the positions, so these are tables in the shared
    folder, as the results are: what is built on them plans scans, not the backtest again.
    """
    weights = written(form_weights(signals))
    pos = written(positions(weights, schedule(weights, returns, every, lag), returns))
    return written(daily_pnl(pos, rebalance_costs(pos, liquidity), year))


def metrics(pnl: DataFrame, year: float) -> DataFrame:
    """Of each strategy: dates, growth a year, volatility, Sharpe, Sortino, drawdown, Calmar, hit rate, moments, turnover."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.ln(F.greatest(1 + F.col("net"), F.lit(RUIN)))
    eq = pnl.withColumn("_log", F.sum(growth).over(w)).withColumn("_equity", F.exp("_log"))
    eq = eq.withColumn("_dd", F.col("_equity") / F.greatest(F.lit(1.0), F.max("_equity").over(w)) - 1)
    r, n, root = F.col("net"), F.count("*"), F.lit(year**0.5)
    m = eq.groupBy("strategy").agg(
        n.alias("n"), (F.exp(F.sum(growth) * F.lit(year) / n) - 1).alias("cagr"), (F.stddev_samp(r) * root).alias("vol"), moments.sharpe(r, year).alias("sharpe"),
        (F.avg(r) / F.nullif(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)) * root).alias("sortino"), F.min("_dd").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), moments.skewness(r).alias("skew"), moments.kurtosis(r).alias("kurt"), F.avg("turnover").alias("turnover"),
        ((F.avg(r) + F.avg("cost")) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * root).alias("gross_sharpe"),
    )
    return m.withColumn("calmar", F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))


def ranked(table: DataFrame) -> DataFrame:
    """By Sharpe ratio; a missing one, or one of exactly zero, comes last."""
    key = F.when(F.col("sharpe").isNull() | (F.col("sharpe") == 0), -99.0).otherwise(F.col("sharpe"))
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc(key), "strategy")))
