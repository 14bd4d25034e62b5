"""Queries of backtests, risk and allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.operators import backtest as bt
from tidemark.operators import factors as fx
from tidemark.operators import inference, portfolio, risk
from tidemark.plans import ctes
from tidemark.plans.ctes import WALK, WEEKLY, r6, rounded
from tidemark.plans.registry import query
from tidemark.sources import market
from tidemark.storage import written

EVERY, YEAR = 4, 52.0


def _panel(spark, d):
    return fx.price_factors(market.bars_walk(spark, d), fx.WEEKLY)


def _signals(panel):
    """Three strategies' scores, unpivoted from one panel."""
    s = fx.composite_score(panel, keep=("momentum_12_1", "mean_reversion"))
    wide = s.select("ticker", "date", F.col("score").alias("composite"), F.col("momentum_12_1").alias("momentum"), (-F.col("mean_reversion")).alias("reversal"))
    long = wide.unpivot(["ticker", "date"], ["composite", "momentum", "reversal"], "strategy", "score")
    return long.select("strategy", "ticker", "date", F.round("score", 9).alias("score")).filter("score IS NOT NULL")


def _liquidity(panel):
    return panel.select("ticker", "date", F.col("volatility_20d").alias("vol"), F.exp("liquidity").alias("adv"))


def _returns(panel):
    return panel.select("ticker", "date", F.col("ret_1d").alias("ret")).filter("ret IS NOT NULL")


def _weights(spark, d):
    return bt.form_weights(_signals(_panel(spark, d)))


def _pnl(spark, d, lag=0):
    """Signals, returns and liquidity come from one stored panel."""
    p = written(_panel(spark, d))
    return bt.run(_signals(p), _returns(p), _liquidity(p), EVERY, YEAR, lag)


def _weights_sql() -> str:
    return f"""{WEEKLY}, {ctes.SCORE}, sig AS (
  SELECT * FROM (SELECT 'composite' AS strategy, ticker, date, round(score, 9) AS score FROM score UNION ALL SELECT 'momentum', ticker, date, round(momentum_12_1, 9) FROM panel
  UNION ALL SELECT 'reversal', ticker, date, round(-mean_reversion, 9) FROM panel) WHERE score IS NOT NULL),
rk AS (SELECT *, count(*) OVER (PARTITION BY strategy, date) AS n, row_number() OVER (PARTITION BY strategy, date ORDER BY score DESC, ticker) AS hi, row_number() OVER (PARTITION BY strategy, date ORDER BY score, ticker DESC) AS lo FROM sig),
kk AS (SELECT *, CAST(greatest(1, round_even(n * 0.3::DOUBLE, 0)) AS INTEGER) AS k FROM rk),
wts AS (SELECT strategy, date, ticker, CASE WHEN hi <= k THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / (2 * k) AS w FROM kk WHERE 2 * k <= n AND (hi <= k OR lo <= k))"""


def _pnl_sql(lag: int = 0) -> str:
    return f"""{_weights_sql()},
first AS (SELECT strategy, min(date) AS f FROM wts GROUP BY strategy),
td AS (SELECT strategy, date, i, i // {EVERY} AS h, i % {EVERY} = 0 AS rebalanced FROM (SELECT strategy, date, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i FROM first JOIN (SELECT DISTINCT date FROM rets) ON date {'>' if lag else '>='} f)),
sd AS (SELECT DISTINCT strategy, date AS signal_date FROM wts),
rb AS (SELECT td.strategy, h, signal_date FROM (SELECT *, date - {lag} AS until FROM td WHERE rebalanced) td ASOF JOIN sd ON td.strategy = sd.strategy AND td.until >= sd.signal_date),
sched AS (SELECT td.*, signal_date FROM td JOIN rb USING (strategy, h)),
p0 AS (SELECT s.strategy, s.date, i, h, rebalanced, w.ticker, w.w AS w0, coalesce(r.ret, 0) AS ret FROM sched s JOIN wts w ON w.strategy = s.strategy AND w.date = s.signal_date LEFT JOIN rets r ON r.ticker = w.ticker AND r.date = s.date),
p1 AS (SELECT *, w0 * exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY strategy, h, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a FROM p0),
p2 AS (SELECT *, a / sum(abs(a)) OVER (PARTITION BY strategy, date) AS w FROM p1),
pos AS (SELECT *, w * (1 + ret) / sum(abs(w * (1 + ret))) OVER (PARTITION BY strategy, date) AS w_end FROM p2),
old AS (SELECT strategy, h + 1 AS h, ticker, w_end AS old FROM (SELECT *, max(date) OVER (PARTITION BY strategy, h) AS m FROM pos) WHERE date = m),
new AS (SELECT strategy, h, ticker, w0 AS new FROM pos WHERE rebalanced),
delta AS (SELECT strategy, h, ticker, coalesce(new, 0) - coalesce(old, 0) AS d FROM new FULL JOIN old USING (strategy, h, ticker)),
costs AS (SELECT x.strategy, x.h, sum(abs(d)) AS turnover, sum(abs(d) * 0.0003::DOUBLE + coalesce(abs(d) * volatility_20d * sqrt(CASE WHEN liquidity IS NOT NULL THEN least(abs(d) * 1e7 / nullif(exp(liquidity), 0), 1.0::DOUBLE) END), 0)) AS cost
  FROM delta x JOIN td ON td.strategy = x.strategy AND td.h = x.h AND td.rebalanced LEFT JOIN panel p ON p.ticker = x.ticker AND p.date = td.date GROUP BY 1, 2),
day AS (SELECT strategy, date, h, rebalanced, sum(w * ret) AS gross, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) * 0.005::DOUBLE / 52.0::DOUBLE AS borrow FROM pos GROUP BY ALL),
pnl AS (SELECT strategy, date, gross, CASE WHEN rebalanced THEN coalesce(cost, 0) ELSE 0.0::DOUBLE END AS cost, borrow, gross - CASE WHEN rebalanced THEN coalesce(cost, 0) ELSE 0 END - borrow AS net, CASE WHEN rebalanced THEN turnover END AS turnover FROM day LEFT JOIN costs USING (strategy, h))"""


@query(f"WITH {_weights_sql()} SELECT strategy, date, ticker, {r6('w')} FROM wts")
def form_weights(spark, d):
    return rounded(_weights(spark, d))


@query(f"WITH {_pnl_sql()} SELECT strategy, date, i, h, rebalanced, signal_date FROM sched")
def rebalance_schedule(spark, d):
    p = written(_panel(spark, d))
    return bt.schedule(written(bt.form_weights(_signals(p))), _returns(p), EVERY)


def _positions(panel):
    w, r = written(bt.form_weights(_signals(panel))), _returns(panel)
    return bt.positions(w, bt.schedule(w, r, EVERY), r)


@query(f"WITH {_pnl_sql()} SELECT strategy, date, ticker, {r6('w, ret, w_end')} FROM pos")
def drift_weights(spark, d):
    return rounded(_positions(written(_panel(spark, d))).select("strategy", "date", "ticker", "w", "ret", "w_end"))


@query(f"WITH {_pnl_sql()} SELECT strategy, h, {r6('turnover, cost')} FROM costs")
def transaction_cost(spark, d):
    p = written(_panel(spark, d))
    return rounded(bt.rebalance_costs(written(_positions(p)), _liquidity(p)))


@query(f"WITH {_pnl_sql()} SELECT strategy, date, {r6('gross, cost, borrow, net')} FROM pnl")
def daily_pnl(spark, d):
    """Signals act on the date that they are known."""
    return rounded(_pnl(spark, d).drop("turnover"))


@query(f"WITH {_pnl_sql(1)} SELECT strategy, date, {r6('gross, cost, borrow, net')} FROM pnl")
def daily_pnl_lagged(spark, d):
    """Signals act a date later, as a trader could."""
    return rounded(_pnl(spark, d, 1).drop("turnover"))


_METRICS = """eq AS (SELECT *, exp(sum(ln(greatest(1 + net, 1e-9::DOUBLE))) OVER w) AS equity FROM pnl WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, equity / greatest(1.0::DOUBLE, max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM eq),
met AS (SELECT strategy, count(*) AS n, exp(sum(ln(greatest(1 + net, 1e-9::DOUBLE))) * 52.0::DOUBLE / count(*)) - 1 AS cagr, stddev_samp(net) * sqrt(52.0::DOUBLE) AS vol, avg(net) / stddev_samp(net) * sqrt(52.0::DOUBLE) AS sharpe,
  avg(net) / nullif(stddev_samp(net) FILTER (net < 0), 0) * sqrt(52.0::DOUBLE) AS sortino, min(dd) AS max_drawdown, avg(CAST(net > 0 AS INT)) AS hit_rate, skewness(net) AS skew, kurtosis(net) AS kurt, avg(turnover) AS turnover,
  (avg(net) + avg(cost)) / nullif(stddev_samp(net), 0) * sqrt(52.0::DOUBLE) AS gross_sharpe FROM dd GROUP BY strategy)"""


@query(f"WITH {_pnl_sql()}, {_METRICS} SELECT strategy, n, {r6('cagr, vol, sharpe, sortino, max_drawdown, hit_rate, skew, kurt, turnover, gross_sharpe')}, round(cagr / nullif(abs(max_drawdown), 0), 6) + 0.0::DOUBLE AS calmar FROM met")
def backtest_metrics(spark, d):
    return rounded(bt.metrics(_pnl(spark, d), YEAR))


@query(f"WITH {_pnl_sql(1)}, {_METRICS} SELECT strategy, {r6('cagr, sharpe, max_drawdown')}, CAST(row_number() OVER (ORDER BY CASE WHEN sharpe IS NULL OR sharpe = 0 THEN -99 ELSE sharpe END DESC, strategy) AS INTEGER) AS place FROM met")
def strategy_comparison(spark, d):
    return rounded(bt.ranked(bt.metrics(_pnl(spark, d, 1), YEAR)).select("strategy", "cagr", "sharpe", "max_drawdown", "place"))


_SERIES = "series AS (SELECT strategy AS series, date, net AS r FROM pnl)"


def _series(spark, d):
    return _pnl(spark, d).select(F.col("strategy").alias("series"), "date", F.col("net").alias("r"))


_Z, _Z99 = moments.normal_ppf(0.05), moments.normal_ppf(0.01)


def _tail_sql(z: float, p: float) -> str:
    return f"""tm AS (SELECT series, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, skewness(r) AS s, kurtosis(r) AS k, quantile_cont(r, {p}) AS q FROM series GROUP BY series),
tz AS (SELECT *, {z!r}::DOUBLE + {z**2 - 1!r}::DOUBLE * s / 6 + {z**3 - 3 * z!r}::DOUBLE * k / 24 - {2 * z**3 - 5 * z!r}::DOUBLE * s * s / 36 AS zc FROM tm),
cv AS (SELECT series.series, -avg(r) AS cvar FROM series JOIN tm ON series.series = tm.series AND r <= q GROUP BY 1)"""


_TAIL = _tail_sql(_Z, 0.05)


@query(f"WITH {_pnl_sql()}, {_SERIES}, {_TAIL} SELECT series, n, round(-q, 6) + 0.0::DOUBLE AS var_hist, round(-(mu + {_Z!r}::DOUBLE * sd), 6) + 0.0::DOUBLE AS var_normal, {r6('cvar')} FROM tz JOIN cv USING (series)")
def var_cvar(spark, d):
    return rounded(risk.tail_risk(_series(spark, d)).drop("var_cornish"))


@query(f"WITH {_pnl_sql()}, {_SERIES}, {_tail_sql(_Z99, 0.01)} SELECT series, n, round(-q, 6) + 0.0::DOUBLE AS var_hist, round(-(mu + {_Z99!r}::DOUBLE * sd), 6) + 0.0::DOUBLE AS var_normal, round(-(mu + zc * sd), 6) + 0.0::DOUBLE AS var_cornish, {r6('cvar')} FROM tz JOIN cv USING (series)")
def tail_99(spark, d):
    """Losses at 99 % by all four measures."""
    return rounded(risk.tail_risk(_series(spark, d), 0.01))


@query(f"WITH {_pnl_sql()}, {_SERIES}, {_TAIL} SELECT series, round(-(mu + zc * sd), 6) + 0.0::DOUBLE AS var_cornish FROM tz")
def cornish_fisher_var(spark, d):
    return rounded(risk.tail_risk(_series(spark, d)).select("series", "var_cornish"))


def _benchmark(spark, d):
    return market.returns(spark, d).groupBy("date").agg(F.avg("ret").alias("b"))


_BETA = """bm AS (SELECT date, avg(ret) AS b FROM rets GROUP BY date),
beta AS (SELECT series, count(*) AS n, regr_slope(r, b) AS beta, regr_intercept(r, b) * 52.0::DOUBLE AS alpha, regr_r2(r, b) AS r2, avg(r - b) / nullif(stddev_samp(r - b), 0) * sqrt(52.0::DOUBLE) AS information_ratio
  FROM series JOIN bm USING (date) GROUP BY series HAVING count(*) >= 20)"""


@query(f"WITH {_pnl_sql()}, {_SERIES}, {_BETA} SELECT series, n, {r6('beta, alpha, r2, information_ratio')} FROM beta")
def beta_alpha(spark, d):
    return rounded(risk.market_exposure(_series(spark, d), _benchmark(spark, d), YEAR))


@query(
    f"WITH {_pnl_sql()}, {_SERIES}, {_BETA}, f5 AS (SELECT *, CASE WHEN count(r) OVER w = 5 THEN sum(r) OVER w END AS s5 FROM series WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), sm AS (SELECT series, avg(r) AS mu, stddev_samp(r) AS sd, min(r) AS worst, min(s5) AS worst5 FROM f5 GROUP BY series), j AS (SELECT sm.*, beta FROM sm LEFT JOIN beta USING (series)), x AS (SELECT series, 'two_sigma' AS scenario, mu - 2 * sd AS loss FROM j UNION ALL SELECT series, 'three_sigma', mu - 3 * sd FROM j UNION ALL SELECT series, 'worst_date', worst FROM j UNION ALL SELECT series, 'worst_five', worst5 FROM j"
    + "".join(f" UNION ALL SELECT series, '{k}', beta * {v}::DOUBLE FROM j" for k, v in risk.SHOCKS.items())
    + f") SELECT series, scenario, {r6('loss')} FROM x"
)
def scenarios(spark, d):
    s = _series(spark, d)
    return rounded(risk.scenarios(s, risk.market_exposure(s, _benchmark(spark, d), YEAR)))


_FMP = f"""{ctes.LONG.replace("fwd_return, ", "ret_1d AS ret, ")}, lg AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY factor, ticker ORDER BY date) AS s FROM long WHERE x IS NOT NULL AND ret IS NOT NULL) WHERE s IS NOT NULL),
q AS (SELECT factor, date, quantile_cont(s, 0.67) AS hi, quantile_cont(s, 0.33) AS lo FROM lg GROUP BY factor, date HAVING count(*) >= 4),
legs AS (SELECT factor, date, avg(ret) FILTER (s >= hi) - avg(ret) FILTER (s <= lo) AS fr FROM lg JOIN q USING (factor, date) GROUP BY factor, date),
fmp AS (SELECT factor, date, fr FROM legs WHERE fr IS NOT NULL QUALIFY count(*) OVER (PARTITION BY factor) > 20)"""


def _mimicking(spark, d):
    return risk.factor_mimicking(fx.unpivoted(_panel(spark, d), keep=("ticker", "date", "ret_1d")).withColumnRenamed("ret_1d", "ret"))


@query(f"WITH {WEEKLY}, {_FMP} SELECT factor, date, round(fr, 6) + 0.0::DOUBLE AS ret FROM fmp")
def factor_mimicking(spark, d):
    return rounded(_mimicking(spark, d))


@query()
def factor_risk(spark, d):
    """Shares of each strategy's variance that four factors carry, from one joint regression."""
    return rounded(risk.factor_shares(_series(spark, d), _mimicking(spark, d), ["momentum_12_1", "volatility_20d", "mean_reversion", "liquidity"]))


_BOOK = """lastd AS (SELECT strategy, max(date) AS m FROM wts GROUP BY strategy), adv AS (SELECT ticker, max_by(exp(liquidity), date) AS adv FROM panel WHERE liquidity IS NOT NULL GROUP BY ticker),
book AS (SELECT w.strategy, w.ticker, w.w, adv FROM wts w JOIN lastd l ON l.strategy = w.strategy AND l.m = w.date LEFT JOIN adv ON adv.ticker = w.ticker),
cn AS (SELECT strategy, count(*) AS names, sum(abs(w)) AS gross, sum(w) AS net, sum(w * w) AS ww, max(abs(w)) AS largest, max(abs(w) * 1e7 / nullif(0.2::DOUBLE * adv, 0)) AS days_to_liquidate FROM book GROUP BY strategy)"""


@query(f"""WITH {_weights_sql()}, {_BOOK} SELECT strategy, names, {r6('gross, net, largest')}, round(ww / (gross * gross), 6) + 0.0::DOUBLE AS hhi, round(gross * gross / ww, 6) + 0.0::DOUBLE AS effective_names, round(days_to_liquidate, 4) + 0.0::DOUBLE AS days_to_liquidate,
  ww / (gross * gross) > 0.25 AS concentrated, coalesce(days_to_liquidate, 0) > 3 AS illiquid FROM cn""")
def concentration(spark, d):
    p = written(_panel(spark, d))
    w = written(bt.form_weights(_signals(p)))
    last = w.groupBy("strategy").agg(F.max("date").alias("date"))
    out = risk.concentration(w.join(last, ["strategy", "date"]).join(_last_adv(p), "ticker", "left"))
    return rounded(out.withColumn("days_to_liquidate", F.round("days_to_liquidate", 4)))


def _last_adv(panel):
    return panel.filter("liquidity IS NOT NULL").groupBy("ticker").agg(F.max_by(F.exp("liquidity"), "date").alias("adv"))


@query(f"WITH {WEEKLY} SELECT ticker, round(max_by(exp(liquidity), date), 4) + 0.0::DOUBLE AS adv FROM panel WHERE liquidity IS NOT NULL GROUP BY ticker")
def last_adv(spark, d):
    return rounded(_last_adv(_panel(spark, d)), 4)


@query(f"""WITH {_pnl_sql()}, {_SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k, count(*) OVER (PARTITION BY series) AS n FROM series),
h AS (SELECT series, n, avg(r) FILTER (k <= n // 2) / stddev_samp(r) FILTER (k <= n // 2) * sqrt(52.0::DOUBLE) AS first, avg(r) FILTER (k > n // 2) / stddev_samp(r) FILTER (k > n // 2) * sqrt(52.0::DOUBLE) AS second FROM k WHERE n >= 120 GROUP BY series, n)
SELECT series, n, round(first, 6) + 0.0::DOUBLE AS first_half, round(second, 6) + 0.0::DOUBLE AS second_half, sign(first) <> sign(second) AS regime_dependent FROM h""")
def regime_split(spark, d):
    """Does the Sharpe ratio change its sign between the halves?"""
    by = Window.partitionBy("series")
    k = _series(spark, d).select("series", "r", F.row_number().over(by.orderBy("date")).alias("k"), F.count("*").over(by).alias("n")).filter("n >= 120")
    half = lambda first: moments.sharpe(F.when((F.col("k") <= F.floor(F.col("n") / 2)) == F.lit(first), F.col("r")), YEAR)
    h = k.groupBy("series", "n").agg(half(True).alias("first_half"), half(False).alias("second_half"))
    return rounded(h.withColumn("regime_dependent", F.signum("first_half") != F.signum("second_half")))


@query()
def strategy_significance(spark, d):
    """Robust tests of each strategy's mean return and bootstrap intervals of its Sharpe ratio."""

    def statistic(x):
        return x.mean() / x.std(ddof=1) * 52.0**0.5 if len(x) > 1 and x.std(ddof=1) > 0 else float("nan")

    s = _series(spark, d)
    return rounded(inference.newey_west(s).join(inference.stationary_bootstrap(s, statistic, block=8), "series"))


@query(f"WITH {WALK} SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(covar_samp(x.ret, y.ret), 9) + 0.0::DOUBLE AS cov FROM rets x JOIN rets y USING (date) GROUP BY 1, 2")
def sample_cov(spark, d):
    return rounded(portfolio.covariances(market.returns(spark, d)), 9)


@query(f"WITH {WALK} SELECT ticker, round(1.0::DOUBLE / (SELECT count(DISTINCT ticker) FROM rets), 6) + 0.0::DOUBLE AS w FROM rets GROUP BY ticker")
def alloc_equal_weight(spark, d):
    names = market.returns(spark, d).select("ticker").distinct()
    return rounded(names.join(F.broadcast(names.agg(F.count("*").alias("n")))).select("ticker", (F.lit(1.0) / F.col("n")).alias("w")))


@query(f"""WITH {_weights_sql()}, dts AS (SELECT strategy, date, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM (SELECT DISTINCT strategy, date FROM wts)),
n AS (SELECT w.* FROM wts w JOIN dts d ON d.strategy = w.strategy AND d.date = w.date AND k = 1 WHERE w.strategy = 'composite'), o AS (SELECT w.* FROM wts w JOIN dts d ON d.strategy = w.strategy AND d.date = w.date AND k = 5 WHERE w.strategy = 'composite')
SELECT round(sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))), 6) + 0.0::DOUBLE AS turnover FROM n FULL JOIN o ON n.ticker = o.ticker""")
def book_turnover(spark, d):
    """Change between the last composite book and that of four dates before."""
    w = written(_weights(spark, d)).filter("strategy = 'composite'")
    dates = w.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("date"))))
    at = lambda k: w.join(F.broadcast(dates.filter(F.col("k") == k)), "date")
    return rounded(portfolio.turnover(at(5), at(1)))


LOOKBACK, REFIT = 52, 13


@query(f"""WITH {WALK}, dy AS (SELECT date, sum(ret) AS s, row_number() OVER (ORDER BY date) - 1 AS t FROM rets GROUP BY date)
SELECT date, round(s / (SELECT count(DISTINCT ticker) FROM rets), 6) + 0.0::DOUBLE AS ret, round(s / (SELECT count(DISTINCT ticker) FROM rets) - 0.0003::DOUBLE * CASE WHEN t = {LOOKBACK} THEN 1 ELSE 0 END, 6) + 0.0::DOUBLE AS net,
  CASE WHEN t = {LOOKBACK} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS turnover FROM dy WHERE t >= {LOOKBACK}""")
def wf_equal_weight(spark, d):
    """What equal weights return before (`ret`) and after costs, with the turnover of each date."""
    return rounded(portfolio.equal_weight(market.returns(spark, d), LOOKBACK))


@query()
def wf_allocation(spark, d):
    """Five methods walked forward under the turnover penalty: what they gave out of sample, best first."""
    return rounded(portfolio.walk_summary(portfolio.walk_forward(market.returns(spark, d), LOOKBACK, REFIT), YEAR))


@query()
def wf_books(spark, d):
    """The turnover of every refit of the walk, and the share by which its covariances were shrunk."""
    walk = portfolio.walk_forward(market.returns(spark, d), LOOKBACK, REFIT)
    return rounded(walk.filter("share IS NOT NULL").select("method", "date", "turnover", "share"), 4)


_SHRUNK = """nd AS (SELECT CAST(count(DISTINCT date) AS DOUBLE) AS n, CAST(count(DISTINCT ticker) AS DOUBLE) AS k FROM rets), m AS (SELECT ticker, sum(ret) / (SELECT n FROM nd) AS m FROM rets GROUP BY ticker),
xy AS (SELECT x.ticker AS a, y.ticker AS b, sum(x.ret * y.ret) / (SELECT n FROM nd) AS xy FROM rets x JOIN rets y USING (date) GROUP BY 1, 2),
s AS (SELECT p.ticker AS a, q.ticker AS b, coalesce(xy, 0) - p.m * q.m AS s FROM m p CROSS JOIN m q LEFT JOIN xy ON xy.a = p.ticker AND xy.b = q.ticker),
q AS (SELECT date, sum(ret * ret - 2 * ret * m) + (SELECT sum(m * m) FROM m) AS q FROM rets JOIN m USING (ticker) GROUP BY date),
st AS (SELECT (SELECT avg(s) FROM s WHERE a = b) AS mu, (SELECT sum(s * s) FROM s) AS ss, (SELECT sum(q * q) FROM q) AS qq, n, k FROM nd),
d AS (SELECT mu, (ss - k * mu * mu) / k AS d2, (qq / n - ss) / (n * k) AS b2 FROM st), sh AS (SELECT mu, CASE WHEN d2 > 0 THEN least(d2, b2) / d2 ELSE 0 END AS share FROM d)"""


@query(f"WITH {WALK}, {_SHRUNK} SELECT a, b, round((1 - share) * s + CASE WHEN a = b THEN share * mu ELSE 0 END, 9) + 0.0::DOUBLE AS cov FROM s, sh")
def lw_cov(spark, d):
    """Shrunk covariances of all names over all dates."""
    rows = written(portfolio.placed(market.returns(spark, d)))
    n = rows.agg(F.max("t") + 1).first()[0]
    return rounded(portfolio.window_moments(rows, n, n, 1)[1].drop("j"), 9)


@query()
def alloc_optimised(spark, d):
    """In-sample weights of every method."""
    return rounded(portfolio.in_sample(market.returns(spark, d)).select("method", "ticker", "w"), 4)


@query()
def in_sample_optimism(spark, d):
    """Sharpe ratio that each method's weights fitted on all dates claim, less that of its walk forward; place 1 is the best walk."""
    r = market.returns(spark, d)
    walked = portfolio.walk_summary(portfolio.walk_forward(r, LOOKBACK, REFIT), YEAR).select("method", F.col("sharpe").alias("walked"), "place")
    mean, risk = F.sum("m") * YEAR, F.sqrt(F.sum("v") * YEAR)
    fitted = portfolio.in_sample(r).groupBy("method").agg(mean.alias("annual_return"), risk.alias("annual_volatility"), F.when(risk > 0, mean / risk).alias("in_sample"))
    return rounded(fitted.join(walked, "method").withColumn("optimism", F.col("in_sample") - F.col("walked")))
