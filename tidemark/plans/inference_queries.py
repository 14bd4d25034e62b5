"""Queries of inference on series and of model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.operators import factors as fx
from tidemark.operators import inference, ml
from tidemark.plans import ctes
from tidemark.plans.ctes import WALK, WEEKLY, phi, r6, rounded
from tidemark.plans.registry import query
from tidemark.sources import market
from tidemark.storage import written

WEEKS = 52.0


def _series(spark, d):
    return market.returns(spark, d).select(F.col("ticker").alias("series"), "date", F.col("ret").alias("r"))


_NW = f"""{WALK}, s AS (SELECT ticker AS series, ret AS r, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM rets),
st AS (SELECT series, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS dev, CAST(greatest(0, least(floor(4 * pow(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9)), count(*) - 2)) AS BIGINT) AS lags FROM s GROUP BY series),
e AS (SELECT s.series, k, r - mean AS e, lags, n FROM s JOIN st USING (series)),
g AS (SELECT a.series, a.k - b.k AS lag, sum(a.e * b.e) / max(a.n) AS g, max(a.lags) AS l FROM e a JOIN e b ON a.series = b.series AND b.k BETWEEN a.k - a.lags AND a.k GROUP BY 1, 2),
v AS (SELECT series, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (l + 1)) * g END) AS v, max(g) FILTER (lag = 0) AS g0 FROM g GROUP BY series),
nw AS (SELECT series, n, lags, mean, mean / nullif(sqrt(CASE WHEN v > 0 THEN v ELSE g0 END / n), 0) AS t_hac, mean / nullif(dev / sqrt(n), 0) AS t_naive FROM st JOIN v USING (series) WHERE n >= 8),
z AS (SELECT *, abs(t_hac) AS za FROM nw)"""


@query(f"WITH {_NW} SELECT series, n, lags, {r6('mean, t_hac, t_naive')}, round(2 * (1 - {phi('za')}), 6) + 0.0::DOUBLE AS p_hac, round(abs(t_naive / nullif(t_hac, 0)), 6) + 0.0::DOUBLE AS inflation FROM z")
def newey_west(spark, d):
    return rounded(inference.newey_west(_series(spark, d)).filter("n >= 8"))


@query(f"WITH {WALK}, c AS (SELECT corr(x.ret, y.ret) AS c FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker GROUP BY x.ticker, y.ticker) SELECT round(greatest(0.0::DOUBLE, least(0.99::DOUBLE, avg(c))), 6) + 0.0::DOUBLE AS avg_corr, count(*) AS pairs FROM c WHERE c IS NOT NULL")
def avg_cross_corr(spark, d):
    return rounded(inference.average_correlation(market.returns(spark, d)))


@query(f"""WITH {WALK}, c AS (SELECT corr(x.ret, y.ret) AS c FROM rets x JOIN rets y ON x.date = y.date AND x.ticker < y.ticker GROUP BY x.ticker, y.ticker),
a AS (SELECT greatest(0.0::DOUBLE, least(0.99::DOUBLE, avg(c))) AS rho FROM c), n AS (SELECT count(*) AS n, count(DISTINCT ticker) AS names FROM rets)
SELECT n, names, round(greatest(1.0::DOUBLE, n / names / 4.0::DOUBLE * names / (1 + (names - 1) * greatest(0.0::DOUBLE, least(0.999::DOUBLE, rho)))), 4) + 0.0::DOUBLE AS effective FROM a, n""")
def effective_n(spark, d):
    r = market.returns(spark, d)
    n = r.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("names")).join(inference.average_correlation(r))
    return rounded(n.select("n", "names", inference.effective_sample(F.col("n"), F.col("names"), 4.0, F.col("avg_corr")).alias("effective")), 4)


@query(f"WITH {WALK} SELECT ticker AS series, round(avg(ret) / stddev_samp(ret) * sqrt(52.0::DOUBLE), 6) + 0.0::DOUBLE AS sharpe FROM rets GROUP BY ticker HAVING stddev_samp(ret) > 0")
def sharpe(spark, d):
    return rounded(_series(spark, d).groupBy("series").agg(moments.sharpe(F.col("r"), WEEKS).alias("sharpe")).filter("sharpe IS NOT NULL"))


@query(f"WITH {WALK} SELECT ticker AS series, round(skewness(ret), 6) + 0.0::DOUBLE AS skew, round(kurtosis(ret), 6) + 0.0::DOUBLE AS kurt FROM rets GROUP BY ticker")
def adj_moments(spark, d):
    """Bias-adjusted skewness and excess kurtosis."""
    return rounded(_series(spark, d).groupBy("series").agg(moments.skewness(F.col("r")).alias("skew"), moments.kurtosis(F.col("r")).alias("kurt")))


def _deflated_sql(trials: int) -> str:
    e = f"{moments.expected_best(trials)!r}::DOUBLE"
    return f"""WITH {WALK}, m AS (SELECT ticker AS series, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM rets GROUP BY ticker),
q AS (SELECT *, 1 - skew * sr + (kurt + 2) / 4 * sr * sr AS q FROM m), t AS (SELECT *, {e} * sqrt(q) / sqrt(n - 1.0::DOUBLE) AS th FROM q WHERE q > 0),
z AS (SELECT *, sr * sqrt(n - 1.0::DOUBLE) / sqrt(q) AS z0, (sr - th) * sqrt(n - 1.0::DOUBLE) / sqrt(q) AS z1 FROM t)"""


@query(f"{_deflated_sql(1)} SELECT series, n, round({phi('z0')}, 6) + 0.0::DOUBLE AS psr FROM z")
def psr(spark, d):
    """Probability that the true Sharpe ratio is positive."""
    return rounded(inference.deflated(inference.sharpe_table(_series(spark, d), WEEKS), WEEKS, 1).select("series", "n", "psr"))


@query(f"{_deflated_sql(25)} SELECT series, n, round(sr * sqrt(52.0::DOUBLE), 6) + 0.0::DOUBLE AS sharpe, round(th * sqrt(52.0::DOUBLE), 6) + 0.0::DOUBLE AS threshold, round({phi('z1')}, 6) + 0.0::DOUBLE AS dsr, {phi('z1')} > 0.95 AS significant FROM z")
def deflated_sharpe(spark, d):
    """The same against the best of twenty-five trials."""
    return rounded(inference.deflated(inference.sharpe_table(_series(spark, d), WEEKS), WEEKS, 25).select("series", "n", "sharpe", "threshold", "dsr", "significant"))


@query()
def bootstrap_sharpe(spark, d):
    """Intervals of each ticker's Sharpe ratio under the stationary bootstrap."""

    def statistic(x):
        return x.mean() / x.std(ddof=1) * 52.0**0.5 if len(x) > 1 and x.std(ddof=1) > 0 else float("nan")

    return rounded(inference.stationary_bootstrap(_series(spark, d), statistic, block=8))


_FOLDS = """nd AS (SELECT count(DISTINCT date) AS n FROM panel), ft AS (
  SELECT CAST(f AS INTEGER) AS fold, m + f * s - {h} AS train_end, m + f * s + 5 AS test_start, m + (f + 1) * s AS test_end
  FROM (SELECT n, CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AS m, greatest(CAST(floor((n - floor(n * 0.4::DOUBLE)) / 4) AS BIGINT), 1) AS s FROM nd WHERE n >= 60), range(4) t(f)),
folds AS (SELECT fold, CAST(train_end AS BIGINT) AS train_end, CAST(test_start AS BIGINT) AS test_start, CAST(test_end AS BIGINT) AS test_end FROM ft WHERE train_end > 20 AND test_start < test_end),
placed AS (SELECT p.*, pos FROM panel p JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)) USING (date))"""
_F4 = _FOLDS.format(h=4)


def _panel(spark, d):
    return fx.price_factors(market.bars_walk(spark, d), fx.WEEKLY)


@query(f"WITH {WEEKLY}, {_FOLDS.format(h=21)} SELECT * FROM folds")
def walk_forward_folds(spark, d):
    return ml.folds(_panel(spark, d))


@query(f"""WITH {WEEKLY}, {_F4}, tr AS (SELECT fold, avg(momentum_12_1) AS m1, stddev_pop(momentum_12_1) AS s1, avg(mean_reversion) AS m2, stddev_pop(mean_reversion) AS s2 FROM placed JOIN folds ON pos < train_end GROUP BY fold)
SELECT fold, ticker, date, round((momentum_12_1 - m1) / nullif(s1, 0), 6) + 0.0::DOUBLE AS momentum_12_1, round((mean_reversion - m2) / nullif(s2, 0), 6) + 0.0::DOUBLE AS mean_reversion, round(fwd_return, 6) + 0.0::DOUBLE AS fwd_return
FROM placed JOIN folds ON pos >= test_start AND pos < test_end JOIN tr USING (fold)""")
def train_only_scaling(spark, d):
    p = _panel(spark, d)
    return rounded(ml.scaled_by_training(p, ml.folds(p, horizon=4), ["momentum_12_1", "mean_reversion"]))


_SCORED = f"""{WEEKLY}, {ctes.SCORE}, {_F4}, scored AS (
  SELECT fold, s.ticker, s.date, 1 / (1 + exp(-round(score, 6))) AS score, s.fwd_return, CAST(s.fwd_return > 0 AS INT) AS label
  FROM score s JOIN placed p ON s.ticker = p.ticker AND s.date = p.date JOIN folds ON p.pos >= test_start AND p.pos < test_end WHERE score IS NOT NULL AND s.fwd_return IS NOT NULL)"""
_RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE AS r FROM scored),
aucs AS (SELECT fold, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1.0::DOUBLE) / 2) / (sum(label) * sum(1 - label)::DOUBLE) AS auc FROM rk GROUP BY fold)"""


def _scored(spark, d):
    """Test rows of the folds with the composite score as a probability: deterministic, so that SQL can follow."""
    p = _panel(spark, d)
    s = fx.composite_score(p).na.drop(subset=["score", "fwd_return"])
    at = ml.placed(p).select("ticker", "date", "at")
    table = F.broadcast(ml.folds(p, horizon=4))
    rows = s.join(at, ["ticker", "date"]).join(table, (F.col("at") >= F.col("test_start")) & (F.col("at") < F.col("test_end")))
    return rows.select("fold", "ticker", "date", (1 / (1 + F.exp(-F.round("score", 6)))).alias("score"), "fwd_return", (F.col("fwd_return") > 0).cast("int").alias("label"))


@query(f"WITH {_SCORED}, {_RANKS} SELECT fold, {r6('auc')} FROM aucs")
def auc_rank(spark, d):
    return rounded(ml.auc(_scored(spark, d), ["fold"]))


_SPREAD = """q AS (SELECT fold, date, quantile_cont(score, 0.67) AS hi, quantile_cont(score, 0.33) AS lo FROM scored GROUP BY fold, date HAVING count(*) >= 3),
sp AS (SELECT fold, date, avg(fwd_return) FILTER (score >= hi) - avg(fwd_return) FILTER (score <= lo) AS spread FROM scored JOIN q USING (fold, date) GROUP BY fold, date)"""


@query(f"WITH {_SCORED}, {_SPREAD} SELECT fold, date, {r6('spread')} FROM sp WHERE spread IS NOT NULL")
def ls_spread(spark, d):
    return rounded(ml.spread(_scored(spark, d), ["fold"]))


_METRICS = """ev AS (SELECT fold, count(*) AS n, avg(CAST((score > 0.5) = (label = 1) AS INT)) AS accuracy, greatest(avg(label), 1 - avg(label)) AS base_rate, avg(CAST(score > 0.5 AS INT)) AS positive_rate FROM scored GROUP BY fold)"""


@query(f"WITH {_SCORED}, {_RANKS}, {_METRICS} SELECT fold, n, {r6('accuracy, base_rate, positive_rate')}, round(accuracy - base_rate, 6) + 0.0::DOUBLE AS lift, positive_rate > 0.95 OR positive_rate < 0.05 AS degenerate, {r6('auc')} FROM ev JOIN aucs USING (fold)")
def fold_metrics(spark, d):
    return rounded(ml.evaluation(_scored(spark, d), ["fold"]))


_SIGNALS = f"""{_SCORED}, {_SPREAD}, numbered AS (SELECT fold AS series, spread AS r, row_number() OVER (PARTITION BY fold ORDER BY date) AS k FROM sp WHERE spread IS NOT NULL), {ctes.hac("numbered", 3)},
twain AS (SELECT fold, date, rank() OVER (PARTITION BY fold, date ORDER BY score) + (count(*) OVER (PARTITION BY fold, date, score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY fold, date ORDER BY fwd_return) + (count(*) OVER (PARTITION BY fold, date, fwd_return) - 1) / 2.0::DOUBLE AS ry FROM scored),
ics AS (SELECT fold, corr(rx, ry) AS ic FROM twain GROUP BY fold, date HAVING count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0), ic AS (SELECT fold, avg(ic) AS ic, count(*) AS ic_dates FROM ics GROUP BY fold)"""


@query(f"""WITH {_SIGNALS} SELECT fold, {r6("ic")}, ic_dates, round(mean, 6) + 0.0::DOUBLE AS signal, n AS periods, round(t_hac, 4) + 0.0::DOUBLE AS t_hac, round(t_naive, 4) + 0.0::DOUBLE AS t_naive, round(2 * (1 - {phi("za")}), 4) + 0.0::DOUBLE AS p_hac
FROM ic JOIN tested ON series = fold WHERE n >= 8""")
def fold_signals(spark, d):
    """Does the score rank names in each fold, and does the spread it picks pay?"""
    t = ml.signal_tests(_scored(spark, d), ["fold"], 3).filter("periods >= 8")
    return rounded(t.select("fold", "ic", "ic_dates", "signal", "periods", *[F.round(c, 4).alias(c) for c in ("t_hac", "t_naive", "p_hac")]))


@query(f"WITH {_SCORED}, {_METRICS} SELECT round(stddev_pop(accuracy), 6) + 0.0::DOUBLE AS accuracy_dev, stddev_pop(accuracy) > 0.10 AS unstable, count(*) FILTER (positive_rate > 0.95 OR positive_rate < 0.05) AS degenerate FROM ev")
def fold_stability(spark, d):
    m = ml.evaluation(_scored(spark, d), ["fold"])
    return rounded(m.agg(F.stddev_pop("accuracy").alias("accuracy_dev"), (F.stddev_pop("accuracy") > 0.10).alias("unstable"), F.count_if("degenerate").alias("degenerate")))


@query("""WITH m AS (SELECT l_returnflag AS model, l_linenumber AS fold, avg(l_discount) AS accuracy, avg(l_quantity / 50.0::DOUBLE) AS auc, avg(l_tax) AS ic FROM lineitem GROUP BY 1, 2),
s AS (SELECT model, count(*) AS folds, avg(accuracy) AS accuracy, stddev_pop(accuracy) AS accuracy_dev, avg(auc) AS auc, avg(ic) AS ic, avg(accuracy - 0.04) AS lift FROM m GROUP BY model),
b AS (SELECT *, ic > (SELECT ic FROM s WHERE model = 'N') AS beats_linear FROM s)
SELECT model, folds, round(accuracy, 6) + 0.0::DOUBLE AS accuracy, round(accuracy_dev, 6) + 0.0::DOUBLE AS accuracy_dev, round(auc, 6) + 0.0::DOUBLE AS auc, round(ic, 6) + 0.0::DOUBLE AS ic, round(lift, 6) + 0.0::DOUBLE AS lift, beats_linear,
       CASE WHEN ic > 0.02 AND lift > 0.01 AND beats_linear THEN 'candidate_signal' WHEN ic > 0.02 OR lift > 0.01 THEN 'marginal_no_usable_edge' ELSE 'no_edge_detected' END AS verdict, CAST(row_number() OVER (ORDER BY ic DESC, auc DESC, model) AS INTEGER) AS place FROM b""")
def model_summary(spark, d):
    """Three result groups stand for models, of which N is the linear one."""
    per = market.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg(F.avg("l_discount").alias("accuracy"), F.avg(F.col("l_quantity") / 50.0).alias("auc"), F.avg("l_tax").alias("ic"))
    return rounded(ml.model_summary(per.withColumn("lift", F.col("accuracy") - 0.04), "N"))


@query(f"""WITH {WEEKLY}, w AS (SELECT ticker, date, count(*) OVER x AS n, count(*) FILTER (momentum_12_1 IS NOT NULL AND liquidity IS NOT NULL) OVER x AS k,
  sum(CAST(liquidity AS FLOAT)) OVER x AS s FROM panel WINDOW x AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, date, CAST(20 AS INTEGER) AS length, round(s, 3) + 0.0::DOUBLE AS total FROM w WHERE n = 20 AND k = 20""")
def sequence_windows(spark, d):
    s = ml.sequences(_panel(spark, d), ["momentum_12_1", "liquidity"])
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[1].cast("double"))
    return rounded(s.select("ticker", "date", F.size("sequence").alias("length"), total.alias("total")), 3)


@query()
def oos_logistic(spark, d):
    """Out-of-sample scores of a logistic regression, fold by fold."""
    p, features = written(_panel(spark, d)), list(fx.PRICE_FACTORS)
    return rounded(ml.out_of_sample(p, ml.folds(ml.prepared(p, features), horizon=4), features, "logistic"))


@query()
def oos_gbt(spark, d):
    """The same of second-order boosted trees."""
    p, features = written(_panel(spark, d)), list(fx.PRICE_FACTORS)
    return rounded(ml.out_of_sample(p, ml.folds(ml.prepared(p, features), horizon=4), features, "boosting"))


@query()
def oos_sequences(spark, d):
    """The same of a recurrent and an attention network over the last twenty rows of each name."""
    p, features = written(_panel(spark, d)), list(fx.PRICE_FACTORS)
    return rounded(ml.sequence_training(p, ml.folds(ml.prepared(p, features), horizon=4), features)[0])


@query()
def model_importances(spark, d):
    """The eight features with the greatest mean gain in each fold's boosted trees."""
    p, features = written(_panel(spark, d)), list(fx.PRICE_FACTORS)
    return rounded(ml.top_importances(p, ml.folds(ml.prepared(p, features), horizon=4), features))


@query(f"""WITH {WEEKLY}, {ctes.LONG} SELECT factor, count(*) AS n, round(corr(x, fwd_return), 6) + 0.0::DOUBLE AS r, count(*) > 30 AND abs(corr(x, fwd_return)) > 0.3 AS suspect
FROM long WHERE x IS NOT NULL AND fwd_return IS NOT NULL GROUP BY factor""")
def critic_lookahead(spark, d):
    """Factors whose pooled correlation with the label is too good to be known in time."""
    x = fx.unpivoted(_panel(spark, d)).filter("x IS NOT NULL AND fwd_return IS NOT NULL").groupBy("factor").agg(F.count("*").alias("n"), moments.correlation("x", "fwd_return").alias("r"))
    return rounded(x.withColumn("suspect", (F.col("n") > 30) & (F.abs("r") > 0.3)))
