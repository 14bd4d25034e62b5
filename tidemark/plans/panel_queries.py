"""Queries over bars, facts, macro series and the factor panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import asof, bfill, change, compounded, decayed_mean, ffill, ordered, prior, rolling, rolling_rank
from tidemark.operators import factors as fx
from tidemark.operators import quality as dq
from tidemark.plans import ctes
from tidemark.plans.ctes import BARS, DAILY, FACTS, MACRO, NEWS, WALK, WEEKLY, r6, rounded
from tidemark.plans.registry import query
from tidemark.sources import generate, market
from tidemark.storage import written


@query(f"WITH {BARS} SELECT ticker, date, open, high, low, close, volume FROM bars")
def scan_bars(spark, d):
    return market.bars_raw(spark, d)


@query(f"WITH {BARS} SELECT ticker, date, {r6('close')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE k <= 20")
def tail_n_bars(spark, d):
    """The last twenty bars of each ticker."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rounded(market.bars_raw(spark, d).withColumn("k", k).filter("k <= 20").select("ticker", "date", "close"))


@query(f"""WITH {WALK}, n AS (SELECT count(DISTINCT ticker) AS n FROM walk),
f AS (SELECT date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS x, ticker FROM walk WHERE date IN (SELECT date FROM walk, n GROUP BY date, n HAVING count(*) = n))
SELECT date, {r6('level')} FROM (SELECT date, 100 * avg(x) AS level FROM f GROUP BY date)""")
def equal_weight_index(spark, d):
    """Mean of prices over first prices, on the dates that every ticker has."""
    bars = dq.on_common_dates(market.bars_walk(spark, d), 0)
    x = F.col("close") / F.first("close").over(ordered())
    return rounded(bars.select("date", x.alias("x")).groupBy("date").agg((100 * F.avg("x")).alias("level")))


@query()
def synthetic_universe(spark, d):
    """Regime-switching price paths of generated tickers."""
    return generate.universe(spark, tickers=12, days=600, seed=7)


@query(f"""WITH {FACTS}, t AS (SELECT ticker, metric, accession % 3 AS tag, count(*) AS n FROM facts GROUP BY 1, 2, 3)
SELECT ticker, metric, tag, n FROM (SELECT *, min(tag) OVER (PARTITION BY ticker, metric) AS best FROM t) WHERE tag = best""")
def facts_tag_priority(spark, d):
    """Of several tags for a metric, the first in priority that a ticker has."""
    f = market.facts(spark, d).groupBy("ticker", "metric", (F.col("accession") % 3).alias("tag")).agg(F.count("*").alias("n"))
    return f.withColumn("best", F.min("tag").over(Window.partitionBy("ticker", "metric"))).filter("tag = best").drop("best")


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def resolve_keys(spark, d):
    """Zero-padded keys by lookup."""
    s, n = market.table(spark, d, "supplier"), market.table(spark, d, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.col("n_name").alias("nation"))


@query("""SELECT o_custkey AS custkey, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS form FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderpriority LIKE '1-%') WHERE k <= 3""")
def list_filings(spark, d):
    """Of each filer the latest three filings whose form has the prefix. Tasks keep three of each filer before any filing moves."""
    o = market.table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1-"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.withColumn("k", place).filter("k <= 3").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_orderpriority").alias("form"))


@query(f"WITH {MACRO} SELECT series, obs_date, avail_date, {r6('value')} FROM macro")
def macro_publication_lag(spark, d):
    """Series with the day from which each value could be known."""
    return rounded(market.macro(spark, d))


@query(f"""WITH {NEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, event_id) AS rn FROM news)
SELECT ticker, count(*) AS n, date_diff('day', CAST(min(published_at) AS DATE), CAST(max(published_at) AS DATE)) AS coverage_days FROM k WHERE rn <= 30 GROUP BY ticker""")
def news_coverage(spark, d):
    """Of each ticker's latest thirty items: their number and the days that they span."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("published_at"), "event_id"))
    top = market.news(spark, d).withColumn("k", k).filter("k <= 30")
    return top.groupBy("ticker").agg(F.count("*").alias("n"), F.datediff(F.max("published_at").cast("date"), F.min("published_at").cast("date")).cast("long").alias("coverage_days"))


@query(f"WITH {WALK} SELECT ticker, date, {r6('close')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM walk) WHERE k % 5 = 1")
def downsample_every_k(spark, d):
    return rounded(market.bars_walk(spark, d).withColumn("k", F.row_number().over(ordered())).filter("k % 5 = 1").select("ticker", "date", "close"))


_STALE = """ch AS (SELECT ticker, date, CASE WHEN close = lag(close) OVER (PARTITION BY ticker ORDER BY date) THEN 0 ELSE 1 END AS c FROM {t}),
isl AS (SELECT ticker, sum(c) OVER (PARTITION BY ticker ORDER BY date) AS i FROM ch),
stale AS (SELECT ticker, CAST(max(n) AS BIGINT) AS longest FROM (SELECT ticker, i, count(*) - 1 AS n FROM isl GROUP BY ticker, i) GROUP BY ticker)"""
_COARSE = "coarse AS (SELECT ticker, date, floor(close / 2000) * 2000 AS close FROM bars)"


@query(f"WITH {BARS}, {_COARSE}, {_STALE.format(t='coarse')} SELECT * FROM stale")
def stale_price_runs(spark, d):
    """The longest run of unchanged prices, on prices in steps so that runs occur."""
    return dq.stale_runs(market.bars_raw(spark, d).withColumn("close", F.floor(F.col("close") / 2000) * 2000))


@query(f"WITH {WALK} SELECT ticker, date, {r6('ret')} FROM rets WHERE abs(ret) > 0.1")
def split_like_moves(spark, d):
    return rounded(dq.split_like(market.bars_walk(spark, d), 0.1))


_FOUND = (
    BARS
    + ", "
    + _STALE.format(t="bars")
    + """,
rb AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars),
per AS (
  SELECT ticker, count(*) AS n, count(*) FILTER (close IS NULL) AS missing, count(date) - count(DISTINCT date) AS duplicates,
         count(*) FILTER (least(coalesce(open, 1), coalesce(high, 1), coalesce(low, 1), coalesce(close, 1)) <= 0) AS non_positive, count(*) FILTER (high < low) AS high_below_low,
         count(*) FILTER (close > high + 1e-6 OR close < low - 1e-6) AS close_outside, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (abs(r) > 0.35) AS split_like,
         quantile_cont(close * volume, 0.5) AS dollars FROM rb GROUP BY ticker),
found AS (
  SELECT ticker, 'too_short' AS "check", 'warning' AS severity, n FROM per WHERE n < 120
  UNION ALL SELECT ticker, 'missing', 'error', missing FROM per WHERE missing > 0.1 * n
  UNION ALL SELECT ticker, 'missing', 'info', missing FROM per WHERE missing > 0 AND missing <= 0.1 * n
  UNION ALL SELECT ticker, 'duplicates', 'warning', duplicates FROM per WHERE duplicates > 0
  UNION ALL SELECT ticker, 'non_positive', 'error', non_positive FROM per WHERE non_positive > 0
  UNION ALL SELECT ticker, 'high_below_low', 'error', high_below_low FROM per WHERE high_below_low > 0
  UNION ALL SELECT ticker, 'close_outside', 'warning', close_outside FROM per WHERE close_outside > 0
  UNION ALL SELECT ticker, 'negative_volume', 'error', negative_volume FROM per WHERE negative_volume > 0
  UNION ALL SELECT ticker, 'split_like', 'warning', split_like FROM per WHERE split_like > 0
  UNION ALL SELECT ticker, 'stale', 'warning', longest FROM stale WHERE longest >= 5
  UNION ALL SELECT ticker, 'thin', 'warning', n FROM per WHERE dollars < 1e6)"""
)


@query(f'WITH {_FOUND} SELECT ticker, "check", severity, CAST(n AS BIGINT) AS n FROM found')
def validate_bars(spark, d):
    return dq.findings(market.bars_raw(spark, d))


@query(f"""WITH {_FOUND} SELECT ticker, count(*) AS rows FROM bars WHERE ticker NOT IN (SELECT ticker FROM found WHERE severity = 'error' OR "check" = 'split_like' AND n > 160) GROUP BY ticker""")
def usable_universe(spark, d):
    """Tickers left after dropping those with an error; here many jumps count as one."""
    bars = market.bars_raw(spark, d)
    found = dq.findings(bars).withColumn("severity", F.when((F.col("check") == "split_like") & (F.col("n") > 160), "error").otherwise(F.col("severity")))
    return dq.usable(bars, found).groupBy("ticker").agg(F.count("*").alias("rows"))


@query(f"""WITH {BARS}, common AS (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)),
per AS (SELECT ticker, count(*) AS dates, count(*) FILTER (date IN (SELECT date FROM common)) AS common FROM bars GROUP BY ticker)
SELECT ticker, dates, common, round(common / dates, 6) + 0.0::DOUBLE AS coverage, common / dates >= 0.9 AS aligned FROM per""")
def calendar_alignment(spark, d):
    return rounded(dq.calendar(market.bars_raw(spark, d)))


_FILL = """gaps AS (SELECT ticker, date, CASE WHEN day(date) % 3 > 0 THEN close END AS x FROM walk),
fl AS (SELECT ticker, date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM gaps)"""


@query(f"WITH {WALK}, {_FILL} SELECT ticker, date, {r6('x')} FROM fl")
def ffill_bfill(spark, d):
    x = F.when(F.dayofmonth("date") % 3 > 0, F.col("close"))
    gaps = market.bars_walk(spark, d).select("ticker", "date", x.alias("x"))
    w = ordered()
    return rounded(gaps.select("ticker", "date", F.coalesce(ffill(F.col("x"), w), bfill(F.col("x"), w)).alias("x")))


def _winsor(t: str, z: str) -> str:
    return f"""wr AS (SELECT ticker, date, close, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM {t}),
wm AS (SELECT *, CASE WHEN count(r) OVER p >= 5 THEN avg(r) OVER p END AS m, CASE WHEN count(r) OVER p >= 5 THEN stddev_samp(r) OVER p END AS s FROM wr
  WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
wo AS (SELECT *, coalesce(s > 0 AND abs((r - m) / nullif(s, 0)) > {z}, false) AS is_outlier FROM wm),
wg AS (SELECT *, sum(CASE WHEN is_outlier THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS g, CASE WHEN is_outlier THEN sign(r) * {z} * s END AS cut FROM wo),
win AS (SELECT ticker, date, close, is_outlier, CASE WHEN is_outlier THEN first_value(close) OVER q * exp(coalesce(sum(cut) OVER q, 0)) ELSE close END AS fixed FROM wg
  WINDOW q AS (PARTITION BY ticker, g ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {BARS}, {_winsor('bars', '2.0::DOUBLE')} SELECT ticker, date, {r6('close, fixed')}, is_outlier FROM win")
def winsorize_outliers(spark, d):
    """Outlying returns cut to two deviations, so that runs of them occur."""
    return rounded(dq.winsorised(market.bars_raw(spark, d), 2.0))


@query(f"""WITH {BARS}, pos AS (SELECT ticker, date, coalesce(last_value(open IGNORE NULLS) OVER f, first_value(open IGNORE NULLS) OVER b) AS open, high, low, close, greatest(volume, 0) AS volume FROM bars
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{_winsor('pos', '6.0::DOUBLE')}, j AS (SELECT pos.*, fixed FROM pos JOIN win USING (ticker, date))
SELECT ticker, date, floor(open * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS open, floor(greatest(open, high, low, fixed) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS high, floor(least(open, high, low, fixed) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS low, floor(fixed * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS close, floor(volume * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS volume FROM j""")
def clean_bars(spark, d):
    """Rounded half up: unrepaired prices are ties at any number of places."""
    out = dq.cleaned(market.bars_raw(spark, d))
    return out.select("ticker", "date", *[(F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)).alias(c) for c in ("open", "high", "low", "close", "volume")])


_HALF_UP = ", ".join(f"floor({x} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {c}" for c, x in (("open", "open"), ("high", "greatest(open, high, low, fixed)"), ("low", "least(open, high, low, fixed)"), ("close", "fixed"), ("volume", "volume")))


@query(f"""WITH {_FOUND}, ub AS (SELECT * FROM bars WHERE ticker NOT IN (SELECT ticker FROM found WHERE severity = 'error' OR "check" = 'split_like' AND n > 160)),
pos AS (SELECT ticker, date, coalesce(last_value(open IGNORE NULLS) OVER f, first_value(open IGNORE NULLS) OVER b) AS open, high, low, close, greatest(volume, 0) AS volume FROM ub
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{_winsor('pos', '6.0::DOUBLE')}, j AS (SELECT pos.*, fixed FROM pos JOIN win USING (ticker, date)), cm AS (SELECT date FROM j GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM j))
SELECT ticker, date, {_HALF_UP} FROM j WHERE (SELECT count(*) FROM cm) < 120 OR date IN (SELECT date FROM cm)""")
def load_universe(spark, d):
    """The universe as one relation: bars checked, tickers with errors left out, prices cleaned, on the dates that all have."""
    bars = written(market.bars_raw(spark, d))
    found = dq.findings(bars).withColumn("severity", F.when((F.col("check") == "split_like") & (F.col("n") > 160), "error").otherwise(F.col("severity")))
    out = dq.on_common_dates(written(dq.cleaned(dq.usable(bars, found))))
    return out.select("ticker", "date", *[(F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query(f"""WITH {BARS}, dup AS (SELECT *, 0 AS seq FROM bars UNION ALL SELECT ticker, date, high, low, close * 2, volume, open, 1 FROM bars WHERE day(date) % 7 = 0)
SELECT ticker, date, round(close, 6) + 0.0::DOUBLE AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS k FROM dup) WHERE k = 1""")
def keep_last_duplicate(spark, d):
    """Of several bars of one date the last ingested stays."""
    b = market.bars_raw(spark, d).withColumn("seq", F.lit(0))
    again = b.filter(F.dayofmonth("date") % 7 == 0).withColumns({"close": F.col("close") * 2, "seq": F.lit(1)})
    return rounded(b.union(again).groupBy("ticker", "date").agg(F.max_by("close", "seq").alias("close")))


def _panel(spark, d, lookbacks=fx.Lookbacks()):
    return fx.price_factors(market.bars_walk(spark, d), lookbacks)


def _factor(name: str, factor: str) -> None:
    """Registers a query of one factor of the panel; Catalyst prunes the others."""

    def one(spark, d):
        return rounded(_panel(spark, d).select("ticker", "date", factor))

    one.__name__ = name
    query(f"WITH {DAILY} SELECT ticker, date, {r6(factor)} FROM panel")(one)


for _name, _of in (("momentum", "momentum_12_1"), ("volatility", "volatility_20d"), ("mean_reversion_z", "mean_reversion"), ("liquidity", "liquidity"), ("downside_ratio", "downside_ratio"), ("forward_return", "fwd_return")):
    _factor(_name, _of)


@query(f"WITH {DAILY} SELECT ticker, date, {r6('close, ret_1d, ' + ', '.join(ctes.FACTORS) + ', fwd_return')} FROM panel")
def factor_panel(spark, d):
    return rounded(_panel(spark, d))


@query(
    f"WITH {DAILY}, cov AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS factor, count({f}) / count(*) AS coverage, (SELECT max(k) FROM (SELECT count(DISTINCT {f}) AS k FROM panel GROUP BY ticker)) AS varied FROM panel" for f in ctes.FACTORS)
    + ") SELECT factor, round(coverage, 6) + 0.0::DOUBLE AS coverage, varied, coverage >= 0.3 AND varied > 1 AS admitted FROM cov"
)
def factor_coverage(spark, d):
    return rounded(fx.coverage(_panel(spark, d)))


@query(f"WITH {WEEKLY} SELECT ticker, date, {r6('momentum_12_1, mean_reversion')}, CASE WHEN fwd_return > 0 THEN 1 ELSE 0 END AS label FROM panel WHERE momentum_12_1 IS NOT NULL AND mean_reversion IS NOT NULL AND fwd_return IS NOT NULL")
def ml_design_matrix(spark, d):
    """Complete rows with the label of a positive later return."""
    p = _panel(spark, d, fx.WEEKLY).na.drop(subset=["momentum_12_1", "mean_reversion", "fwd_return"])
    return rounded(p.select("ticker", "date", "momentum_12_1", "mean_reversion", (F.col("fwd_return") > 0).cast("int").alias("label")))


@query(f"WITH {WEEKLY} SELECT ticker, date, CASE WHEN z IS NOT NULL THEN round(greatest(-3.0::DOUBLE, least(3.0::DOUBLE, z)), 6) + 0.0::DOUBLE END AS z FROM (SELECT ticker, date, (liquidity - avg(liquidity) OVER (PARTITION BY date)) / nullif(stddev_samp(liquidity) OVER (PARTITION BY date), 0) AS z FROM panel WHERE liquidity IS NOT NULL)")
def cs_zscore(spark, d):
    p = _panel(spark, d, fx.WEEKLY).filter("liquidity IS NOT NULL")
    return rounded(fx.cross_sectional_z(p, ("liquidity",)).select("ticker", "date", F.col("z_liquidity").alias("z")))


@query(f"WITH {WEEKLY}, {ctes.SCORE} SELECT ticker, date, {r6('score')} FROM score")
def composite_score(spark, d):
    return rounded(fx.composite_score(_panel(spark, d, fx.WEEKLY)).select("ticker", "date", "score"))


def moods(spark, d):
    """(ticker, known, sentiment_score): decayed means of each name's news."""
    days = market.news_of_names(spark, d).groupBy("ticker", "date").agg(F.avg("score").alias("s"))
    t = F.datediff("date", F.min("date").over(Window.partitionBy("ticker")))
    return days.withColumn("t", t).select("ticker", F.col("date").alias("known"), decayed_mean(F.col("s"), F.col("t"), ordered(), 5.0).alias("sentiment_score"))


def macro_state(spark, d):
    """(known, MACRO_FACTORS) from the day on which each value was published; logarithms stand for rates."""
    seen = market.macro(spark, d).withColumn("p", rolling_rank(F.col("value"), 52, ordered("series", "obs_date"), 10))
    of = lambda name, c: F.max(F.when(F.col("series") == name, F.col(c)))
    beside = seen.groupBy(F.col("avail_date").alias("known")).agg(of("AFRICA", "p").alias("a"), of("AMERICA", "value").alias("b"), of("ASIA", "value").alias("c"), of("EUROPE", "value").alias("d"))
    w = Window.orderBy("known")  # the calendar of a few series: a row a date
    filled = [ffill(F.col(x), w) for x in "abcd"]
    return beside.select("known", filled[0].alias("vix_percentile"), F.ln(filled[1] / filled[2]).alias("term_spread"), F.ln(filled[3]).alias("credit_spread"))


def _whole(spark, d):
    return fx.full_panel(market.bars_walk(spark, d), market.filings(spark, d), moods(spark, d), macro_state(spark, d), fx.WEEKLY)


_FOUR = [c for c in ("close", "ret_1d", *ctes.ALL_FACTORS, "fwd_return") if c != "sentiment_score"]


@query(f"WITH {ctes.WHOLE} SELECT ticker, date, {r6(', '.join(_FOUR), 4)}, {r6('sentiment_score', 9)} FROM whole")
def whole_panel(spark, d):
    """All factors of each name and date: prices, what was filed, told and published by then. Scores have four places, so that their
    means often lie between two roundings to four.
    """
    p = _whole(spark, d)
    return p.select("ticker", "date", *[(F.round(c, 9 if c == "sentiment_score" else 4) + F.lit(0.0)).alias(c) for c in (*_FOUR, "sentiment_score")])


@query(f"WITH {ctes.WHOLE}, {ctes.WHOLE_SCORE} SELECT ticker, date, {r6('score')} FROM score")
def whole_composite(spark, d):
    """The composite of all nine weighed factors."""
    return rounded(fx.composite_score(_whole(spark, d)).select("ticker", "date", "score"))


@query(
    f"WITH {ctes.WHOLE}, cov AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS factor, count({f}) / count(*) AS coverage, (SELECT max(k) FROM (SELECT count(DISTINCT {f}) AS k FROM whole GROUP BY ticker)) AS varied FROM whole" for f in ctes.ALL_FACTORS)
    + ") SELECT factor, round(coverage, 6) + 0.0::DOUBLE AS coverage, coverage >= 0.3 AND varied > 1 AS admitted FROM cov"
)
def whole_coverage(spark, d):
    """Which of all factors may be used."""
    return rounded(fx.coverage(_whole(spark, d), fx.ALL_FACTORS).drop("varied"))


@query(f"WITH {DAILY}, {ctes.IC} SELECT factor, date, {r6('ic')} FROM ics")
def factor_ic(spark, d):
    return rounded(fx.information_coefficients(fx.unpivoted(_panel(spark, d))))


@query(f"""WITH {WEEKLY}, {ctes.IC}, s AS (SELECT factor, count(*) AS n_dates, avg(ic) AS m, stddev_samp(ic) AS s, avg(CAST(round(ic, 12) > 0 AS INT)) AS h FROM ics GROUP BY factor)
SELECT factor, n_dates, CASE WHEN n_dates >= 3 THEN round(m, 6) + 0.0::DOUBLE END AS mean_ic, CASE WHEN n_dates >= 3 THEN round(s, 6) + 0.0::DOUBLE END AS std_ic,
       CASE WHEN n_dates >= 3 THEN round(m / nullif(s, 0), 6) + 0.0::DOUBLE END AS ic_ir, CASE WHEN n_dates >= 3 THEN round(h, 6) + 0.0::DOUBLE END AS hit_rate FROM s""")
def factor_ic_summary(spark, d):
    """Do the factors rank later returns?"""
    return rounded(fx.ic_summary(fx.information_coefficients(fx.unpivoted(_panel(spark, d, fx.WEEKLY)))))


@query(f"""WITH {WEEKLY}, {ctes.LONG}, b AS (SELECT factor, date, covar_pop(x, fwd_return) / nullif(stddev_pop(x), 0) AS beta FROM long WHERE x IS NOT NULL AND fwd_return IS NOT NULL GROUP BY factor, date HAVING count(*) >= 4)
SELECT factor, count(*) AS periods, round(avg(beta), 6) + 0.0::DOUBLE AS premium, round(avg(beta) / (stddev_samp(beta) / sqrt(count(*))), 4) + 0.0::DOUBLE AS t_naive FROM b WHERE beta IS NOT NULL GROUP BY factor""")
def fama_macbeth_uni(spark, d):
    b = fx.fama_macbeth_univariate(fx.unpivoted(_panel(spark, d, fx.WEEKLY)))
    t = F.avg("beta") / (F.stddev_samp("beta") / F.sqrt(F.count("*")))
    return rounded(b.groupBy("factor").agg(F.count("*").alias("periods"), F.avg("beta").alias("premium"), F.round(t, 4).alias("t_naive")))


_SLOPES = f"""{WEEKLY}, {ctes.LONG}, b AS (SELECT factor AS series, date, covar_pop(x, fwd_return) / nullif(stddev_pop(x), 0) AS r FROM long WHERE x IS NOT NULL AND fwd_return IS NOT NULL GROUP BY factor, date HAVING count(*) >= 4 AND min(x) < max(x)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM b), {ctes.hac("numbered", 3)}"""


@query(f"""WITH {_SLOPES} SELECT series AS factor, n AS periods, {r6("mean")}, CASE WHEN n >= 8 THEN round(t_hac, 4) + 0.0::DOUBLE END AS t_hac, CASE WHEN n >= 8 THEN round(t_naive, 4) + 0.0::DOUBLE END AS t_naive,
       CASE WHEN n >= 8 THEN round(2 * (1 - {ctes.phi("za")}), 4) + 0.0::DOUBLE END AS p_hac, 2 * (1 - {ctes.phi("za")}) < 0.05 AS significant FROM tested WHERE n >= 8""")
def fama_macbeth_hac(spark, d):
    """Is each factor priced by itself? Tests of its slopes that allow for the overlap of the later returns."""
    b = fx.fama_macbeth_univariate(fx.unpivoted(_panel(spark, d, fx.WEEKLY)))
    t = fx.priced(b, fx.WEEKLY.horizon - 1).filter("status = 'ok'")
    return rounded(t.select("factor", "periods", F.round("premium", 6).alias("mean"), F.round("t_hac", 4).alias("t_hac"), F.round("t_naive", 4).alias("t_naive"), F.round("p_hac", 4).alias("p_hac"), "significant"))


@query()
def fama_macbeth_panel(spark, d):
    """Premiums of all factors that the whole panel covers, jointly if its names identify them, with robust tests."""
    p = written(_whole(spark, d))
    admitted = tuple(sorted(r.factor for r in fx.coverage(p, fx.ALL_FACTORS).filter("admitted").collect()))  # a row a factor
    return rounded(fx.fama_macbeth(p, admitted, fx.WEEKLY.horizon - 1))


@query()
def fama_macbeth_multi(spark, d):
    """Joint regressions on four factors, date by date."""
    b = fx.fama_macbeth_multivariate(_panel(spark, d, fx.WEEKLY), ("momentum_12_1", "volatility_20d", "mean_reversion", "liquidity"))
    return rounded(b.groupBy("factor").agg(F.count("*").alias("periods"), F.avg("beta").alias("premium")))


def _grid(facts):
    return facts.select("ticker", "metric", F.date_trunc("month", "filed_date").cast("date").alias("date")).distinct()


_PIT = "pf AS (SELECT ticker, metric, filed_date, max_by(value, (period_end, value)) AS value FROM facts GROUP BY ALL)"


@query(f"WITH {FACTS}, {_PIT} SELECT g.ticker, g.metric, g.date, pf.value FROM grid g ASOF LEFT JOIN pf ON g.ticker = pf.ticker AND g.metric = pf.metric AND g.date >= pf.filed_date")
def asof_pit_fundamentals(spark, d):
    facts = market.facts(spark, d)
    return fx.pit_series(facts, _grid(facts))


@query(f"""WITH {FACTS}, best AS (SELECT g.ticker, g.metric, g.date, max((f.period_end, f.value)) AS m FROM grid g LEFT JOIN facts f ON g.ticker = f.ticker AND g.metric = f.metric AND f.filed_date <= g.date GROUP BY ALL)
SELECT ticker, metric, date, m[2] AS value, m[1] AS period_end FROM best WHERE m[1] IS NOT NULL""")
def asof_latest_period(spark, d):
    facts = market.facts(spark, d)
    return fx.as_of(facts, _grid(facts)).filter("period_end IS NOT NULL")


@query(f"WITH {FACTS} SELECT ticker, metric, period_end, filed_date, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, period_end ORDER BY filed_date, accession) AS k FROM facts) WHERE k = 1")
def first_reported(spark, d):
    return fx.first_reported(market.facts(spark, d))


_TTM = "ttm AS (SELECT ticker, metric, filed_date, accession, CASE WHEN count(*) OVER w = 4 THEN sum(value) OVER w END AS ttm FROM facts WINDOW w AS (PARTITION BY ticker, metric ORDER BY filed_date, accession ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"


@query(f"""WITH {FACTS}, {_TTM}, last AS (SELECT ticker, metric, filed_date, max_by(ttm, accession) AS ttm FROM ttm GROUP BY ALL)
SELECT g.ticker, g.metric, g.date, round(ttm, 4) + 0.0::DOUBLE AS ttm FROM grid g ASOF LEFT JOIN last ON g.ticker = last.ticker AND g.metric = last.metric AND g.date >= last.filed_date""")
def ttm_asof(spark, d):
    facts = market.facts(spark, d)
    last = fx.trailing_four(facts).groupBy("ticker", "metric", "filed_date").agg(F.max_by(F.struct("ttm"), "accession").alias("s")).select("ticker", "metric", "filed_date", F.col("s.ttm").alias("ttm"))
    return rounded(asof(_grid(facts), last, ["ticker", "metric"], "date", "filed_date", ["ttm"]), 4)


@query(f"""WITH {FACTS}, {_TTM}, lt AS (SELECT ticker, metric, filed_date, max_by(ttm, accession) AS ttm FROM ttm GROUP BY ALL), {_PIT},
a AS (SELECT g.*, lt.ttm FROM grid g ASOF LEFT JOIN lt ON g.ticker = lt.ticker AND g.metric = lt.metric AND g.date >= lt.filed_date),
b AS (SELECT a.*, pf.value FROM a ASOF LEFT JOIN pf ON a.ticker = pf.ticker AND a.metric = pf.metric AND a.date >= pf.filed_date)
SELECT ticker, date, round(max(ttm) FILTER (metric = '1-URGENT') / nullif(max(value) FILTER (metric = '2-HIGH'), 0), 6) + 0.0::DOUBLE AS return_on_equity,
       round(max(ttm) FILTER (metric = '3-MEDIUM') / nullif(max(ttm) FILTER (metric = '5-LOW'), 0), 6) + 0.0::DOUBLE AS operating_margin,
       round(max(value) FILTER (metric = '4-NOT SPECIFIED') / nullif(max(value) FILTER (metric = '5-LOW'), 0), 6) + 0.0::DOUBLE AS leverage FROM b GROUP BY ticker, date""")
def fundamental_factors(spark, d):
    """Ratios of trailing sums and last known values at each month's start."""
    facts = market.facts(spark, d)
    last = fx.trailing_four(facts).groupBy("ticker", "metric", "filed_date").agg(F.max_by(F.struct("ttm"), "accession").alias("s")).select("ticker", "metric", "filed_date", F.col("s.ttm").alias("ttm"))
    known = asof(fx.pit_series(facts, _grid(facts)), last, ["ticker", "metric"], "date", "filed_date", ["ttm"])
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return rounded(known.groupBy("ticker", "date").agg(
        ratio(of("1-URGENT", "ttm"), of("2-HIGH", "value")).alias("return_on_equity"),
        ratio(of("3-MEDIUM", "ttm"), of("5-LOW", "ttm")).alias("operating_margin"),
        ratio(of("4-NOT SPECIFIED", "value"), of("5-LOW", "value")).alias("leverage"),
    ))


@query(f"WITH {WALK} SELECT ticker, date, round(close / lag(close, 52) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) + 0.0::DOUBLE AS growth FROM walk")
def asset_growth(spark, d):
    return rounded(market.bars_walk(spark, d).select("ticker", "date", change(F.col("close"), ordered(), 52).alias("growth")))


@query(f"""WITH {WALK}, g AS (SELECT ticker, date, close - lag(close, 52) OVER (PARTITION BY ticker ORDER BY date) AS g FROM walk)
SELECT ticker, date, round(g / nullif(CASE WHEN count(g) OVER w >= 26 THEN stddev_samp(g) OVER w END, 0), 6) + 0.0::DOUBLE AS surprise FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)""")
def earnings_surprise(spark, d):
    """Year-on-year change in units of its own deviation over two years."""
    w = ordered()
    g = market.bars_walk(spark, d).select("ticker", "date", (F.col("close") - F.lag("close", 52).over(w)).alias("g"))
    return rounded(g.select("ticker", "date", (F.col("g") / F.nullif(rolling(F.stddev_samp, F.col("g"), 104, w, 26), F.lit(0.0))).alias("surprise")))


_BY_SERIES = "PARTITION BY series ORDER BY obs_date"


@query(f"""WITH {MACRO}, l AS (SELECT *, list(value) OVER ({_BY_SERIES} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS h FROM macro)
SELECT series, obs_date, CASE WHEN len(h) >= 10 THEN round((len(list_filter(h, lambda v: v < value)) + (len(list_filter(h, lambda v: v = value)) + 1) / 2.0::DOUBLE) / len(h), 6) + 0.0::DOUBLE END AS pct_rank FROM l""")
def rolling_pct_rank(spark, d):
    w = ordered("series", "obs_date")
    return rounded(market.macro(spark, d).select("series", "obs_date", rolling_rank(F.col("value"), 52, w, 10).alias("pct_rank")))


@query(f"WITH {MACRO} SELECT series, obs_date, round(100 * (value / lag(value, 52) OVER ({_BY_SERIES}) - 1), 6) + 0.0::DOUBLE AS yoy FROM macro")
def cpi_yoy(spark, d):
    return rounded(market.macro(spark, d).select("series", "obs_date", (100 * change(F.col("value"), ordered("series", "obs_date"), 52)).alias("yoy")))


@query(f"WITH {WALK}, {MACRO}, dates AS (SELECT DISTINCT date FROM walk), g AS (SELECT date, series FROM dates, (SELECT DISTINCT series FROM macro)) SELECT g.date, g.series, {r6('value')} FROM g ASOF LEFT JOIN macro m ON g.series = m.series AND g.date >= m.avail_date")
def asof_macro(spark, d):
    """Of each trading date and series the value known then."""
    m = market.macro(spark, d)
    grid = market.bars_raw(spark, d).select("date").distinct().join(m.select("series").distinct())
    return rounded(asof(grid, m, ["series"], "date", "avail_date", ["value"]).select("date", "series", "value"))


@query(f"""WITH {MACRO}, l AS (SELECT *, list(value) OVER ({_BY_SERIES} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS h, avg(value) OVER ({_BY_SERIES} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS base FROM macro),
p AS (SELECT series, obs_date, value - base AS spread, CASE WHEN len(h) >= 10 THEN (len(list_filter(h, lambda v: v < value)) + (len(list_filter(h, lambda v: v = value)) + 1) / 2.0::DOUBLE) / len(h) END AS p FROM l)
SELECT series, obs_date, CASE WHEN p > 0.8 THEN 'high_vol' WHEN spread < 0 THEN 'inverted' WHEN p < 0.3 THEN 'calm' ELSE 'normal' END AS regime FROM p""")
def macro_regime(spark, d):
    """Ordered rules: a high percentile, a negative spread, a low percentile."""
    w = ordered("series", "obs_date")
    base = F.avg("value").over(w.rowsBetween(-12, -1))
    p = market.macro(spark, d).select("series", "obs_date", rolling_rank(F.col("value"), 52, w, 10).alias("p"), (F.col("value") - base).alias("spread"))
    return p.select("series", "obs_date", F.when(F.col("p") > 0.8, "high_vol").when(F.col("spread") < 0, "inverted").when(F.col("p") < 0.3, "calm").otherwise("normal").alias("regime"))


_DECAY = f"""{NEWS}, days AS (SELECT ticker, CAST(published_at AS DATE) AS date, avg(score) AS s FROM news GROUP BY 1, 2),
n AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS t FROM days),
ewm AS (SELECT ticker, date, sum(s * pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w AS sentiment FROM n WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def _sentiment(spark, d):
    days = market.news(spark, d).groupBy("ticker", F.col("published_at").cast("date").alias("date")).agg(F.avg("score").alias("s"))
    t = F.datediff("date", F.min("date").over(Window.partitionBy("ticker")))
    return days.withColumn("t", t).select("ticker", "date", decayed_mean(F.col("s"), F.col("t"), ordered(), 5.0).alias("sentiment"))


@query(f"WITH {_DECAY} SELECT ticker, date, {r6('sentiment')} FROM ewm")
def ewm_halflife(spark, d):
    return rounded(_sentiment(spark, d))


@query(f"WITH {_DECAY} SELECT ticker, date, {r6('sentiment')}, CASE WHEN sentiment > 0.15 THEN 'positive' WHEN sentiment < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM ewm")
def sentiment_series(spark, d):
    s = _sentiment(spark, d)
    return rounded(s.withColumn("label", F.when(F.col("sentiment") > 0.15, "positive").when(F.col("sentiment") < -0.15, "negative").otherwise("neutral")))


@query(f"""WITH {_DECAY}, g AS (SELECT ticker, CAST(range AS DATE) AS date FROM (SELECT DISTINCT ticker FROM news), range(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 3 DAY))
SELECT g.ticker, g.date, {r6('sentiment')} FROM g ASOF LEFT JOIN ewm ON g.ticker = ewm.ticker AND g.date >= ewm.date""")
def asof_sentiment(spark, d):
    s = _sentiment(spark, d).withColumnRenamed("date", "known")
    grid = s.select("ticker").distinct().select("ticker", F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-09', interval 3 days)")).alias("date"))
    return rounded(asof(grid, s, ["ticker"], "date", "known", ["sentiment"]))


@query(f"WITH {WALK} SELECT ticker, date, round(exp(sum(ln(1 + ret)) OVER w), 6) + 0.0::DOUBLE AS equity FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)")
def equity_curve(spark, d):
    return rounded(market.returns(spark, d).select("ticker", "date", compounded(F.col("ret"), ordered()).alias("equity")))


@query(f"WITH {WALK} SELECT ticker, date, round(close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0::DOUBLE AS drawdown FROM walk")
def drawdown(spark, d):
    peak = F.max("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    return rounded(market.bars_walk(spark, d).select("ticker", "date", (F.col("close") / peak - 1).alias("drawdown")))


@query(f"WITH {WALK} SELECT date, " + ", ".join(f"round(max(ret) FILTER (ticker = 'Brand#{i}'), 6) + 0.0::DOUBLE AS brand_{i}" for i in range(1, 26)) + " FROM rets GROUP BY date")
def returns_pivot(spark, d):
    """Returns with a column for each ticker."""
    names = [f"Brand#{i}" for i in range(1, 26)]
    wide = market.returns(spark, d).groupBy("date").pivot("ticker", names).agg(F.max("ret"))
    return wide.select("date", *[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n.lower().replace("#", "_")) for n in names])


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(f"WITH {WEEKLY}, {ctes.SCORE}, sq AS (SELECT ticker, date, score, 0 AS seq FROM score WHERE score IS NOT NULL UNION ALL SELECT ticker, date, -score, 1 FROM score WHERE score IS NOT NULL AND day(date) % 7 = 0) SELECT date, " + ", ".join(f"round(max_by(score, seq) FILTER (ticker = '{b}'), 6) + 0.0::DOUBLE AS {b.lower().replace('#', '_')}" for b in _BRANDS) + " FROM sq GROUP BY date")
def scores_pivot(spark, d):
    """Scores with a column for each ticker: of several of one date the last counts."""
    s = fx.composite_score(_panel(spark, d, fx.WEEKLY)).filter("score IS NOT NULL").select("ticker", "date", "score", F.lit(0).alias("seq"))
    again = s.filter(F.dayofmonth("date") % 7 == 0).withColumns({"score": -F.col("score"), "seq": F.lit(1)})
    wide = s.union(again).groupBy("date").pivot("ticker", _BRANDS).agg(F.max_by("score", "seq"))
    return wide.select("date", *[(F.round(F.col(f"`{b}`"), 6) + F.lit(0.0)).alias(b.lower().replace("#", "_")) for b in _BRANDS])


@query(f"""WITH {BARS}, dates AS (SELECT date, count(DISTINCT ticker) AS n FROM bars GROUP BY date)
SELECT count(*) AS in_any, count(*) FILTER (n = (SELECT count(DISTINCT ticker) FROM bars)) AS in_all FROM dates""")
def date_set_ops(spark, d):
    """How many dates some ticker and how many every ticker has."""
    b = market.bars_raw(spark, d).select("ticker", "date").distinct()
    n = b.agg(F.count_distinct("ticker").alias("k"))
    return b.groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(n)).agg(F.count("*").alias("in_any"), F.count_if(F.col("n") == F.col("k")).alias("in_all"))


@query(f"WITH {WALK}, cut AS (SELECT DISTINCT date FROM walk WHERE date >= DATE '1997-01-01') SELECT ticker, date, {r6('ret')} FROM rets SEMI JOIN cut USING (date)")
def semi_oos_dates(spark, d):
    """Returns of the out-of-sample dates."""
    r = market.returns(spark, d)
    return rounded(r.join(r.select("date").distinct().filter("date >= date'1997-01-01'"), "date", "left_semi").select("ticker", "date", "ret"))


@query(f"""WITH {WALK}, r AS (SELECT *, ret - avg(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM rets)
SELECT ticker, date, {r6('x')} FROM r""")
def return_surprise(spark, d):
    """Return over the mean of the twelve before it."""
    r = market.returns(spark, d)
    return rounded(r.select("ticker", "date", (F.col("ret") - prior(F.avg, F.col("ret"), 12, ordered(), 1)).alias("x")))
