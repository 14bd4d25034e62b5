"""Common table expressions of the DuckDB statements that check the queries, and rounding for both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = """bars AS (
  SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS open FROM (
    SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close, sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""
WALK = (
    BARS
    + """,
walk AS (
  SELECT ticker, date, volume, 100.0::DOUBLE * exp(sum(lr) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM (
    SELECT ticker, date, volume, coalesce(0.1::DOUBLE * (ln(close) - avg(ln(close)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0.0::DOUBLE) AS lr FROM bars)),
rets AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM walk) WHERE ret IS NOT NULL)"""
)


def panel(long: int, skip: int, mid: int, mid_skip: int, short: int, slow: int, tail: int, tail_least: int, horizon: int) -> str:
    roll = lambda f, x, n, k: f"CASE WHEN count({x}) OVER w{n} >= {k} THEN {f}({x}) OVER w{n} END"
    down = f"{roll('stddev_samp', 'dr', tail, tail_least)} / nullif({roll('stddev_samp', 'r', tail, tail_least)}, 0)"
    frames = ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted({short, slow, tail}))
    return (
        WALK
        + f""",
rr AS (SELECT *, CASE WHEN r < 0 THEN r END AS dr, volume * close AS dv FROM (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM walk)),
panel AS (
  SELECT ticker, date, close, close / lag(close) OVER w - 1 AS ret_1d,
         lag(close, {skip}) OVER w / lag(close, {skip + long}) OVER w - 1 AS momentum_12_1, lag(close, {mid_skip}) OVER w / lag(close, {mid_skip + mid}) OVER w - 1 AS momentum_3m,
         {roll('stddev_samp', 'r', short, short)} * sqrt(252.0::DOUBLE) AS volatility_20d, {roll('stddev_samp', 'r', slow, slow)} * sqrt(252.0::DOUBLE) AS volatility_60d,
         (close - {roll('avg', 'close', short, short)}) / nullif({roll('stddev_samp', 'close', short, short)}, 0) AS mean_reversion,
         ln(nullif({roll('avg', 'dv', short, short)}, 0)) AS liquidity, {down} AS downside_ratio, lead(close, {horizon}) OVER w / close - 1 AS fwd_return
  FROM rr WINDOW w AS (PARTITION BY ticker ORDER BY date), {frames})"""
    )


DAILY = panel(252, 21, 63, 5, 20, 60, 63, 21, 21)
WEEKLY = panel(12, 1, 4, 1, 8, 16, 16, 6, 4)
FACTORS = ("momentum_12_1", "momentum_3m", "volatility_20d", "volatility_60d", "mean_reversion", "liquidity", "downside_ratio")
LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, ticker, date, fwd_return, {f} AS x FROM panel" for f in FACTORS) + ")"
IC = (
    LONG
    + """,
ranked AS (
  SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY x) + (count(*) OVER (PARTITION BY factor, date, x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY factor, date ORDER BY fwd_return) + (count(*) OVER (PARTITION BY factor, date, fwd_return) - 1) / 2.0::DOUBLE AS ry
  FROM long WHERE x IS NOT NULL AND fwd_return IS NOT NULL),
ics AS (SELECT factor, date, corr(rx, ry) AS ic FROM ranked GROUP BY factor, date HAVING count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0)"""
)
_WEIGHTS = {"momentum_12_1": 0.30, "momentum_3m": 0.15, "mean_reversion": -0.10, "volatility_20d": -0.10}
SCORE = (
    "zs AS (SELECT ticker, date, fwd_return, ret_1d, "
    + ", ".join(f"({f} - avg({f}) OVER d) / nullif(stddev_samp({f}) OVER d, 0) AS {f}" for f in _WEIGHTS)
    + " FROM panel WINDOW d AS (PARTITION BY date)), score AS (SELECT ticker, date, fwd_return, ret_1d, "
    + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, {f})) END * {w}::DOUBLE" for f, w in _WEIGHTS.items())
    + " AS score FROM zs)"
)
FACTS = """facts AS (
  SELECT n_name AS ticker, o_orderpriority AS metric, o_totalprice AS value, CAST(o_orderdate AS DATE) AS filed_date, o_orderkey AS accession,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY ELSE date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH - INTERVAL 1 DAY END AS DATE) AS period_end
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
grid AS (SELECT DISTINCT ticker, metric, CAST(date_trunc('month', filed_date) AS DATE) AS date FROM facts)"""
MACRO = """macro AS (
  SELECT r_name AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS obs_date, CAST(date_trunc('week', o_orderdate) AS DATE) + CAST([0, 0, 0, 21, 30][r_regionkey + 1] AS INTEGER) AS avail_date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""
NEWS = "news AS (SELECT CAST(user_id % 20 AS VARCHAR) AS ticker, event_id, ts AS published_at, value / 100 - 1 AS score, event_type AS title FROM events)"
PHI = "(CASE WHEN {z} >= 0 THEN 1 - {t} ELSE {t} END)"


def phi(z: str) -> str:
    """Phi of a column of that name."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return PHI.format(z=z, t=f"(exp(-{z} * {z} / 2) * 0.3989422804014327::DOUBLE * {poly})")


_REPORTED = ("eps_diluted", "net_income", "revenue", "operating_income", "stockholders_equity", "total_assets", "total_liabilities", "shares_diluted")
FUNDAMENTALS = (
    f"""filings AS (
  SELECT 'Brand#' || (c_nationkey + 1) AS ticker, {list(_REPORTED)}[o_custkey % 8 + 1] AS metric, o_totalprice AS value, CAST(o_orderdate AS DATE) AS filed_date, o_orderkey AS accession,
         CAST(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY ELSE date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH - INTERVAL 1 DAY END AS DATE) AS period_end,
         ['10-K', '10-Q', '10-Q', '10-Q/A', '8-K'][(o_custkey // 8) % 5 + 1] AS form
  FROM orders JOIN customer ON o_custkey = c_custkey),
rep AS (SELECT *, form LIKE '10-Q%' AND metric IN {_REPORTED[:4]} AS q FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, period_end ORDER BY filed_date, accession, value, form) AS k
  FROM filings WHERE form LIKE '10-K%' OR form LIKE '10-Q%') WHERE k = 1),
four AS (SELECT *, CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END AS s, count(*) FILTER (q) OVER (PARTITION BY ticker, metric) AS nq FROM rep
  WINDOW w AS (PARTITION BY ticker, metric, q ORDER BY filed_date, period_end, accession ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
steps AS (SELECT ticker, metric, filed_date, CASE WHEN nq < 4 THEN value ELSE s END AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker, metric, filed_date ORDER BY period_end DESC, accession DESC) AS j FROM four WHERE nq < 4 OR q) WHERE j = 1),
wide AS (SELECT ticker, filed_date, """
    + ", ".join(f"max(v) FILTER (metric = '{m}') AS {m}" for m in _REPORTED)
    + """ FROM steps GROUP BY ALL),
known AS (SELECT ticker, filed_date, """
    + ", ".join(f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in _REPORTED)
    + """ FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY filed_date ROWS UNBOUNDED PRECEDING)),
held AS (SELECT p.*, """
    + ", ".join(f"k.{m}" for m in _REPORTED)
    + """ FROM panel p ASOF LEFT JOIN known k ON p.ticker = k.ticker AND p.date >= k.filed_date),
spread AS (SELECT *, eps_diluted - lag(eps_diluted, 52) OVER w AS yearly, CASE WHEN count(eps_diluted) OVER y >= 26 THEN stddev_samp(eps_diluted) OVER y END AS dev, total_assets / nullif(lag(total_assets, 52) OVER w, 0) - 1 AS asset_growth FROM held
  WINDOW w AS (PARTITION BY ticker ORDER BY date), y AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)),
funds AS (SELECT *, eps_diluted / nullif(close, 0) AS earnings_yield, stockholders_equity / nullif(shares_diluted * close, 0) AS book_to_price, net_income / nullif(stockholders_equity, 0) AS return_on_equity,
  operating_income / nullif(revenue, 0) AS operating_margin, total_liabilities / nullif(total_assets, 0) AS leverage, yearly / CASE WHEN dev > 1e-9::DOUBLE * abs(eps_diluted) THEN dev END AS earnings_surprise FROM spread)"""
)
#: Sentiment of names and macro state, then the panel of all factors as `whole`.
ALL_FACTORS = (*FACTORS, "earnings_yield", "book_to_price", "return_on_equity", "operating_margin", "leverage", "asset_growth", "earnings_surprise", "sentiment_score", "vix_percentile", "term_spread", "credit_spread")
WHOLE = (
    f"{WEEKLY}, {FUNDAMENTALS}, {MACRO}"
    + """,
stories AS (SELECT ticker, date, avg(score) AS s FROM (SELECT 'Brand#' || (user_id % 25 + 1) AS ticker, DATE '1995-01-02' + CAST((date_diff('second', TIMESTAMP '2024-01-01', ts) * 7) // 7200 AS INTEGER) AS date, value / 100 - 1 AS score FROM events) GROUP BY 1, 2),
aged AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS t FROM stories),
moods AS (SELECT ticker, date AS known, sum(s * pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w AS sentiment_score FROM aged WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
past AS (SELECT *, list(value) OVER (PARTITION BY series ORDER BY obs_date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS h FROM macro),
seen AS (SELECT series, avail_date AS known, value, CASE WHEN len(h) >= 10 THEN (len(list_filter(h, lambda v: v < value)) + (len(list_filter(h, lambda v: v = value)) + 1) / 2.0::DOUBLE) / len(h) END AS p FROM past),
beside AS (SELECT known, max(p) FILTER (series = 'AFRICA') AS a, max(value) FILTER (series = 'AMERICA') AS b, max(value) FILTER (series = 'ASIA') AS c, max(value) FILTER (series = 'EUROPE') AS d FROM seen GROUP BY known),
state AS (SELECT known, last_value(a IGNORE NULLS) OVER w AS vix_percentile, ln(last_value(b IGNORE NULLS) OVER w / last_value(c IGNORE NULLS) OVER w) AS term_spread, ln(last_value(d IGNORE NULLS) OVER w) AS credit_spread FROM beside WINDOW w AS (ORDER BY known ROWS UNBOUNDED PRECEDING)),
felt AS (SELECT f.*, m.sentiment_score FROM funds f ASOF LEFT JOIN moods m ON f.ticker = m.ticker AND f.date >= m.known),
whole AS (SELECT felt.*, state.vix_percentile, state.term_spread, state.credit_spread FROM felt ASOF LEFT JOIN state ON felt.date >= state.known)"""
)
_NINE = {"momentum_12_1": 0.30, "momentum_3m": 0.15, "earnings_yield": 0.20, "book_to_price": 0.10, "return_on_equity": 0.15, "operating_margin": 0.10, "mean_reversion": -0.10, "volatility_20d": -0.10, "leverage": -0.05}
WHOLE_SCORE = (
    "zs AS (SELECT ticker, date, "
    + ", ".join(f"({f} - avg({f}) OVER d) / nullif(stddev_samp({f}) OVER d, 0) AS {f}" for f in _NINE)
    + " FROM whole WINDOW d AS (PARTITION BY date)), score AS (SELECT ticker, date, "
    + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, {f})) END * {w}::DOUBLE" for f, w in _NINE.items())
    + " AS score FROM zs)"
)


def hac(source: str, lags: int) -> str:
    """CTE `nw` of tests with so many lags from rows (series, k, r) of `source`, which numbers the values of each series from 1."""
    return f"""st AS (SELECT series, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS dev, CAST(greatest(0, least({lags}, count(*) - 2)) AS BIGINT) AS lags FROM {source} GROUP BY series),
e AS (SELECT x.series, k, r - mean AS e, lags, n FROM {source} x JOIN st USING (series)),
g AS (SELECT a.series, a.k - b.k AS lag, sum(a.e * b.e) / max(a.n) AS g, max(a.lags) AS l FROM e a JOIN e b ON a.series = b.series AND b.k BETWEEN a.k - a.lags AND a.k GROUP BY 1, 2),
v AS (SELECT series, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (l + 1)) * g END) AS v, max(g) FILTER (lag = 0) AS g0 FROM g GROUP BY series),
nw AS (SELECT series, n, mean, mean / nullif(sqrt(CASE WHEN v > 0 THEN v ELSE g0 END / n), 0) AS t_hac, mean / nullif(dev / sqrt(n), 0) AS t_naive FROM st JOIN v USING (series)),
tested AS (SELECT *, abs(t_hac) AS za FROM nw)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, with one zero: engines add in different orders."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(columns: str, digits: int = 6) -> str:
    """SQL list that rounds the comma-separated columns alike."""
    return ", ".join(f"round({c.strip()}, {digits}) + 0.0::DOUBLE AS {c.strip()}" for c in columns.split(","))
