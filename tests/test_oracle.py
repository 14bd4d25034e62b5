"""Every query with SQL gives the rows of that SQL on the smallest tables; the others those of plain loops."""

import functools
import glob
import os
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from tidemark.operators import factors, ml, portfolio
from tidemark.plans import inference_queries, panel_queries, registry, trading_queries
from tidemark.sources import market
from tidemark.storage import written

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_tables(spark):
    """Bars, panels and daily results, which dozens of queries start from, are made once for all tests of this file."""
    patch = pytest.MonkeyPatch()
    for module, name in ((market, "bars_raw"), (market, "bars_walk"), (panel_queries, "_panel"), (inference_queries, "_panel"), (trading_queries, "_panel"), (trading_queries, "_pnl")):
        patch.setattr(module, name, functools.cache(lambda *args, make=getattr(module, name): written(make(*args))))
    yield
    patch.undo()


def value(v):
    if v is None or v != v or str(v) == "NaT":
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.5f}" if abs(v) < 1e6 else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda data, cols: sorted(tuple(value(r[cols.index(c)]) for c in order) for r in data)
    a, b = rows(got.collect(), got.columns), rows(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert sum(x != y for x, y in zip(a, b, strict=True)) == 0


def of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    """Daily results of the strategies, by strategy and date."""
    out = {}
    for r in QUERIES["daily_pnl"](spark, sf_dir).orderBy("date").collect():
        out.setdefault(r.strategy, []).append((r.date, r.net))
    return out


def sharpe(x):
    return x.mean() / x.std(ddof=1) * 52.0**0.5


def resampled(x, k, block, seed=7):
    """One draw of the stationary bootstrap, step by step."""
    rng, n = np.random.default_rng([seed, k]), len(x)
    start, new, out = rng.integers(0, n, n), rng.random(n) < 1 / block, []
    for i in range(n):
        at = int(start[i]) if i == 0 or new[i] else (at + 1) % n
        out.append(x[at])
    return np.array(out)


def test_bootstrap_matches_a_plain_loop(spark, sf_dir):
    series = {}
    for r in market.returns(spark, sf_dir).orderBy("date").collect():
        series.setdefault(r.ticker, []).append(r.ret)
    got = {r.series: r for r in of(spark, sf_dir, "bootstrap_sharpe")}
    assert got.keys() == series.keys() and {r.draws for r in got.values()} == {600}
    for name in sorted(series)[:5]:
        s = [sharpe(resampled(np.array(series[name]), k, 8)) for k in range(1, 601)]
        assert [got[name].low, got[name].high] == pytest.approx(np.quantile(s, [0.025, 0.975]), abs=1e-5)


def test_significance_matches_plain_loops(spark, sf_dir, net):
    got = {r.series: r for r in of(spark, sf_dir, "strategy_significance")}
    assert got.keys() == net.keys()
    for name, days in net.items():
        x = np.array([v for _, v in days])
        n, e = len(x), x - x.mean()
        lags = min(int(4 * (n / 100) ** (2 / 9)), n - 2)
        gamma = [(e[k:] * e[: n - k]).sum() / n for k in range(lags + 1)]
        v = gamma[0] + 2 * sum((1 - k / (lags + 1)) * gamma[k] for k in range(1, lags + 1))
        assert got[name].t_hac == pytest.approx(x.mean() / np.sqrt((v if v > 0 else gamma[0]) / n), rel=1e-3)
        s = [sharpe(resampled(x, k, 8)) for k in range(1, 601)]
        assert [got[name].low, got[name].high] == pytest.approx(np.quantile(s, [0.025, 0.975]), rel=1e-3)


def test_factor_risk_matches_least_squares(spark, sf_dir, net):
    names = ["momentum_12_1", "volatility_20d", "mean_reversion", "liquidity"]
    by = {}
    for r in of(spark, sf_dir, "factor_mimicking"):
        by.setdefault(r.date, {})[r.factor] = r.ret
    got = {(r.series, r.factor): r for r in of(spark, sf_dir, "factor_risk")}
    for name, days in net.items():
        rows = [(v, *[by[d][f] for f in names]) for d, v in days if d in by and all(f in by[d] for f in names)]
        y, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0][1:]
        for i, f in enumerate(names):
            assert got[name, f].beta == pytest.approx(beta[i], rel=2e-3, abs=2e-3)
            assert got[name, f].share == pytest.approx(beta[i] * np.cov(x[:, i], y, ddof=0)[0, 1] / y.var(), rel=2e-3, abs=2e-3)


def _joint_slopes(rows, names):
    """{factor: slopes by date} of regressions on the factors that vary on each date."""
    dates, slopes = {}, {f: [] for f in names}
    for r in rows:
        dates.setdefault(r.date, []).append([r.fwd_return, *[r[f] for f in names]])
    for date in sorted(dates):
        a = np.array(dates[date])
        if len(a) >= len(names) + 3:
            keep = [i for i in range(len(names)) if a[:, i + 1].min() < a[:, i + 1].max()]
            x = a[:, [i + 1 for i in keep]]
            z = (x - x.mean(axis=0)) / x.std(axis=0)
            for i, b in zip(keep, np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), a[:, 0], rcond=None)[0][1:]):
                slopes[names[i]].append(b)
    return slopes


def test_joint_regressions_match_least_squares(spark, sf_dir):
    names = ["momentum_12_1", "volatility_20d", "mean_reversion", "liquidity"]
    rows = factors.price_factors(market.bars_walk(spark, sf_dir), factors.WEEKLY).na.drop(subset=["fwd_return", *names]).collect()
    want = _joint_slopes(rows, names)
    got = {r.factor: (r.periods, r.premium) for r in of(spark, sf_dir, "fama_macbeth_multi")}
    assert got == {f: (len(want[f]), pytest.approx(np.mean(want[f]), abs=2e-6)) for f in names}


def test_panel_premiums_and_their_tests(spark):
    """All admitted factors of the whole panel, jointly; macro series, equal for all names, get no slope."""
    d = "/root/testdata/sf0.01"
    got = {r.factor: r for r in of(spark, d, "fama_macbeth_panel")}
    rows = QUERIES["whole_panel"](spark, d)
    names = sorted(got)
    want = _joint_slopes(panel_queries._whole(spark, d).na.drop(subset=["fwd_return", *names]).collect(), names)
    assert set(rows.columns) >= set(names) and {"earnings_yield", "sentiment_score", "vix_percentile"} <= set(names)
    for f in names:
        r, b = got[f], np.array(want[f])
        assert (r.mode, r.names, r.periods) == ("multivariate", 25, len(b)) and r.cross_sections == max(map(len, want.values()))
        if len(b) < 8:
            assert r.status == "insufficient_periods" and r.t_hac is None
            continue
        e, n = b - b.mean(), len(b)
        v = e @ e / n + sum(2 * (1 - k / 4) * (e[k:] @ e[:-k]) / n for k in range(1, 4))
        t = b.mean() / np.sqrt((v if v > 0 else e @ e / n) / n)
        assert (r.premium, r.t_hac, r.t_naive) == pytest.approx((b.mean(), t, b.mean() / (b.std(ddof=1) / np.sqrt(n))), rel=1e-3, abs=2e-6)
        assert r.significant == (2 * (1 - NormalDist().cdf(abs(t))) < 0.05)


def test_logistic_scores_match_a_direct_fit(spark, sf_dir):
    """Every fold against Newton's method on the same penalised, class-weighted loss."""
    names = list(factors.PRICE_FACTORS)
    panel = ml.prepared(factors.price_factors(market.bars_walk(spark, sf_dir), factors.WEEKLY), names)
    folds = ml.folds(panel, horizon=4).collect()
    rows = ml.placed(panel).collect()
    x, y, at = np.array([[r[f] for f in names] for r in rows]), np.array([float(r.fwd_return > 0) for r in rows]), np.array([r["at"] for r in rows])
    want = {}
    for fold in folds:
        train, test = at < fold.train_end, (at >= fold.test_start) & (at < fold.test_end)
        z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
        a, n, pos = np.column_stack([np.ones(train.sum()), z[train]]), train.sum(), y[train].sum()
        weight = np.where(y[train] == 1, n / (2 * pos), n / (2 * (n - pos)))
        beta, ridge = np.zeros(len(names) + 1), np.diag([0.0] + [1.0] * len(names))
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ beta))
            beta -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y[train])) + ridge @ beta)
        want |= {(fold.fold, r.ticker, r.date): s for r, s, t in zip(rows, 1 / (1 + np.exp(-(beta[0] + z @ beta[1:]))), test) if t}
    got = {(r.fold, r.ticker, r.date): r.score for r in of(spark, sf_dir, "oos_logistic")}
    assert len(folds) == 4 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_boosting_learns_and_is_scored_out_of_sample(spark, sf_dir, monkeypatch):
    """The values of trees are held against plain numpy in test_boosting."""
    monkeypatch.setattr(ml, "TREES", 5)
    rows = of(spark, sf_dir, "oos_gbt")
    assert {r.fold for r in rows} == {0, 1, 2, 3} and all(0 < r.score < 1 for r in rows) and len({round(r.score, 3) for r in rows}) > 20
    top = of(spark, sf_dir, "model_importances")
    for f in range(4):
        own = sorted((r for r in top if r.fold == f), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, 8)) and sum(r.importance for r in own) == pytest.approx(1, abs=1e-5)
        assert [r.importance for r in own] == sorted((r.importance for r in own), reverse=True) and sum(r.splits for r in own) <= 5 * 7


def test_allocations_are_weights(spark, sf_dir):
    """Their values are held against a dense matrix in test_properties. In-sample books ask for over thirty dates with all names."""
    assert of(spark, sf_dir, "alloc_optimised") == []
    sf_dir = "/root/testdata/sf0.01"
    total = {}
    for r in of(spark, sf_dir, "alloc_optimised"):
        total[r.method] = total.get(r.method, 0) + r.w
    assert total.keys() == portfolio.METHODS.keys() and all(t == pytest.approx(1, abs=2e-3) for t in total.values())
    out = of(spark, sf_dir, "in_sample_optimism")
    assert {r.method for r in out} == total.keys() and all(r.optimism == pytest.approx(r.in_sample - r.walked, abs=2e-6) for r in out)
    walked = {r.method: r for r in of(spark, sf_dir, "wf_allocation")}
    equal = np.array([r.ret for r in of(spark, sf_dir, "wf_equal_weight")])
    same, level = walked["equal_weight"], np.cumprod(1 + equal)
    assert same.sharpe == pytest.approx(sharpe(equal), rel=1e-3) and same.n == len(equal) and same.avg_turnover == 0
    assert same.total_return == pytest.approx(level[-1] - 1, abs=1e-4) and same.max_drawdown == pytest.approx((level / np.maximum.accumulate(level) - 1).min(), abs=1e-4)
    assert all(r.walked == pytest.approx(walked[r.method].sharpe, abs=2e-6) and r.place == walked[r.method].place for r in out)
    books = of(spark, sf_dir, "wf_books")
    mean = lambda m: np.mean([r.turnover for r in books if r.method == m and r.turnover is not None])
    assert all(mean(m) == pytest.approx(walked[m].avg_turnover, abs=1e-4) for m in walked)


#: Held against plain loops above and in test_properties.
ELSEWHERE = {"alloc_optimised", "bootstrap_sharpe", "factor_risk", "fama_macbeth_multi", "fama_macbeth_panel", "in_sample_optimism", "model_importances", "numeric_grounding", "oos_gbt", "oos_logistic", "oos_sequences", "retrieval_eval_all", "strategy_significance", "synthetic_universe", "wf_allocation", "wf_books", "research_findings"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == ELSEWHERE
