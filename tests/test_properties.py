"""Properties that any right implementation has, on small generated frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.functions.windows import asof, ordered
from tidemark.operators import backtest, factors, inference, ml, portfolio, quality, reporting, retrieval, risk, text
from tidemark.plans import research
from tidemark.sources import generate, parse, sinks

START = dt.date(2022, 1, 3)


def frame(spark, names=6, days=160, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(names):
        close = 100 * np.exp(np.cumsum(rng.normal(4e-4, 0.013, days)))
        rows += [(f"T{i}", START + dt.timedelta(days=t), float(c) * 0.999, float(c) * 1.005, float(c) * 0.995, float(c), 3e6) for t, c in enumerate(close)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark).cache()


def test_factors_know_no_future(bars):
    """Cutting off later bars changes no earlier factor."""
    cut = START + dt.timedelta(days=120)
    names = ["ticker", "date", *factors.PRICE_FACTORS]
    whole = factors.price_factors(bars, factors.WEEKLY).select(*names).filter(F.col("date") <= cut)
    part = factors.price_factors(bars.filter(F.col("date") <= cut), factors.WEEKLY).select(*names)
    assert whole.exceptAll(part).count() == 0


def test_label_is_the_later_return(bars):
    rows = factors.price_factors(bars, factors.WEEKLY).filter("ticker = 'T0'").orderBy("date").collect()
    h = factors.WEEKLY.horizon
    assert all(rows[i].fwd_return == pytest.approx(rows[i + h].close / rows[i].close - 1) for i in range(len(rows) - h))
    assert all(r.fwd_return is None for r in rows[-h:])


def test_purge_is_as_long_as_the_horizon(bars):
    for f in ml.folds(bars, 4, 21).collect():
        assert f.test_start - f.train_end >= 21 and f.test_start < f.test_end


@pytest.mark.parametrize("name,model", [("oos_logistic", "logistic"), ("oos_gbt", "boosting")])
def test_model_queries_fit_all_folds_and_factors(spark, monkeypatch, name, model):
    from tidemark.plans import registry

    asked = []
    monkeypatch.setattr(ml, "out_of_sample", lambda panel, table, features, kind: asked.append((table.count(), tuple(features), kind)) or spark.createDataFrame([(0.5,)], "score double"))
    registry.queries()[name](spark, "/root/testdata/sf0.01")
    assert asked == [(4, factors.PRICE_FACTORS, model)] and ml.TREES == 200


def test_weights_are_dollar_neutral(spark):
    sig = spark.createDataFrame([("s", f"T{i}", START, float(i % 5)) for i in range(11)], "strategy string, ticker string, date date, score double")
    w = {r.ticker: r.w for r in backtest.form_weights(sig).collect()}
    assert sum(w.values()) == pytest.approx(0) and sum(map(abs, w.values())) == pytest.approx(1) and len(w) == 6
    assert backtest.form_weights(sig.limit(1)).count() == 0


def test_costs_rise_with_trade_and_volatility(spark):
    c = lambda d, v, a: spark.range(1).select(backtest.trade_cost(F.lit(d), F.lit(v), F.lit(a))).first()[0]
    assert 0 == c(0.0, 0.2, 1e7) < c(0.1, 0.2, 1e7) < c(0.2, 0.2, 1e7) < c(0.2, 0.4, 1e7) < c(0.2, 0.4, 1e5)
    assert c(0.1, None, 1e7) == pytest.approx(0.1 * backtest.SPREAD_COST)


def test_drift_equals_a_day_by_day_loop(spark, bars):
    returns = bars.select("ticker", "date", (F.col("close") / F.lag("close").over(ordered()) - 1).alias("ret")).filter("ret IS NOT NULL")
    signals = factors.price_factors(bars, factors.WEEKLY).select(F.lit("s").alias("strategy"), "ticker", "date", F.col("mean_reversion").alias("score"))
    w = backtest.form_weights(signals)
    pos = backtest.positions(w, backtest.schedule(w, returns, 7), returns)
    rows = pos.orderBy("date", "ticker").collect()
    by, books = {}, {}
    for r in rows:
        by.setdefault(r.date, []).append(r)
    for day in sorted(by):
        if by[day][0].rebalanced:
            book = {r.ticker: r.w0 for r in by[day]}
        assert {r.ticker: pytest.approx(r.w) for r in by[day]} == book
        grown = {r.ticker: book[r.ticker] * (1 + r.ret) for r in by[day]}
        gross = sum(map(abs, grown.values()))
        book = books[day] = {k: v / gross for k, v in grown.items()}


def test_equity_is_the_product(spark):
    r = [0.01, -0.02, 0.03, 0.0, -0.005]
    pnl = spark.createDataFrame([("s", START + dt.timedelta(days=i), x, 0.0, 0.0, x, None) for i, x in enumerate(r)], "strategy string, date date, gross double, cost double, borrow double, net double, turnover double")
    m = backtest.metrics(pnl, 252.0).first()
    assert (1 + m.cagr) ** (5 / 252) == pytest.approx(np.prod(1 + np.array(r)))
    assert m.max_drawdown == pytest.approx(-0.02)


def test_robust_errors_shrink_overlapping_t(spark):
    x = np.convolve(np.random.default_rng(3).normal(2e-4, 0.01, 1200), np.ones(21), "valid")
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "series string, date int, r double")
    r = inference.newey_west(s, 21).first()
    assert abs(r.t_hac) < abs(r.t_naive) and r.inflation > 2
    assert inference.newey_west(s.limit(5)).first().t_hac is None


def test_bootstrap_takes_all_draws(spark, sf_dir):
    from tidemark.plans import registry

    assert {r.draws for r in registry.queries()["bootstrap_sharpe"](spark, sf_dir).collect()} == {600}


def test_more_trials_raise_the_bar():
    assert [moments.expected_best(n) for n in (1, 2, 10, 100)] == sorted(moments.expected_best(n) for n in (1, 2, 10, 100)) and moments.expected_best(1) == 0


def test_moments_match_pandas(spark):
    import pandas as pd

    x = np.random.default_rng(2).gamma(2, 1, 300)
    r = spark.createDataFrame([(float(v),) for v in x], "x double").agg(moments.skewness(F.col("x")), moments.kurtosis(F.col("x"))).first()
    assert r[0] == pytest.approx(pd.Series(x).skew()) and r[1] == pytest.approx(pd.Series(x).kurt())
    z = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(moments.normal_cdf(F.col("z"))).collect()
    from statistics import NormalDist

    assert [g[0] for g in got] == pytest.approx([NormalDist().cdf(v) for v in z], abs=1e-7)


def test_tail_order(spark):
    s = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(4).normal(0, 0.02, 2000)], "series string, r double")
    five, one = risk.tail_risk(s, 0.05).first(), risk.tail_risk(s, 0.01).first()
    assert 0 < five.var_hist < five.cvar < one.cvar and five.var_hist < one.var_hist and five.var_normal == pytest.approx(0.0329, abs=0.002)


def test_findings_flag_faults(spark, bars):
    bad = bars.filter("ticker = 'T0'").withColumn("close", F.when(F.col("date") > START + dt.timedelta(days=80), F.col("close") / 2).otherwise(F.col("close")))
    bad = bad.withColumn("close", F.when(F.col("date").between(START + dt.timedelta(days=20), START + dt.timedelta(days=30)), 77.0).otherwise(F.col("close")))
    found = {r.check for r in quality.findings(bad).collect()}
    assert {"split_like", "stale", "close_outside"} <= found
    assert {r.check for r in quality.findings(bars.filter("ticker = 'T1'")).collect()} <= {"split_like"}
    assert quality.findings(bars.filter("false")).count() == 0


def test_outliers_are_cut(bars):
    spiked = bars.filter("ticker = 'T2'").withColumn("close", F.when(F.col("date") == START + dt.timedelta(days=90), F.col("close") * 3).otherwise(F.col("close")))
    rows = quality.winsorised(spiked).orderBy("date").collect()
    assert rows[90].is_outlier and rows[90].fixed < 1.5 * rows[89].close


def test_constant_factor_is_refused(bars):
    panel = factors.price_factors(bars, factors.WEEKLY).withColumn("flat", F.lit(1.0))
    got = {r.factor: r.admitted for r in factors.coverage(panel, ("flat", "liquidity")).collect()}
    assert got == {"flat": False, "liquidity": True}


def test_asof_takes_the_latest_known(spark):
    facts = spark.createDataFrame([("A", "m", START, 1.0), ("A", "m", START + dt.timedelta(days=10), 2.0)], "ticker string, metric string, known date, value double")
    grid = spark.createDataFrame([("A", "m", START + dt.timedelta(days=i)) for i in (-1, 0, 5, 10, 99)], "ticker string, metric string, date date")
    got = [r.value for r in asof(grid, facts, ["ticker", "metric"], "date", "known", ["value"]).orderBy("date").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 2.0]


def test_drift_sees_a_shift(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v), True) for v in rng.normal(0, 1, 2000)] + [("a", float(v), False) for v in rng.normal(1, 1, 500)]
    rows += [("b", float(v), i < 2000) for i, v in enumerate(rng.normal(0, 1, 2500))]
    got = {r.factor: r.level for r in reporting.psi(spark.createDataFrame(rows, "factor string, x double, ref boolean"), F.col("ref")).collect()}
    assert got == {"a": "material", "b": "stable"}


def test_retrieval_and_grounding(spark):
    c = spark.createDataFrame([("1", "the quick fox of revenue"), ("2", "revenue revenue grew"), ("3", "nothing here")], "chunk_id string, text string")
    assert [r.chunk_id for r in retrieval.top(retrieval.bm25(c, ["revenue"]), 5).orderBy("place").collect()] == ["2", "1"]
    g = spark.createDataFrame([("Sales rose 12.5% to $3.2 billion", "sales of $3,200 million, up 12.5%"), ("Sales were $4 billion", "sales of $3 billion")], "a string, e string")
    assert [r[0] for r in g.select(text.grounding(F.col("a"), F.col("e"))).collect()] == [[], ["$4 billion"]]


def plain_grounding(answer, evidence):
    """The same in plain Python: amounts are compared by canonical form, whole ones under 13 are no claims."""
    import re

    form = re.compile(text.AMOUNT, re.I)

    def canonical(token):
        m = re.match(r"^(-?\d+(?:\.\d+)?)\s*(million|billion|trillion|bn|mm|%|x)?$", token.strip().lower().replace("$", "").replace(",", "").strip())
        if not m:
            return None
        value, unit = float(m[1]) * text.UNITS.get(m[2] or "", 1), "" if m[2] in text.UNITS else m[2] or ""
        return f"{int(value)}{unit}" if value == int(value) else f"{value:g}{unit}"

    held, loose = {canonical(x) for x in form.findall(evidence)}, set()
    for token in form.findall(answer):
        bare = (norm := canonical(token)).rstrip("%x")
        if not (abs(float(bare)) < 13 and "." not in bare) and norm not in held:
            loose.add(token.strip().lower())
    return sorted(loose)


CLAIMS = [
    ("Revenue was $1,234.5 million.", "we booked 1234.5 million"), ("up 5%, 3x and 12.0 in 12 quarters", ""), ("13 units, 13% and 12.5%", "12.50%"), ("EPS of $2.31", "eps 2.310"),
    ("2.3 billion", "2,300 million"), ("$3.2bn or 3,200 mm", "3200000000"), ("lost -4.5 and -14", "-4.5"), ("a1.5 v2.0 1.5x", "1.5"), ("$ 7.25 in 2024", "7.25 2024"), ("1.23456789", "1.23457"), ("0.5%", ".5%"), ("", "1"),
]


def test_grounding_follows_plain_python(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").select("text").collect()
    rows = CLAIMS + [(b.text or "", a.text or "") for a, b in zip(talk, talk[1:])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a string, e string").select("i", text.grounding(F.col("a"), F.col("e")).alias("g")).collect()
    assert {r.i: r.g for r in got} == {i: plain_grounding(a, e) for i, (a, e) in enumerate(rows)}
    assert plain_grounding("up 5%, 3x and 12.0 in 12 quarters", "") == [] and plain_grounding("2.5x", "2x") == ["2.5x"]


def test_numeric_grounding_query(spark, sf_dir):
    from tidemark.plans import registry

    before, want = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want[r.conv_id, r.turn] = ",".join(plain_grounding(r.text or "", before.get(r.conv_id, "")))
        before[r.conv_id] = r.text or ""
    assert {(r.conv_id, r.turn): r.ungrounded for r in registry.queries()["numeric_grounding"](spark, sf_dir).collect()} == want


def test_citations_may_hold_hyphens(spark):
    rows = spark.createDataFrame([("Margins rose [acme-10k::3] and [a_b::0], not [x:1] or [no id::2].",)], "t string").select(text.citations(F.col("t"))).first()[0]
    assert sorted(rows) == ["a_b::0", "acme-10k::3"]


def test_sections_and_chunks(spark):
    one = lambda t, now=None: spark.createDataFrame([(t, now)], "t string, now string").select(text.detect_section(F.col("t"), current=F.col("now"))).first()[0]
    assert one("Item 1A. Risk Factors") == "Item 1A - Risk Factors" and one("no heading", "kept") == "kept"
    assert one("Table of contents " + "." * 60 + " Item 1A. Risk Factors " + "." * 200, None) is None
    filing = "Item 1A. Risk Factors\n\n" + "\n \n".join("word " * 100 + str(i) for i in range(6)) + "\n\nItem 7. Management's Discussion\n\nEnd."
    rows = text.chunk_documents(spark.createDataFrame([("acme-10k", filing)], "doc_id string, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == [f"acme-10k::{i}" for i in range(len(rows))] and len(rows) > 2
    assert rows[0].section == "Item 1A - Risk Factors" and rows[-1].section == "Item 7 - MD&A" and rows[-1].text.endswith("End.")
    assert all(r.char_count == len(r.text) for r in rows) and rows[1].text.startswith(rows[0].text[-200:].strip())


def test_ingestion_is_idempotent(spark):
    page = "<p>" + "growth and revenue " * 200 + "</p>"
    pages = spark.createDataFrame([(1, page, "10-K"), (2, page, "10-K"), (3, "<p>short</p>", "10-Q")], "doc_id long, html string, form string")
    assert [(r.doc_id, r.form, len(r.content_hash)) for r in text.ingested(pages).collect()] == [(1, "10-K", 32)]


def test_folds_leave_out_the_remainder(spark):
    dates = spark.createDataFrame([(START + dt.timedelta(days=i),) for i in range(357)], "date date")
    got = [(f.train_end, f.test_start, f.test_end) for f in ml.folds(dates, 4, 21).orderBy("fold").collect()]
    assert got == [(142 + 53 * k - 21, 142 + 53 * k + 5, 142 + 53 * (k + 1)) for k in range(4)] and got[-1][2] == 354


def test_a_candidate_beats_the_linear_model(spark):
    rows = [("logistic", 0.55, 0.56, 0.03, 0.02), ("strong", 0.56, 0.57, 0.05, 0.02), ("weak", 0.56, 0.55, 0.025, 0.02), ("flat", 0.5, 0.5, 0.0, 0.0), ("tied", 0.5, 0.58, 0.05, 0.0), ("none", 0.5, 0.6, None, 0.0)]
    got = {r.model: (r.place, r.verdict) for r in ml.model_summary(spark.createDataFrame(rows, "model string, accuracy double, auc double, ic double, lift double")).collect()}
    assert got == {
        "tied": (1, "marginal_no_usable_edge"), "strong": (2, "candidate_signal"), "logistic": (3, "marginal_no_usable_edge"), "weak": (4, "marginal_no_usable_edge"), "flat": (5, "no_edge_detected"), "none": (6, "no_edge_detected"),
    }


def test_rising_confidence_is_more_confident(spark):
    words = "plain " * 120
    rows = [("A", 1, words + "may could might"), ("A", 2, words + "will strong record"), ("A", 3, words + "will strong record"), ("A", 4, words + "possibly"), ("A", 5, "may be short")]
    t = text.tone(F.col("text"))
    counted = spark.createDataFrame(rows, "ticker string, filing long, text string").select("ticker", "filing", t[0].alias("words"), t[1].alias("hedges"), t[2].alias("confident"))
    rated = text.tone_rates(counted)
    assert {r.filing: r.status for r in rated.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "too_short"}
    got = {r.filing: r.direction for r in text.tone_change(rated.filter("status = 'ok'")).collect()}
    assert got == {1: None, 2: "more_confident", 3: "unchanged", 4: "more_hedged"}


def test_nearest_rank_needs_no_group_in_one_task(spark):
    rng = np.random.default_rng(12)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 500)] + [("b", 1.0), ("c", None)]
    got = {r.g: (r.p50, r.p95) for r in reporting.nearest_rank(spark.createDataFrame(rows, "g string, x double"), "g", "x", {"p50": 0.5, "p95": 0.95}).collect()}
    x = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (x[250], x[475]), "b": (1.0, 1.0)}


def test_retrieval_is_evaluated_on_every_item(spark, sf_dir):
    """Against a plain loop over all items and documents."""
    import math
    import re
    from collections import Counter

    from tidemark.plans import registry

    split = lambda t: re.findall(r"[a-z0-9$%.\-]+", (t or "").lower())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text[:60] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    tf = {d: Counter(split(t)) for d, t in docs.items()}
    size, df = {d: sum(c.values()) for d, c in tf.items()}, Counter(w for c in tf.values() for w in c)
    mean, places = sum(size.values()) / len(docs), []
    for expected in items.values():
        asked, score = Counter(split(expected)), {}
        for d, c in tf.items():
            if held := asked.keys() & c.keys():
                weight = lambda w, c=c, d=d: c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[d] / mean))
                score[d] = sum(asked[w] * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * weight(w) for w in held)
        best = sorted(score, key=lambda d: (-round(score[d], 9), d))[:10]
        places.append(next((i + 1 for i, d in enumerate(best) if expected in docs[d]), None))
    got = registry.queries()["retrieval_eval_all"](spark, sf_dir).first()
    assert got.queries == len(items) > 20
    assert got.hit_rate == pytest.approx(sum(p is not None for p in places) / len(items), abs=1e-6)
    assert got.mrr == pytest.approx(sum(1 / p for p in places if p) / len(items), abs=1e-6)


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_best_of_each_query_need_no_scores_of_all_chunks(spark, monkeypatch, cells):
    """The same places as from joins, with many copies of a text and an empty, a null and an unmatched one; nothing is exploded by query."""
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(rng.choice([f"w{j}" for j in range(12)], 9))) for i in rng.permutation(60)] + [(100 - i, "w1 w2 w3") for i in range(12)] + [(200, ""), (201, None), (202, "zz")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([("a", "w1 w2 w1"), ("b", "W3 w4 none"), ("c", "none"), ("d", " ".join(f"w{j}" for j in range(12)))], "query string, text string")
    want = sorted(map(tuple, retrieval.top_each(retrieval.bm25_each(chunks, queries), 4).collect()))
    monkeypatch.setattr(retrieval, "CELLS", cells)
    twice = chunks.union(chunks.filter("chunk_id = 7"))
    again = sorted(map(tuple, retrieval.top_each(retrieval.bm25_each(twice, queries), 4).collect()))
    assert sorted(map(tuple, retrieval.best_each(twice, queries, 4).collect())) == again
    monkeypatch.setattr(retrieval, "bm25_each", None)
    assert sorted(map(tuple, retrieval.best_each(chunks, queries, 4).collect())) == want and len(want) == 12


def test_long_pages_keep_their_tail(spark):
    html = "<p>" + "word " * 100_000 + "tail</p>"
    assert spark.createDataFrame([(html,)], "html string").select(text.html_to_text(F.col("html"))).first()[0] == "word " * 100_000 + "tail"


def test_chunks_hold_the_text(spark):
    d = spark.createDataFrame([(1, "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(20)))], "doc_id long, text string")
    rows = text.chunk_documents(d).orderBy("chunk_index").collect()
    assert len(rows) > 4 and all(len(r.text) <= 1500 for r in rows) and all(any(f"paragraph {i} " in r.text for r in rows) for i in range(20))


def test_generated_universe_is_reproducible(spark):
    a, b = (generate.universe(spark, 2, 300, 3).orderBy("ticker", "date").collect() for _ in range(2))
    assert a == b and len(a) == 600 and a[0].date.year == 2024


def test_payloads_become_rows(spark):
    raw = spark.createDataFrame([("A", '{"facts": {"Assets": {"units": {"USD": [{"end": "2024-03-31", "filed": "2024-05-01", "val": 7.5, "form": "10-Q"}, {"end": null, "filed": "2024-05-01", "val": 1}]}}}}'), ("B", None), ("C", "{}")], "ticker string, payload string")
    rows = parse.company_facts(raw).collect()
    assert [(r.ticker, r.tag, r.unit, str(r.period_end), r.value, r.form) for r in rows] == [("A", "Assets", "USD", "2024-03-31", 7.5, "10-Q")]
    s = spark.createDataFrame([("1704067200",), ("2024-01-01T00:00:00Z",), ("soon",), (None,)], "x string").select(F.unix_timestamp(parse.published(F.col("x"))).alias("s"))
    assert [r.s for r in s.collect()] == [1704067200, 1704067200, None, None]
    d, v = parse.series_line(F.col("x"))
    assert [tuple(map(str, r)) for r in spark.createDataFrame([("2024-01-02,3.5",), ("2024-01-03,.",)], "x string").select(d, v).collect()] == [("2024-01-02", "3.5"), ("2024-01-03", "None")]


def test_results_are_appended(spark, tmp_path):
    m = sinks.metrics(spark.createDataFrame([("s", 1.5, 2)], "strategy string, sharpe double, n int"), "r1")
    for _ in range(2):
        sinks.append(m, str(tmp_path / "m"), ["run_id"])
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sorted((r.metric, r.value) for r in rows) == [("n", 2.0), ("n", 2.0), ("sharpe", 1.5), ("sharpe", 1.5)]


def test_plans_are_bounded():
    p = research.plan_for("Does momentum of Brand#1 and Brand#2 last a quarter?")
    assert p.universe == ("Brand#1", "Brand#2") and p.families == ("momentum",) and p.horizon == 13
    with pytest.raises(ValueError):
        research.Plan("q", n_days=10)
    assert research.revised(p, ("lengthen_history", "widen_universe"))[0].n_days == 1512 and research.revised(p, ("widen_universe",))[0].universe == ()
    assert research.revised(p, ())[0] == research.replace(p, revisions=1) and research.revised(p, ("reduce_strategy_count", "drop_leaking_factors"))[1] == []
    deep = research.plan_for("Does deep boosting on sentiment and value pay over 6 years?")
    assert deep.models == research.MODELS and deep.n_days == 1512 and deep.families == ("value", "sentiment")
    assert research.revised(deep, ("drop_leaking_factors", "reduce_strategy_count"))[0].models == ("logistic", "boosting")
    with pytest.raises(ValueError, match="bounds"):
        research.plan_for(" ".join(f"Brand#{i}" for i in range(61)))


def _loss(method, mu, c, w, penalty=0.0, previous=None):
    """What each method minimises, by the definitions."""
    v, k = w @ c @ w, len(w)
    x = w * (c @ w)
    base = {"min_variance": v, "mean_variance": -(w @ mu - 0.5 * 3.0 * v), "risk_parity": 1e4 * ((x - v / k) ** 2).sum(), "max_diversification": -(w @ np.sqrt(np.diag(c))) / np.sqrt(v)}[method]
    return base + (penalty * np.abs(w - previous).sum() if previous is not None else 0.0)


@pytest.mark.parametrize("method", ["min_variance", "mean_variance", "risk_parity", "max_diversification"])
@pytest.mark.parametrize("penalty", [0.0, 1e-5, 0.001])
def test_no_shift_of_weight_lowers_the_loss(method, penalty):
    """An independent optimum: moving any weight between two names within the bounds doesn't help."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        k = 4 + seed * 2
        x = rng.normal(0.001, rng.uniform(0.005, 0.04, k), (60, k)) + rng.normal(0, 0.01, (60, 1))
        mu, c = x.mean(axis=0), portfolio.shrunk(x)
        previous = portfolio.nearest_book(rng.random(k) / 3, 0.4) if penalty else None
        w = portfolio.solved(mu, c, method, previous, penalty)
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and (w <= 0.4 + 1e-9).all()
        loss = _loss(method, mu, c, w, penalty, previous)
        scale = max(abs(_loss(method, mu, c, np.full(k, 1 / k), penalty, previous)), 1e-9)
        for step in (0.03, 0.003):
            for i in range(k):
                for j in range(k):
                    other = w.copy()
                    other[i] -= step
                    other[j] += step
                    if i != j and other[i] >= 0 and other[j] <= 0.4:
                        assert _loss(method, mu, c, other, penalty, previous) >= loss - 1e-6 * scale


def test_mean_variance_has_half_the_aversion():
    """Variances 1, 1, 4, 2 and one mean: without bounds w is proportional to the means over the variances, less a level."""
    c, mu = np.diag([0.04, 0.05, 0.16, 0.08]), np.array([0.06, 0.05, 0.02, 0.04])
    w = portfolio.solved(mu, c, "mean_variance", cap=1.0)
    slope = mu - 3.0 * c @ w
    held = w > 1e-6
    assert slope[held] == pytest.approx(slope[held][0], abs=1e-6) and (slope[~held] <= slope[held][0] + 1e-6).all()


def test_risk_parity_meets_the_cap():
    c = np.diag([0.0001, 0.01, 0.01, 0.01])
    w = portfolio.solved(np.zeros(4), c, "risk_parity")
    assert w.max() <= 0.4 + 1e-9 and w[0] == pytest.approx(0.4, abs=1e-6) and w[1:] == pytest.approx([0.2] * 3, abs=1e-6)
    free = portfolio.solved(np.zeros(4), c, "risk_parity", cap=1.0)
    assert free * (c @ free) == pytest.approx(np.full(4, free @ c @ free / 4), rel=1e-4)


def test_nearest_book_is_nearest():
    rng = np.random.default_rng(3)
    for pull in (0.0, 0.05, 2.0):
        for k in (2, 3, 7):
            v, p = rng.normal(0.3, 0.5, k), portfolio.nearest_book(rng.random(k), 0.5)
            w = portfolio.nearest_book(v, 0.5, pull, p)
            loss = lambda x, v=v, p=p, pull=pull: ((x - v) ** 2).sum() / 2 + pull * np.abs(x - p).sum()
            others = [portfolio.nearest_book(w + rng.normal(0, s, k), 0.5) for s in (0.001, 0.03, 0.5) for _ in range(200)]
            assert w.sum() == pytest.approx(1) and w.max() <= 0.5 + 1e-12 and min(map(loss, others)) >= loss(w) - 1e-12
    assert portfolio.nearest_book(np.array([5.0, 0.0]), 0.1) == pytest.approx([0.5, 0.5])


@pytest.mark.parametrize("penalty", [0.0, 0.001])
@pytest.mark.parametrize(("lookback", "every"), [(30, 8), (32, 8)])
def test_allocations_match_a_dense_matrix(spark, penalty, lookback, every):
    """Moments of windows from sums of blocks, and a sequential walk, against numpy on the dates-by-names matrix, with missing returns."""
    rng = np.random.default_rng(9)
    dates, names = [START + dt.timedelta(days=i) for i in range(80)], ["A", "B", "C", "D", "E"]
    x = rng.normal(0, [0.01, 0.02, 0.03, 0.015, 0.02], (80, 5)) + rng.normal(0, 0.01, (80, 1))
    gone = rng.random((80, 5)) < 0.1
    gone[:, 0] = False
    x[gone] = 0.0
    returns = spark.createDataFrame([(n, d, float(x[i, j])) for i, d in enumerate(dates) for j, n in enumerate(names) if not gone[i, j]], "ticker string, date date, ret double")
    means, cov, shares = portfolio.window_moments(portfolio.placed(returns), lookback, every, 5)
    got = {(r.j, r.a, r.b): r.cov for r in cov.collect()}
    mean = {(r.j, r.ticker): r.m for r in means.collect()}
    share = {r.j: r.share for r in shares.collect()}
    for j in range(5):
        part = x[every * j : every * j + lookback]
        want = portfolio.shrunk(part)
        assert [[got[j, a, b] for b in names] for a in names] == [pytest.approx(row) for row in want.tolist()]
        assert [mean[j, n] for n in names] == pytest.approx(part.mean(axis=0))
        plain = np.cov(part.T, bias=True)
        assert share[j] == pytest.approx(1 - want[0, 1] / plain[0, 1])
    want = {}
    for method in portfolio.METHODS:
        w = None
        for t in range(lookback, 80):
            turn = None
            if (t - lookback) % every == 0:
                new = portfolio.allocate(x[t - lookback : t], method, w, penalty)
                turn, w = None if w is None else float(np.abs(new - w).sum()), new
                assert (w <= 0.4 + 1e-9).all()
            want[method, dates[t]] = (float(x[t] @ w), turn)
    walk = {(r.method, r.date): (r.ret, r.turnover) for r in portfolio.walk_forward(returns, lookback, every, penalty).collect()}
    assert walk.keys() == want.keys() and all(walk[k][0] == pytest.approx(want[k][0], abs=1e-6) and (walk[k][1] is None) == (want[k][1] is None) for k in want)
    assert all(walk[k][1] == pytest.approx(want[k][1], abs=1e-4) for k in want if want[k][1] is not None)
    assert portfolio.walk_forward(returns, 70, 8).count() == 0 and portfolio.walk_forward(returns, 45, 8).count() == 0


def test_equal_weight_tells_turnover_and_costs(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    returns = spark.createDataFrame([(t, day(i), 0.01 * i) for t in ("A", "B") for i in range(6) if (t, i) != ("B", 4)], "ticker string, date date, ret double")
    got = sorted(portfolio.equal_weight(returns, 3).collect(), key=lambda r: r.date)
    assert [(r.date, r.turnover) for r in got] == [(day(3), 1.0), (day(4), 0.0), (day(5), 0.0)]
    assert [r.ret for r in got] == pytest.approx([0.03, 0.02, 0.05]) and [r.net for r in got] == pytest.approx([0.0297, 0.02, 0.05])


def test_in_sample_books_take_whole_dates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.001, [0.01, 0.02, 0.03], (60, 3))
    gone = rng.random((60, 3)) < 0.05
    names = ["A", "B", "C"]
    returns = spark.createDataFrame([(n, START + dt.timedelta(days=i), float(x[i, j])) for i in range(60) for j, n in enumerate(names) if not gone[i, j]], "ticker string, date date, ret double")
    whole = x[~gone.any(axis=1)]
    rows = {(r.method, r.ticker): r for r in portfolio.in_sample(returns).collect()}
    for method in portfolio.METHODS:
        w = portfolio.allocate(whole, method)
        assert [rows[method, n].w for n in names] == pytest.approx(w, abs=1e-6)
        assert sum(rows[method, n].m for n in names) == pytest.approx(w @ whole.mean(axis=0)) and sum(rows[method, n].v for n in names) == pytest.approx(w @ portfolio.shrunk(whole) @ w)
    assert portfolio.in_sample(returns.filter(F.col("date") < START + dt.timedelta(days=30))).count() == 0


def test_a_universe_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "MOST_NAMES", 3)
    with pytest.raises(ValueError, match="universe"):
        portfolio.universe(spark.createDataFrame([(x,) for x in "ABCD"], "ticker string"))
