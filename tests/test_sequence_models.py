import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ml
from tidemark.operators import sequence_models as sm


@pytest.mark.parametrize("kind", sm.KINDS)
@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_gradients_equal_differences(kind, rate):
    rng = np.random.default_rng(2)
    x, y, key = rng.normal(size=(5, 6, 3)), np.array([1.0, 0, 1, 1, 0]), rng.integers(0, 2**62, 5)
    p = sm.initial(kind, 3, 1, 6)
    if kind == "transformer":
        p["pos"] = rng.normal(size=p["pos"].shape) * 0.1
    loss = lambda v: sm.losses(sm.NETWORKS[kind](sm.shaped(v, p), x, key, rate)[0], y, 1.7).sum()
    logits, backward = sm.NETWORKS[kind](p, x, key, rate)
    g, at = backward(sm._slopes(logits, y, 1.7)), sm.flat(p)
    assert g.keys() == p.keys()
    flat = sm.flat(g)
    for i in rng.choice(len(at), 250, replace=False):
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert flat[i] == pytest.approx((loss(at + step) - loss(at - step)) / 2e-5, rel=1e-4, abs=1e-6)


def test_masks_follow_the_rows():
    key = np.arange(4000)
    m = sm._mask(key, 1, (4000, 48), 0.3)
    assert set(np.unique(m)) == {0.0, 1 / 0.7} and m.mean() == pytest.approx(1, abs=0.01)
    assert (sm._mask(key[::-1], 1, (4000, 48), 0.3)[::-1] == m).all() and (sm._mask(key, 2, (4000, 48), 0.3) != m).any()


def _samples(spark, n=400, folds=(0, 1)):
    """The label is the sign of the last steps' mean of the first feature."""
    rng = np.random.default_rng(7)
    rows = []
    for f in folds:
        for i in range(n):
            x = rng.normal(size=(8, 2)) * [3, 1] + [5, 0]
            rows.append((f, i < n * 4 // 5, f"T{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 5), float(x[-3:, 0].mean() - 5 + rng.normal() * 0.2), x.astype(np.float32).tolist()))
    return spark.createDataFrame(rows, "fold int, train boolean, ticker string, date date, fwd_return double, sequence array<array<float>>").repartition(3)


def test_standardised_by_training_with_a_late_tail(spark):
    raw = _samples(spark)
    got = sm.standardised(raw, 2).collect()
    train = np.array([r.x for r in got if r.train and r.fold == 0]).reshape(-1, 2)
    assert len(got) == 800 and np.abs(train.mean(axis=0)).max() < 1e-6 and np.abs(train.std(axis=0) - 1).max() < 1e-6
    own = [r for r in got if r.train and r.fold == 0]
    late = [r for r in own if r.tail]
    assert len(late) == 60 and min(r.date for r in late) > max(r.date for r in own if not r.tail) and not any(r.tail for r in got if not r.train)


def test_a_step_adds_up_all_tasks(spark, monkeypatch):
    """One epoch of two batches against the same steps on all rows in one place."""
    monkeypatch.setattr(sm, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(sm, "SLICE", 1000)
    s = sm.Settings(epochs=1, steps=2)
    rows = sm.standardised(_samples(spark, 160), 2).cache()
    params, history = sm.fit(rows, 2, s=s)
    held = [r for r in rows.collect() if r.train]
    for f in (0, 1):
        own = [r for r in held if r.fold == f]
        x, y, key, tail = np.array([r.x for r in own]).reshape(len(own), 8, 2), np.array([r.label for r in own]), np.array([r.key for r in own]), np.array([r.tail for r in own])
        share = y[~tail].mean()
        weight = (1 - share) / share
        for kind in sm.KINDS:
            p = sm.initial(kind, 2, s.seed + f, 8)
            at, m, v, seen = sm.flat(p), 0.0, 0.0, [0.0, 0]
            with np.errstate(over="ignore"):
                salt = sm.mixed(key.astype(np.uint64) ^ np.uint64(s.seed * 10_007))
            for b in range(2):
                use = ~tail & (salt % np.uint64(2) == np.uint64(b))
                logits, backward = sm.NETWORKS[kind](sm.shaped(at, p), x[use], salt[use], s.dropout)
                seen = [seen[0] + sm.losses(logits, y[use], weight).sum(), seen[1] + use.sum()]
                g = sm.clipped(sm.flat(backward(sm._slopes(logits, y[use], weight))) / use.sum(), 1.0)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                at = at * (1 - s.rate * s.decay) - s.rate * (m / (1 - 0.9 ** (b + 1))) / (np.sqrt(v / (1 - 0.999 ** (b + 1))) + 1e-8)
            assert sm.flat(params[f, kind]) == pytest.approx(at, rel=1e-6, abs=1e-9)
            row = next(r for r in history if (r["fold"], r["kind"]) == (f, kind))
            assert row["train_loss"] == pytest.approx(seen[0] / seen[1]) and row["val_loss"] == pytest.approx(sm.losses(sm.NETWORKS[kind](sm.shaped(at, p), x[tail], None, 0.0)[0], y[tail], weight).mean())


def test_training_lowers_the_loss_and_ends_early(spark):
    rows = sm.standardised(_samples(spark, folds=(0,)), 2).cache()
    params, history = sm.fit(rows, 2, s=sm.Settings(epochs=14, patience=3, rate=0.02))
    for kind in sm.KINDS:
        loss = [h["val_loss"] for h in history if h["kind"] == kind]
        assert min(loss) < 0.75 * loss[0] and len(loss) <= 14
    got = sm.scores(rows.filter("NOT train"), params).collect()
    for kind in sm.KINDS:
        own = [r for r in got if r.model == kind]
        assert len(own) == 80 and np.mean([(r.score > 0.5) == (r.fwd_return > 0) for r in own]) > 0.8
    _, stopped = sm.fit(rows.withColumn("label", F.lit(1.0)), 2, ("lstm",), sm.Settings(epochs=14, patience=2, rate=1e-9))
    assert len(stopped) == 3


def test_folds_with_few_sequences_have_no_scores(spark, sf_dir):
    from tidemark.operators import factors
    from tidemark.sources import market

    panel = factors.price_factors(market.bars_walk(spark, sf_dir), factors.WEEKLY)
    few = panel.filter("date < '1996-06-01'")
    out, history = ml.sequence_training(few, ml.folds(ml.prepared(few, ["momentum_3m"]), horizon=4), ["momentum_3m"])
    assert out.count() == 0 and history == []
    names = ["momentum_3m", "mean_reversion"]
    table = ml.folds(ml.prepared(panel, names), horizon=4)
    out, history = ml.sequence_training(panel, table, names, settings=sm.Settings(epochs=1))
    rows = out.collect()
    tested = ml.sequences(ml.prepared(panel, names), names).join(ml.placed(ml.prepared(panel, names)).select("ticker", "date", "at"), ["ticker", "date"]).join(F.broadcast(table), (F.col("at") >= F.col("test_start")) & (F.col("at") < F.col("test_end")))
    assert {(r.fold, r.ticker, r.date) for r in rows if r.model == "lstm"} == {(r.fold, r.ticker, r.date) for r in tested.select("fold", "ticker", "date").collect()}
    assert len(rows) == 2 * tested.count() and all(0 < r.score < 1 for r in rows)
