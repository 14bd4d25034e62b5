import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, ml
from tidemark.operators.boosting import Settings

FEATURES = ["a", "b", "c", "d"]


def rows_of(n, seed=1, folds=2):
    """Features with ties and jumps; the label follows two of them."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(folds):
        x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.normal(size=n), np.zeros(n)])
        y = (x[:, 0] + (x[:, 1] == 3) * 2 - 1 + rng.normal(0, 0.5, n) > 0).astype(float)
        out += [(f, int(rng.integers(-(2**62), 2**62)), float(v), *map(float, u)) for u, v in zip(x, y, strict=True)]
    return out


def grown(x, y, key, fold, edges, s):
    """Trees as (feature, cut, value) by level order, one after the other, with a loop over every split of every node."""
    bins = np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)])
    margin, trees = np.zeros(len(y)), []
    for t in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        sample = boosting.sampled_rows(key, fold, t, s)
        columns = boosting.sampled_columns(len(edges), fold, t, s)
        tree, where = {}, {0: np.arange(len(y))}
        for i in range(2 ** (s.depth + 1) - 1):
            if i not in where:
                continue
            own = where[i][sample[where[i]]]
            value = -s.rate * g[own].sum() / (h[own].sum() + s.ridge)
            best = (boosting.LEAST_GAIN, -1, 0)
            score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + s.ridge)
            if i < 2**s.depth - 1:
                for f in columns:
                    for b in range(len(edges[f])):
                        left, right = own[bins[own, f] <= b], own[bins[own, f] > b]
                        if h[left].sum() >= s.least_hessian and h[right].sum() >= s.least_hessian:
                            gain = round(score(left) + score(right) - score(own), 9)
                            if gain > best[0]:
                                best = (gain, f, b)
            tree[i] = (best[1], best[2], value, best[0] if best[1] >= 0 else 0.0)
            if best[1] >= 0:
                where[2 * i + 1], where[2 * i + 2] = where[i][bins[where[i], best[1]] <= best[2]], where[i][bins[where[i], best[1]] > best[2]]
        for i in tree:
            if tree[i][0] < 0:
                margin[where[i]] += tree[i][2]
        trees.append(tree)
    return trees, margin


@pytest.mark.parametrize("s", [Settings(trees=7, bins=16), Settings(trees=3, depth=2, rows=1.0, columns=1.0, rate=0.3, least_hessian=5.0, seed=9)])
def test_trees_equal_plain_loops(spark, monkeypatch, s):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    data = rows_of(300)
    df = spark.createDataFrame(data, "fold int, key long, label double, a double, b double, c double, d double").repartition(3)
    edges = boosting.bin_edges(df, FEATURES, s.bins)
    trees = boosting.fit(df, FEATURES, edges, s)
    scores = {r["key"]: r["score"] for r in boosting.predict(df, FEATURES, edges, trees, ["fold", "key"]).collect()}
    for fold in (0, 1):
        own = [r for r in data if r[0] == fold]
        x, y, key = np.array([r[3:] for r in own]), np.array([r[2] for r in own]), np.array([r[1] for r in own])
        want, margin = grown(x, y, key, fold, edges[fold], s)
        for tree, plain in zip(trees[fold], want, strict=True):
            used = {i: (f, b, v, g) for i, (f, b, v, g) in plain.items()}
            assert {i: (int(tree.feature[i]), int(tree.bin[i])) for i in used} == {i: (f, b if f >= 0 else 0) for i, (f, b, _, _) in used.items()}
            assert [tree.value[i] for i in used] == pytest.approx([v for _, _, v, _ in used.values()]) and [tree.gain[i] for i in used] == pytest.approx([g for *_, g in used.values()])
        assert [scores[k] for k in key] == pytest.approx(1 / (1 + np.exp(-margin)))
        assert np.mean((1 / (1 + np.exp(-margin)) > 0.5) == y) > 0.7
    found = boosting.importances(trees, FEATURES)
    for fold in (0, 1):
        shares = {f: (i, n) for k, f, i, n in found if k == fold}
        assert sum(i for i, _ in shares.values()) == pytest.approx(1) and shares["d"] == (0.0, 0) and max(shares, key=lambda f: shares[f][1]) in ("a", "b")


@pytest.mark.parametrize("rows_per_task", [100_000, 100])
def test_levels_take_no_more_tasks_for_more_shuffle_partitions(spark, monkeypatch, rows_per_task):
    """600 rows in one task and in six; the trees are the same, and each of the six jobs of two trees has few tasks."""
    df = spark.createDataFrame(rows_of(300), "fold int, key long, label double, a double, b double, c double, d double").repartition(3)
    s = Settings(trees=2, bins=16)
    edges = boosting.bin_edges(df, FEATURES, s.bins)
    want = boosting.fit(df, FEATURES, edges, s)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", rows_per_task)
    plans, summed = [], boosting._summed
    monkeypatch.setattr(boosting, "_summed", lambda rows, *a: plans.append(rows.rdd.getNumPartitions()) or summed(rows, *a))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 90)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("levels", "")
        got = boosting.fit(df, FEATURES, edges, s)
        stages = {i for j in tracker.getJobIdsForGroup("levels") for i in tracker.getJobInfo(j).stageIds}
        assert max(tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i)) <= boosting.ADDERS
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(plans) == 6 and max(plans) <= max(1, 600 // rows_per_task)
    for f in want:
        for x, y in zip(want[f], got[f], strict=True):
            assert x.feature.tolist() == y.feature.tolist() and x.bin.tolist() == y.bin.tolist() and x.value == pytest.approx(y.value)


def test_bins_are_even_ranks(spark):
    x = np.random.default_rng(0).normal(size=999)
    df = spark.createDataFrame([(0, float(v), float(i % 3)) for i, v in enumerate(x)] + [(1, 1.0, None)], "fold int, a double, b double")
    edges = boosting.bin_edges(df, ["a", "b"], 10)
    ranks = np.searchsorted(np.sort(x), edges[0][0], "right")
    assert len(edges[0][0]) == 9 and np.abs(ranks - 99.9 * np.arange(1, 10)).max() <= 1
    assert edges[0][1].tolist() == [0.0, 1.0, 2.0] and edges[1][0].tolist() == [1.0] and edges[1][1].tolist() == []


def test_folds_pass_their_gates(spark):
    """Too few rows to learn from or to test on, one class only, and a panel that is too short."""
    dates = spark.range(200).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("i"))
    panel = dates.crossJoin(spark.createDataFrame([("A",), ("B",)], "ticker string")).withColumns({"x": F.sin("i"), "fwd_return": F.when(F.col("i") < 60, 1.0).otherwise(F.cos(F.col("i") * 3))})
    table = spark.createDataFrame([(0, 50, 80, 100), (1, 49, 80, 120), (2, 90, 100, 109), (3, 90, 100, 110), (4, 60, 100, 120)], "fold int, train_end long, test_start long, test_end long")
    assert {r["fold"] for r in ml.in_folds(panel, table, ["x"]).select("fold").distinct().collect()} == {3}
    assert ml.in_folds(panel.filter("i < 124"), table, ["x"]).count() == 0
    for model in ("logistic", "boosting"):
        assert ml.out_of_sample(panel.filter("i < 124"), table, ["x"], model).count() == 0


def test_a_constant_feature_stays_out(spark):
    data = rows_of(200, seed=4, folds=1)
    df = spark.createDataFrame(data, "fold int, key long, label double, a double, b double, c double, d double").withColumn("train", F.lit(True))
    beta = ml.newton_logistic(ml.scaled_in_folds(df, FEATURES), FEATURES)[0]
    assert beta[4] == pytest.approx(0, abs=1e-9) and beta[1] > 0.5 and np.isfinite(beta).all()
