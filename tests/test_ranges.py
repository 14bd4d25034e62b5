import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ranges import counted, mid_rank, quantiles
from tidemark.operators import ml, reporting


@pytest.fixture(scope="module")
def values(spark):
    """A group that holds nearly all rows, with ties; a small one; one of a single value; one of nulls."""
    rng = np.random.default_rng(3)
    rows = [("big", float(x)) for x in rng.integers(0, 400, 5000)] + [("small", float(x)) for x in (5, 1, 9, 2)] + [("one", 7.0), ("none", None), ("big", None)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(5)


def of(rows, g):
    return np.array([x for k, x in rows if k == g and x is not None])


def test_quantiles_interpolate(values):
    rows, df = values
    shares = [0.0, 0.1, 0.25, 0.5, 0.333, 0.99, 1.0]
    got = {r.g: r.q for r in quantiles(df, ["g"], "x", shares).collect()}
    assert got.keys() == {"big", "small", "one"}
    for g in got:
        assert got[g] == pytest.approx(np.quantile(of(rows, g), shares))


def test_ranks_share_ties(values):
    rows, df = values
    got = {(r.g, r.x): (r.rank, r.n, r.total) for r in counted(df, ["g"], "x").withColumn("rank", mid_rank()).collect()}
    for g in ("big", "small", "one"):
        x = of(rows, g)
        for v in np.unique(x):
            assert got[g, v] == ((x < v).sum() + ((x == v).sum() + 1) / 2, (x == v).sum(), len(x))


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(1)
    score, y = rng.integers(0, 30, 300) / 30, rng.integers(0, 2, 300)
    rows = [(0, float(s), int(v)) for s, v in zip(score, y)] + [(1, 0.5, 1), (1, 0.7, 1)]
    got = {r.fold: r.auc for r in ml.auc(spark.createDataFrame(rows, "fold int, score double, label int"), ["fold"]).collect()}
    d = score[y == 1][:, None] - score[y == 0][None, :]
    assert got[0] == pytest.approx(((d > 0).sum() + (d == 0).sum() / 2) / d.size) and got[1] is None


@pytest.mark.parametrize("task", [lambda df: reporting.psi(df.withColumn("factor", F.lit("f")).withColumn("ref", F.col("id") % 2 == 0), F.col("ref")), lambda df: ml.auc(df.select(F.lit(0).alias("fold"), F.col("x").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label")), ["fold"])])
def test_no_task_gets_a_whole_group(spark, task):
    """One group of 40,000 distinct values: no window or buffer runs over the group itself, only over its partitions."""
    df = spark.range(40_000).select("id", (F.hash("id") % 1_000_003).cast("double").alias("x"))
    out = task(df)
    assert out.count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_signals_per_fold(spark):
    rng = np.random.default_rng(5)
    import datetime as dt

    rows = []
    for f in (0, 1):
        for i in range(12 if f == 0 else 5):
            x = rng.normal(size=9)
            r = (x if f == 0 else -x) + rng.normal(size=9) * 0.3
            rows += [(f, dt.date(2020, 1, 1) + dt.timedelta(days=i), f"T{k}", float(a), float(b), int(b > 0)) for k, (a, b) in enumerate(zip(x, r))]
    got = {r.fold: r for r in ml.signal_tests(spark.createDataFrame(rows, "fold int, date date, ticker string, score double, fwd_return double, label int"), ["fold"], 2).collect()}
    assert got[0].ic > 0.7 and got[0].ic_dates == 12 and got[0].signal > 0 and got[0].periods == 12 and got[0].t_hac > 2 and got[0].p_hac < 0.05
    assert got[1].ic < -0.7 and got[1].periods == 5 and got[1].t_hac is None
