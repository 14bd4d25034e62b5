"""Aggregate reports over runs, steps, models, documents and books, and drift of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import counted, quantiles
from tidemark.storage import small, written

PSI_LEVELS = (0.10, 0.25)


def leaderboard(results: DataFrame) -> DataFrame:
    """Of each model: folds, runs, mean and range of accuracy and ic; ordered by mean ic, missing ones last."""
    g = results.groupBy("model").agg(F.count("*").alias("folds"), F.count_distinct("run_id").alias("runs"), F.avg("accuracy").alias("accuracy"), F.avg("ic").alias("ic"), F.min("ic").alias("ic_min"), F.max("ic").alias("ic_max"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("ic"), "model")))


def agent_health(steps: DataFrame) -> DataFrame:
    """Of each agent: steps, seconds, status counts and rates, in one pass."""
    n = F.count("*")
    by = lambda s: F.count_if(F.col("status") == s)
    return steps.groupBy("agent").agg(
        n.alias("steps"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"), F.sum("seconds").alias("total_seconds"),
        by("failed").alias("failed"), by("degraded").alias("degraded"), (by("failed") / n).alias("failure_rate"), ((by("failed") + by("degraded")) / n).alias("trouble_rate"),
    )


def nearest_rank(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of shares): the value at place min(int(n q), n - 1) of a group's sorted values, however large a group is."""
    placed = counted(df, [by], value)
    at = lambda q: F.least(F.floor(F.col("total") * q), F.col("total") - 1)
    held = lambda q: F.when((F.col("end") > at(q)) & (F.col("end") - F.col("n") <= at(q)), F.col("x"))
    return placed.groupBy(by).agg(*[F.max(held(q)).alias(name) for name, q in shares.items()])


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each column, from one pass over grouping sets."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id(*columns).alias("g"), F.count("*").alias("n"))
    k = len(columns)
    name = F.coalesce(*[F.when(F.col("g") == (2**k - 1) - 2 ** (k - 1 - i), F.lit(c)) for i, c in enumerate(columns)])
    value = F.coalesce(*[F.when(F.col("g") == (2**k - 1) - 2 ** (k - 1 - i), F.col(c).cast("string")) for i, c in enumerate(columns)])
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def latest(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key the columns of its last row."""
    return df.groupBy(by).agg(F.max_by(F.struct(*columns), order).alias("s")).select(by, "s.*")


def psi(long: DataFrame, reference: Column, by: str = "factor", value: str = "x", bins: int = 10) -> DataFrame:
    """(factor, n_ref, n_new, psi, level): population stability of rows outside `reference` against those inside.

    Edges are the distinct deciles of the reference, with open ends; bins without rows count as one millionth. Deciles come from
    range partitions, so one factor may hold all rows.
    """
    rows = long.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("x"), reference.alias("ref"))
    deciles = quantiles(rows.filter("ref"), [by], "x", [i / bins for i in range(bins + 1)])
    sizes = rows.groupBy(by).agg(F.count_if("ref").alias("n_ref"), F.count_if(~F.col("ref")).alias("n_new"))
    edges = deciles.join(sizes, by).withColumn("e", F.array_distinct("q")).drop("q").filter("n_ref >= 50 AND n_new >= 20 AND size(e) >= 3")
    edges = small(written(edges.withColumn("e", F.slice("e", 2, F.size("e") - 2))))
    placed = rows.join(edges, by).select(by, "ref", F.size(F.filter("e", lambda e: e <= F.col("x"))).alias("bin"))
    counts = placed.groupBy(by, "bin").agg(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("a"))
    every = edges.select(by, "n_ref", "n_new", F.explode(F.sequence(F.lit(0), F.size("e"))).alias("bin"))
    share = lambda n, of: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(of), F.lit(1e-6))
    s = every.join(counts, [by, "bin"], "left").select(by, "n_ref", "n_new", share("r", "n_ref").alias("p"), share("a", "n_new").alias("q"))
    out = s.groupBy(by, "n_ref", "n_new").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return out.withColumn("level", F.when(F.col("psi") > PSI_LEVELS[1], "material").when(F.col("psi") > PSI_LEVELS[0], "moderate").otherwise("stable"))


def exposure(positions: DataFrame) -> DataFrame:
    """(book, names, gross, net)."""
    return positions.groupBy("book").agg(F.count("*").alias("names"), F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"))


def reap(runs: DataFrame) -> DataFrame:
    """Runs left queued or running when the service starts have failed."""
    return runs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))
