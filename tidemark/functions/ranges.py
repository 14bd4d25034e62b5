"""Statistics of sorted groups without a group in one task: range partitions, and sums over partitions before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def counted(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(by, x, n, sums, end, total): a row for each distinct value x of each group, null and missing values apart, with the number of
    its rows, of rows up to it and of all rows of the group.

    Values are counted before they move, then sorted over range partitions; what comes before a partition is a sum over partitions.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (sums or {}).items()])
    ranged = written(counts.repartitionByRange(*by, "x").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_m"))
    group = Window.partitionBy(*by)
    before = F.sum("_m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("total"))
    inside = Window.partitionBy(*by, "_part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(parts, [*by, "_part"]).withColumn("end", F.col("_before") + F.sum("n").over(inside)).drop("_part", "_before")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q array): the values at the given shares of each group's sorted values, interpolated between neighbours."""
    rows = counted(df, by, value)
    first = F.col("end") - F.col("n")

    def held(place: Column) -> Column:
        return F.max(F.when((first <= place) & (F.col("end") > place), F.col("x")))

    at = [(F.col("total") - 1) * F.lit(float(q)) for q in shares]
    ends = rows.groupBy(*by).agg(F.max("total").alias("total"), *[held(F.floor(p)).alias(f"_l{i}") for i, p in enumerate(at)], *[held(F.ceil(p)).alias(f"_h{i}") for i, p in enumerate(at)])
    value_at = lambda i, p: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p))
    return ends.select(*by, F.array(*[value_at(i, p) for i, p in enumerate(at)]).alias("q"))


def mid_rank() -> Column:
    """Of a row of counted(): the rank from 1 that its tied values share."""
    return F.col("end") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
