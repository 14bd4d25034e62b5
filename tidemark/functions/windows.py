"""Column builders for ordered panels: framed aggregates, fills, as-of joins, ranks, decayed means, runs.

Builders that share a partition and an order share one exchange and one sort in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY_TICKER = ("ticker", "date")


def ordered(by: str | Sequence[str] = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def rolling(fn: Callable[[Column], Column], x: Column, n: int, spec: WindowSpec, least: int | None = None) -> Column:
    """fn over the last n rows, null unless `least` (all n by default) of them have a value."""
    frame = spec.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def prior(fn: Callable[[Column], Column], x: Column, n: int, spec: WindowSpec, least: int) -> Column:
    """As rolling, over the n rows before this one."""
    frame = spec.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def change(x: Column, spec: WindowSpec, n: int = 1) -> Column:
    return x / F.nullif(F.lag(x, n).over(spec), F.lit(0.0)) - 1


def log_return(x: Column, spec: WindowSpec) -> Column:
    return F.ln(F.nullif(x, F.lit(0.0))) - F.ln(F.nullif(F.lag(x).over(spec), F.lit(0.0)))


def ffill(x: Column, spec: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: Column, spec: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(spec.rowsBetween(0, Window.unboundedFollowing))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """left with the values of right's latest row at or before left_on: a union and one window, so one exchange.

    right should hold one row for each key and time; of several any may be taken.
    """
    keys = list(by)
    l = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(left_on).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))  # noqa: E741
    r = right.select(F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), *keys, F.col(right_on).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = l.union(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return met.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank from 1 in which ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def decayed_mean(x: Column, day: Column, spec: WindowSpec, half_life: float) -> Column:
    """Mean of x weighed by 2^(-age / half_life), over all rows so far; `day` is a number that grows with time.

    Weights count from the series' first day, which suits spans of up to about 1000 half-lives.
    """
    w = F.pow(F.lit(2.0), day / F.lit(half_life))
    run = spec.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(x * w).over(run) / F.sum(F.when(x.isNotNull(), w)).over(run)


def rolling_rank(x: Column, n: int, spec: WindowSpec, least: int) -> Column:
    """Share of the frame's values up to x, ties counted half: a percentile rank of the newest value."""
    held = F.collect_list(x).over(spec.rowsBetween(-(n - 1), 0))
    less, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when((F.size(held) >= least) & x.isNotNull(), (less + (same + 1) / F.lit(2.0)) / F.size(held))


def compounded(r: Column, spec: WindowSpec) -> Column:
    """Product of 1 + r so far; needs r > -1."""
    return F.exp(F.sum(F.ln(1 + r)).over(spec.rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, same: Column, spec: WindowSpec, name: str = "island") -> DataFrame:
    """Numbers the runs of rows in which `same` (as the row before) holds."""
    flagged = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn(name, F.sum("_new").over(spec.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
