"""Validation findings, calendar checks and cleaning of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import bfill, change, ffill, islands, log_return, ordered, prior

#: Fixed values of the checks.
LEAST_BARS, MANY_MISSING, SPLIT_MOVE, STALE_RUN, THIN_DOLLARS = 120, 0.10, 0.35, 5, 1e6
OUTLIER_WINDOW, OUTLIER_LEAST, OUTLIER_Z = 20, 5, 6.0


def stale_runs(bars: DataFrame) -> DataFrame:
    """(ticker, longest): the most unchanged closes in a row after the first of its price, by gaps and islands."""
    w = ordered()
    runs = islands(bars.withColumn("_p", F.lag("close").over(w)), F.col("close") == F.col("_p"), w)
    return runs.groupBy("ticker", "island").agg((F.count("*") - 1).alias("n")).groupBy("ticker").agg(F.max("n").alias("longest"))


def split_like(bars: DataFrame, limit: float = SPLIT_MOVE) -> DataFrame:
    r = change(F.col("close"), ordered())
    return bars.select("ticker", "date", r.alias("ret")).filter(F.abs("ret") > limit)


def findings(bars: DataFrame) -> DataFrame:
    """(ticker, check, severity, n) for every check that a ticker doesn't pass, from one aggregation of its bars."""
    w = ordered()
    b = bars.select("*", change(F.col("close"), w).alias("_r"))
    prices = ("open", "high", "low", "close")
    per = b.groupBy("ticker").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("close").isNull()).alias("missing"),
        (F.count("date") - F.count_distinct("date")).alias("duplicates"),
        F.count_if(F.least(*[F.coalesce(c, F.lit(1.0)) for c in prices]) <= 0).alias("non_positive"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if((F.col("close") > F.col("high") + 1e-6) | (F.col("close") < F.col("low") - 1e-6)).alias("close_outside"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.abs("_r") > SPLIT_MOVE).alias("split_like"),
        F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("dollars"),
    ).join(stale_runs(bars), "ticker")
    rules = [
        ("too_short", "warning", F.col("rows") < LEAST_BARS, F.col("rows")),
        ("missing", "error", F.col("missing") > MANY_MISSING * F.col("rows"), F.col("missing")),
        ("missing", "info", (F.col("missing") > 0) & (F.col("missing") <= MANY_MISSING * F.col("rows")), F.col("missing")),
        *((c, s, F.col(c) > 0, F.col(c)) for c, s in (("duplicates", "warning"), ("non_positive", "error"), ("high_below_low", "error"), ("close_outside", "warning"), ("negative_volume", "error"), ("split_like", "warning"))),
        ("stale", "warning", F.col("longest") >= STALE_RUN, F.col("longest")),
        ("thin", "warning", F.col("dollars") < THIN_DOLLARS, F.col("rows")),
    ]
    each = F.array(*[F.when(hit, F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), n.cast("long").alias("n"))) for c, s, hit, n in rules])
    return per.select("ticker", F.explode(F.array_compact(each)).alias("f")).select("ticker", "f.*")


def usable(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Bars of tickers without an error."""
    return bars.join(found.filter("severity = 'error'").select("ticker").distinct(), "ticker", "left_anti")


def calendar(bars: DataFrame) -> DataFrame:
    """(ticker, dates, common, coverage, aligned): the share of a ticker's dates that all tickers have."""
    dates = bars.select("ticker", "date").distinct()
    n = bars.select("ticker").distinct().agg(F.count("*").alias("n"))
    common = dates.groupBy("date").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"), "left_semi").select("date", F.lit(1).alias("_c"))
    per = dates.join(common, "date", "left").groupBy("ticker").agg(F.count("*").alias("dates"), F.count("_c").alias("common"))
    return per.select("*", (F.col("common") / F.col("dates")).alias("coverage")).withColumn("aligned", F.col("coverage") >= 0.9)


def on_common_dates(bars: DataFrame, least: int = LEAST_BARS) -> DataFrame:
    """Bars of the dates that every ticker has; all bars, if those are fewer than `least`."""
    n = bars.agg(F.count_distinct("ticker").alias("n"))
    per = bars.groupBy("date").agg(F.count_distinct("ticker").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"), "left_semi").select("date")
    enough = F.broadcast(per.agg((F.count("*") < least).alias("few")))
    return bars.join(per.withColumn("_in", F.lit(True)), "date", "left").join(enough).filter("few OR _in").drop("few", "_in")


def winsorised(bars: DataFrame, z: float = OUTLIER_Z) -> DataFrame:
    """ticker, date, close, fixed, is_outlier. An outlying log return is cut to z deviations of the twenty before it.

    The cut price builds on the repaired one before: within a run of outliers that is the last clean close times the
    product of cut returns, so the recursion becomes two windows.
    """
    w = ordered()
    b = bars.select("ticker", "date", "close", log_return(F.col("close"), w).alias("_r"))
    mean, dev = (prior(f, F.col("_r"), OUTLIER_WINDOW, w, OUTLIER_LEAST) for f in (F.avg, F.stddev_samp))
    b = b.select("*", mean.alias("_m"), dev.alias("_s"))
    b = b.withColumn("is_outlier", F.coalesce((F.col("_s") > 0) & (F.abs((F.col("_r") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))) > z), F.lit(False)))
    b = b.withColumn("_cut", F.when(F.col("is_outlier"), F.signum("_r") * z * F.col("_s")))
    b = b.withColumn("_run", F.sum(F.when(F.col("is_outlier"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("ticker", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.first("close").over(inside) * F.exp(F.coalesce(F.sum("_cut").over(inside), F.lit(0.0)))
    return b.select("ticker", "date", "close", F.when(F.col("is_outlier"), fixed).otherwise(F.col("close")).alias("fixed"), "is_outlier")


def filled(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps take the value before, those at the start the first value."""
    w = ordered()
    return bars.select(*[F.coalesce(ffill(F.col(c), w), bfill(F.col(c), w)).alias(c) if c in columns else F.col(c) for c in bars.columns])


def cleaned(bars: DataFrame) -> DataFrame:
    """Positive filled prices, outliers cut, high and low around open and close, volume at least 0."""
    positive = bars.select("ticker", "date", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).alias("volume"))
    whole = filled(positive, ["open", "high", "low", "close"])
    new = whole.join(winsorised(whole).select("ticker", "date", "fixed"), ["ticker", "date"])
    price: list[Column] = [F.col("open"), F.col("high"), F.col("low"), F.col("fixed")]
    return new.select("ticker", "date", "open", F.greatest(*price).alias("high"), F.least(*price).alias("low"), F.col("fixed").alias("close"), "volume")
