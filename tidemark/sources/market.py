"""Relations of the research model, read from the supplied tables: bars, facts, macro, news, chunks, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; a missing one is an error at once, not in a task."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each brand: volume-weighted close, high and low unit price, previous close as open."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker"), "date").agg(
        F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    return bars.withColumn("open", F.lag("close").over(ordered())).select("ticker", "date", "open", "high", "low", "close", "volume")


def walked(raw: DataFrame) -> DataFrame:
    """A price path of each ticker of raw bars: log returns are a tenth of the distance to the mean of its earlier log prices."""
    w = ordered()
    v = F.ln("close")
    lr = F.coalesce(F.lit(0.1) * (v - F.avg(v).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.lit(0.0))
    bars = raw.select("ticker", "date", lr.alias("lr"), "volume")
    return bars.select("ticker", "date", (F.lit(100.0) * F.exp(F.sum("lr").over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("close"), "volume")


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(bars_raw(spark, sf_dir))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered()
    out = bars_walk(spark, sf_dir).select("ticker", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    return out.filter("ret IS NOT NULL")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported values: valid for period_end, known from filed_date on."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    filed = F.col("o_orderdate").cast("date")
    quarter = F.date_trunc("quarter", filed).cast("date")
    end = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(quarter, 1)).otherwise(F.date_sub(F.add_months(quarter, -3), 1))
    return j.select(F.col("n_name").alias("ticker"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"), end.alias("period_end"), filed.alias("filed_date"), F.col("o_orderkey").alias("accession"))


#: What orders stand for as reports, by customer.
REPORTED = ("eps_diluted", "net_income", "revenue", "operating_income", "stockholders_equity", "total_assets", "total_liabilities", "shares_diluted")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported quantities of the tickers of bars, with the form of each report: nation n stands for the brand n + 1."""
    o, c = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    filed = F.col("o_orderdate").cast("date")
    quarter = F.date_trunc("quarter", filed).cast("date")
    end = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(quarter, 1)).otherwise(F.date_sub(F.add_months(quarter, -3), 1))
    metric = F.element_at(F.array(*map(F.lit, REPORTED)), (F.col("o_custkey") % 8 + 1).cast("int"))
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-Q", "10-Q", "10-Q/A", "8-K"))), (F.floor(F.col("o_custkey") / 8) % 5 + 1).cast("int"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("ticker"), metric.alias("metric"), F.col("o_totalprice").alias("value"), end.alias("period_end"), filed.alias("filed_date"), F.col("o_orderkey").alias("accession"), form.alias("form"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly series of each region with the day from which each value was published."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    lag = F.element_at(F.array(*map(F.lit, (0, 0, 0, 21, 30))), F.col("r_regionkey") + 1)
    g = j.groupBy(F.col("r_name").alias("series"), lag.alias("lag"), F.date_trunc("week", "o_orderdate").cast("date").alias("obs_date"))
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return g.agg(price.alias("value")).select("series", "obs_date", F.date_add("obs_date", F.col("lag")).alias("avail_date"), "value")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).cast("string").alias("ticker"), F.col("event_id"), F.col("ts").alias("published_at"), (F.col("value") / 100 - 1).alias("score"), F.col("event_type").alias("title"))


def news_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of the tickers of bars: an hour of the events' month stands for three and a half days of the bars' years."""
    e = table(spark, sf_dir, "events")
    days = F.floor(F.expr("timestampdiff(SECOND, timestamp'2024-01-01', ts)") * 7 / 7200).cast("int")
    return e.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"), F.date_add(F.lit("1995-01-02").cast("date"), days).alias("date"), (F.col("value") / 100 - 1).alias("score"))


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 5, "failed").when(k < 15, "degraded").otherwise("ok")
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("run_id"), "event_id", F.col("event_type").alias("agent"), F.col("value").alias("seconds"), status.alias("status"), "ts")


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("fold"), F.col("l_discount").alias("accuracy"), F.col("l_tax").alias("ic"), F.col("l_orderkey").alias("row"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for runs: their status, verdict, owner, creation time and seconds taken."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderpriority").alias("verdict"), F.col("o_orderdate").cast("date").alias("created"), F.col("o_totalprice").alias("seconds"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("source").alias("ticker"), F.col("lang").alias("doc_type"))
