"""Structured Streaming forms of daily bars and first reports: an extension, as the batch model has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.market import table
from tidemark.storage import shared_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def daily_bars(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Count, volume and range of each type and day; days close once the watermark passes them."""
    g = stream.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("ticker"))
    bars = g.agg(F.count("*").alias("n"), F.sum("value").alias("volume"), F.max("value").alias("high"), F.min("value").alias("low"))
    return bars.select(F.col("w.start").cast("date").alias("date"), "ticker", "n", "volume", "high", "low")


def first_of_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    g = stream.withWatermark("at", late).groupBy("event_type", F.window("at", "1 day").alias("w"))
    return g.agg(F.min("ts").alias("first")).select("event_type", F.col("w.start").cast("date").alias("date"), "first")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over finite input gives when all of it has been read, as a table in the shared folder.

    In complete mode each batch replaces the table, else it adds to it.
    """
    path = shared_dir(stream.sparkSession)
    save = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")
    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
