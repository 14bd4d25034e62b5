"""Payloads to columns: nested JSON facts, CSV series with a mark for missing values, mixed timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "struct<facts:map<string,struct<units:map<string,array<struct<end:date,filed:date,val:double,form:string>>>>>>"


def company_facts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, tag, unit, period_end, filed_date, value, form) of JSON documents `facts.<tag>.units.<unit>[]`; rows
    without an end, a filing date or a value are dropped.
    """
    tags = raw.select("ticker", F.explode(F.map_entries(F.from_json(payload, FACTS)["facts"])).alias("t"))
    units = tags.select("ticker", F.col("t.key").alias("tag"), F.explode(F.map_entries("t.value.units")).alias("u"))
    rows = units.select("ticker", "tag", F.col("u.key").alias("unit"), F.explode("u.value").alias("f"))
    return rows.select("ticker", "tag", "unit", F.col("f.end").alias("period_end"), F.col("f.filed").alias("filed_date"), F.col("f.val").alias("value"), F.col("f.form").alias("form")).na.drop(subset=["period_end", "filed_date", "value"])


def series_line(line: Column) -> tuple[Column, Column]:
    """(date, value) of a line `2024-01-01,3.5`; a lone dot is a missing value."""
    parts = F.split(line, ",")
    return F.get(parts, 0).try_cast("date"), F.get(parts, 1).try_cast("double")


def published(stamp: Column) -> Column:
    """Epoch seconds or an ISO string to a timestamp; without a zone it is UTC, and what is neither is null."""
    return F.when(stamp.rlike(r"^\d+$"), F.timestamp_seconds(stamp.try_cast("long"))).otherwise(stamp.try_cast("timestamp"))
