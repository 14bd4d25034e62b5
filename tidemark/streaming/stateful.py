"""Streams whose state ends: bars of closed days, first reports within a delay, and decayed means by timers. All append.

What a watermark has passed leaves the state and is written once; rows that come later are dropped. Results of a finite input hold
what was closed when it ended: days whose end lies at or before the latest event less the delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.storage import shared_dir
from tidemark.streaming.bars import daily_bars

DAY_MS, HALF_LIFE = 86_400_000, 5.0


def closed_bars(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """daily_bars, of which append mode writes each day once its watermark has passed it."""
    return daily_bars(stream, late)


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """keys and `at` of the first row of each key to arrive; repetitions within the delay are dropped, and their keys forgotten after it."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(keys).select(*keys, "at")


class Decayed(StatefulProcessor):
    """Of a ticker: sums of the days that are still open, and the weighed sum of all closed ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "total double, n long")
        self.closed = handle.getValueState("closed", "day int, total double, weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for day, scores in part.groupby("day")["score"]:
                end = (int(day) + 1) * DAY_MS
                if end <= passed:
                    continue
                held = self.open.getValue((int(day),)) if self.open.containsKey((int(day),)) else (0.0, 0)
                self.open.updateValue((int(day),), (float(held[0] + scores.sum()), int(held[1] + len(scores))))
                self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        """Closes all open days up to the timer's, in order."""
        last = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        out = []
        for day in sorted(d[0] for d in self.open.keys() if d[0] <= last):
            total, n = self.open.getValue((day,))
            self.open.removeKey((day,))
            before, sums, weight = self.closed.get() if self.closed.exists() else (day, 0.0, 0.0)
            fade = 2.0 ** ((before - day) / HALF_LIFE)
            sums, weight = sums * fade + total / n, weight * fade + 1.0
            self.closed.update((day, float(sums), float(weight)))
            out.append((key[0], day, sums / weight))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "day", "sentiment"])

    def close(self) -> None:
        pass


def decayed_means(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(ticker, date, sentiment) from (ticker, at, score): the mean of daily means, each weighed by 2^(-age in days / HALF_LIFE), for every
    closed day with news. State is the open days and three numbers for each ticker.
    """
    rows = stream.withWatermark("at", late).select("ticker", "at", F.col("score").cast("double").alias("score"), F.unix_date(F.to_date("at")).alias("day"))
    out = rows.groupBy("ticker").transformWithStateInPandas(Decayed(), "ticker string, day int, sentiment double", "Append", "EventTime")
    return out.select("ticker", F.date_from_unix_date("day").alias("date"), "sentiment")


@contextmanager
def _state_on_disk(spark: SparkSession):
    """State beyond an executor's heap, which timers and map states ask for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def appended(stream: DataFrame, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """What a stream over finite input writes, as a table below `path` (a folder of its own in the shared one, if not given), and the progress
    of its batches. A second call with the path goes on where the first stopped.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark)
    with _state_on_disk(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = [json.loads(p.json) for p in q.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{path}/rows"), progress
