"""Streams over several batches with late rows: results equal the batch computation, and the state stays small."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.storage import shared_dir
from tidemark.streaming import bars, stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_type string, ticker string, at timestamp, ts timestamp, value double, score double, id long"


def at(day, hour=12):
    return T0 + dt.timedelta(days=day, hours=hour)


def batches(spark, *parts):
    """A stream of files, one a batch."""
    path = shared_dir(spark)
    for i, rows in enumerate(parts):
        spark.createDataFrame([(k, k, t, t, v, v, n) for n, (k, t, v) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


PARTS = [
    [("a", at(0), 1.0), ("a", at(0, 13), 3.0), ("b", at(0), 5.0)],
    [("a", at(1), 2.0), ("a", at(0, 20), 8.0)],  # within the delay
    [("a", at(4), 4.0), ("b", at(3), 6.0)],
    [("b", at(4, 1), 7.0)],  # days 0 to 2 close
    [("a", at(0, 1), 100.0), ("b", at(1), 100.0), ("b", at(3, 20), 8.0)],  # the first two are late
    [("a", at(9), 1.0)],
]


def kept():
    return [r for part in PARTS for r in part if r[2] != 100.0 and r[1] < at(8)]


def test_days_close_once(spark):
    out, progress = stateful.appended(stateful.closed_bars(batches(spark, *PARTS)))
    want = defaultdict(list)
    for k, t, v in kept():
        want[k, t.date()].append(v)
    assert {(r.ticker, r.date): (r.n, r.volume, r.high, r.low) for r in out.collect()} == {k: (len(v), sum(v), max(v), min(v)) for k, v in want.items()}
    assert out.count() == len(want)
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 1 and sum(s["numRowsDroppedByWatermark"] for s in state) == 2


@pytest.mark.filterwarnings("ignore")
def test_decayed_means_equal_the_batch(spark):
    out, progress = stateful.appended(stateful.decayed_means(batches(spark, *PARTS)))
    days = defaultdict(list)
    for k, t, v in kept():
        days[k, (t - T0).days].append(v)
    want = {}
    for k in ("a", "b"):
        own = sorted(d for n, d in days if n == k)
        for d in own:
            w = {e: 2 ** ((e - d) / 5) for e in own if e <= d}
            want[k, (T0 + dt.timedelta(days=d)).date()] = sum(w[e] * sum(days[k, e]) / len(days[k, e]) for e in w) / sum(w.values())
    got = {(r.ticker, r.date): r.sentiment for r in out.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and out.count() == len(want)


def test_first_reports_are_kept_within_the_delay(spark):
    parts = [[("a", at(0), 1.0), ("b", at(0), 2.0)], [("a", at(0, 14), 3.0)], [("c", at(6), 4.0)], [("c", at(6, 13), 6.0)], [("a", at(6, 14), 5.0)]]
    out, progress = stateful.appended(stateful.first_seen(batches(spark, *parts), ["ticker"]))
    assert sorted((r.ticker, r["at"]) for r in out.collect()) == [("a", at(0)), ("a", at(6, 14)), ("b", at(0)), ("c", at(6))]  # a is forgotten once its delay has passed
    assert [p["stateOperators"][0] for p in progress if p["stateOperators"]][-1]["numRowsTotal"] == 2


def test_a_stream_goes_on_where_it_stopped(spark):
    source, path = shared_dir(spark), shared_dir(spark)
    read = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    put = lambda i, rows: spark.createDataFrame([(k, k, t, t, v, v, 0) for k, t, v in rows], SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
    put(0, [("a", at(0), 1.0)])
    first, _ = stateful.appended(stateful.closed_bars(read()), path)
    assert first.count() == 0
    put(1, [("a", at(0, 15), 2.0), ("a", at(5), 9.0)])
    second, _ = stateful.appended(stateful.closed_bars(read()), path)
    assert [(r.n, r.volume) for r in second.collect()] == [(2, 3.0)]


def test_bars_are_the_same_in_both_modes(spark):
    s = batches(spark, *PARTS[:3])
    whole = bars.run_to_end(bars.daily_bars(s, "30 days"), "complete")
    assert whole.agg(F.sum("n")).first()[0] == 7
