import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle


def snapshot(df):
    return {r.run_id: r for r in lifecycle.snapshots(df, "d", "run", ["a", "b"], "day").collect()}


def test_fingerprints_know_rows_not_their_order(spark):
    rows = [(i % 3, i, f"v{i}" if i % 7 else None, dt.date(2020, 1, 1 + i % 28)) for i in range(200)]
    schema = "run int, a int, b string, day date"
    whole = snapshot(spark.createDataFrame(rows, schema))
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert snapshot(spark.createDataFrame(shuffled, schema).repartition(7)) == whole and whole[0].n_rows == 67
    for changed in ((0, 3, "other", rows[3][3]), (0, 3, None, rows[3][3]), (0, 3, "", rows[3][3])):
        got = snapshot(spark.createDataFrame([*rows[:3], changed, *rows[4:]], schema))
        assert got[0].row_sum != whole[0].row_sum and got[0].row_xor != whole[0].row_xor and {k: got[k] for k in (1, 2)} == {k: whole[k] for k in (1, 2)}
    twice = snapshot(spark.createDataFrame([*rows, rows[3], rows[3]], schema))  # the xor alone can't see a pair of repetitions
    assert twice[0].row_xor == whole[0].row_xor and twice[0].row_sum != whole[0].row_sum
    moved = snapshot(spark.createDataFrame([(0, 1, "12", dt.date(2020, 1, 1))], schema))[0], snapshot(spark.createDataFrame([(0, 11, "2", dt.date(2020, 1, 1))], schema))[0]
    assert moved[0].row_sum != moved[1].row_sum
    wider = lifecycle.snapshots(spark.createDataFrame(rows, schema).withColumn("a", F.col("a").cast("long")), "d", "run", ["a", "b"], "day").first()
    assert wider.schema != whole[0].schema
    assert lifecycle.snapshots(spark.createDataFrame([], schema), "d", "run", ["a", "b"], "day").count() == 0


def test_changes_between_lineages(spark):
    schema = "run_id int, dataset string, n_rows long, row_sum string, row_xor long, schema string"
    before = spark.createDataFrame([(1, "a", 2, "5", 1, "s"), (1, "b", 2, "5", 1, "s"), (2, "a", 1, "1", 1, "s"), (3, "a", 1, "1", 1, "s")], schema)
    after = spark.createDataFrame([(1, "a", 2, "5", 1, "s"), (1, "b", 2, "6", 3, "s"), (2, "a", 1, "1", 1, "t"), (2, "c", 1, "1", 1, "t")], schema)
    assert {tuple(r) for r in lifecycle.changed_inputs(before, after).collect()} == {(1, "b", "rows"), (2, "a", "schema"), (2, "c", "added"), (3, "a", "removed")}


def plain(events):
    state, out = {}, []
    for run, at, event, action in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        now = state.get(run, "queued")
        to = lifecycle.TRANSITIONS.get((now, action))
        out.append((run, event, action, now, to is not None, to or now))
        state[run] = to or now
    return sorted(out, key=repr), state


@pytest.mark.parametrize("parts", ["1", "9"])
def test_decisions_equal_a_loop(spark, parts):
    """One run holds most events, so its stretches lie in many partitions; ties in time, unknown and null actions."""
    rng = random.Random(4)
    actions = ["start", "finish", "approve", "reject", "fail", "delete", None]
    events = [(0 if rng.random() < 0.8 else rng.randrange(1, 6), dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(900)), i, rng.choice(actions)) for i in range(3000)]
    df = spark.createDataFrame([(r, i, at, a) for r, at, i, a in events], "run_id long, event_id long, at timestamp, action string").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decided = lifecycle.decisions(df)
        want, state = plain(events)
        assert sorted(map(tuple, decided.collect()), key=repr) == want
        assert {r.run_id: r.status for r in lifecycle.outcome(decided, df).collect()} == state
        assert lifecycle.decisions(df.filter("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
