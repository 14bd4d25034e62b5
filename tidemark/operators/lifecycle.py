"""What a run used and what became of it: fingerprints of the data it read, and its states under a log of actions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Fixed: a run's states, and where each action leads; an action that isn't listed for a state is refused and changes nothing.
STATES = ("queued", "running", "awaiting_approval", "approved", "rejected", "failed")
TRANSITIONS = {
    ("queued", "start"): "running", ("running", "finish"): "awaiting_approval", ("running", "fail"): "failed", ("failed", "start"): "running",
    **{(s, a): to for s in ("awaiting_approval", "approved", "rejected") for a, to in (("approve", "approved"), ("reject", "rejected"))},
}
_HEX = 12


def row_number_of(columns: list[str]) -> Column:
    """48 bits of a row: the first digits of the MD5 of its values' sizes and texts, nulls apart from empty ones."""
    shown = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat(*shown)), 1, _HEX), 16, 10).cast("long")


def snapshots(df: DataFrame, dataset: str, by: str, columns: list[str], date: str) -> DataFrame:
    """(run_id, dataset, n_rows, start_date, end_date, row_sum, row_xor, schema): what each run read of a dataset, whatever the order of its rows.

    The same rows, repetitions included, give the same sum and xor; a changed, missing or added cell gives others but for one
    chance in 2^48. Nulls are values of their own. schema is a digest of the columns' names and types.
    """
    kinds = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in columns)
    h = row_number_of(columns)
    return df.groupBy(F.col(by).alias("run_id")).agg(
        F.lit(dataset).alias("dataset"), F.count("*").alias("n_rows"), F.min(date).cast("date").alias("start_date"), F.max(date).cast("date").alias("end_date"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("row_sum"), F.bit_xor(h).alias("row_xor"), F.md5(F.lit(kinds)).alias("schema"),
    )


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, dataset, change): datasets whose rows or schema differ between two lineages, appeared or went."""
    keys = ["run_id", "dataset"]
    b, a = (df.select(*keys, F.struct("n_rows", "row_sum", "row_xor").alias(f"{n}_rows"), F.col("schema").alias(f"{n}_schema")) for df, n in ((before, "old"), (after, "new")))
    both = b.join(a, keys, "full")
    what = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").when(F.col("old_schema") != F.col("new_schema"), "schema").when(F.col("old_rows") != F.col("new_rows"), "rows")
    return both.select(*keys, what.alias("change")).filter("change IS NOT NULL")


def _step(state: str, action: str | None) -> str | None:
    return TRANSITIONS.get((state, action))


def _folded(maps_only: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of run and time. maps_only: for each stretch of a run, where it leads from every state; else every event with
        the state that it meets, from the stretch's first state on.
        """
        key, now = None, {}
        ends: list[tuple] = []
        for batch in batches:
            names = ["_part", "run_id", "event_id", "action"] + ([] if maps_only else ["_first"])
            out = []
            for part, run, event, action, *first in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (part, run) != key:
                    if maps_only and key is not None:
                        ends.append((*key, [now[s] for s in STATES]))
                    key, now = (part, run), {s: s for s in STATES} if maps_only else first[0]
                if maps_only:
                    now = {s: _step(at, action) or at for s, at in now.items()}
                else:
                    to = _step(now, action)
                    out.append((run, event, action, now, to is not None, to or now))
                    now = to or now
            if not maps_only:
                yield _batch(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()), ["run_id", "event_id", "action", "state", "accepted", "new_state"])
        if maps_only:
            if key is not None:
                ends.append((*key, [now[s] for s in STATES]))
            yield _batch(ends, (pa.int32(), pa.int64(), pa.list_(pa.string())), ["_part", "run_id", "leads"])

    return fold


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def decisions(events: DataFrame, first: str = "queued") -> DataFrame:
    """(run_id, event_id, action, state, accepted, new_state) of every event of (run_id, event_id, at, action), in the order of `at`, then event_id:
    actions that a run's state doesn't allow, unknown and null ones are refused.

    A run's events may be most of all: they are spread over range partitions, each of which works out where its stretch leads from
    every state; following these from partition to partition gives the state in which each stretch begins.
    """
    order = ["run_id", "at", "event_id"]
    held = written(events.select(*order, "action").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    rows = held.sortWithinPartitions("_part", *order)
    stretches = written(rows.select("_part", "run_id", "event_id", "action").mapInArrow(_folded(True), "_part int, run_id long, leads array<string>"))
    # A run has as many stretches as partitions at most.
    before = Window.partitionBy("run_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    at = F.array_position(F.array(*map(F.lit, STATES)), F.lit(first))
    maps = F.collect_list("leads").over(before)
    lead = F.aggregate(maps, F.lit(first), lambda s, m: F.element_at(m, F.array_position(F.array(*map(F.lit, STATES)), s).cast("int")))
    begins = stretches.select("_part", "run_id", F.when(at > 0, lead).alias("_first"))
    met = rows.join(written(begins), ["_part", "run_id"]).sortWithinPartitions("_part", *order)
    return met.select("_part", "run_id", "event_id", "action", "_first").mapInArrow(_folded(False), "run_id long, event_id long, action string, state string, accepted boolean, new_state string")


def outcome(decided: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, status, events, refused) after all events of decisions()."""
    last = decided.join(events.select("run_id", "event_id", "at"), ["run_id", "event_id"])
    return last.groupBy("run_id").agg(F.max_by("new_state", F.struct("at", "event_id")).alias("status"), F.count("*").alias("events"), F.count_if(~F.col("accepted")).alias("refused"))
