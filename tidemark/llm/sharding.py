"""Shards of near-equal bytes by longest processing time: groups of equal texts, largest first, to the least-loaded shard.

The heap rule runs twice. Tasks deal their groups, largest first, to a fixed number of bundles each; then the few groups
that are large against a shard, and all bundles, go by the same rule to the shards. The driver sees bundle totals and at
most BIG * shards large groups, whatever the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of, written

#: A group over 1/(BIG * shards) of all bytes is dealt by itself: there are at most BIG * shards of them.
BIG = 256
#: Bundles of all tasks together, for each shard, and the most that one task may have.
BUNDLES = 512
ROWS_PER_TASK = 200_000
ROWS_PER_SLOT_RANGE = 100_000


def longest_first(sizes: Iterable[tuple[int, object]], bins: int) -> Iterator[tuple[object, int]]:
    """(item, bin) for (size, item) in descending order of size: each goes to the bin with the least load."""
    heap = [(0, i) for i in range(bins)]
    for size, item in sizes:
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
        yield item, i


def _bundler(bundles: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * bundles
        heap = [(0, i) for i in range(bundles)]
        for batch in batches:
            out = []
            for size in batch.column("bytes").to_pylist():
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                out.append(first + i)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("bytes"), pa.array(out, pa.int64())], names=["_k", "bytes", "bundle"])

    return deal


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 in a shard).

    Equal texts share a shard; a null text counts as an empty one. Repeated rows get slots of their own. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    t = text_of(text).cast("binary")
    rows = written(docs.select("doc_id", F.unhex(F.md5(t)).alias("_k"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32")))
    groups = written(rows.groupBy("_k").agg(F.sum("size").alias("bytes")))
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    limit = total // (BIG * shards)
    tasks = max(1, min(BUNDLES * shards // 2, -(-n // ROWS_PER_TASK)))
    bundles = max(2, BUNDLES * shards // tasks)
    rest = groups.filter(F.col("bytes") <= limit).repartition(tasks, "_k").sortWithinPartitions(F.desc("bytes"), "_k")
    dealt = written(rest.mapInArrow(_bundler(bundles), "_k binary, bytes long, bundle long"))
    loads = [(r[1], ("bundle", r[0])) for r in dealt.groupBy("bundle").agg(F.sum("bytes")).collect()]
    large = [(r[1], ("group", bytes(r[0]))) for r in groups.filter(F.col("bytes") > limit).select("_k", "bytes").collect()]
    placed = list(longest_first(sorted(loads + large, key=lambda x: (-x[0], x[1])), shards))
    of_bundle = spark.createDataFrame([(k[1], i) for k, i in placed if k[0] == "bundle"], "bundle long, shard int")
    of_group = spark.createDataFrame([(bytearray(k[1]), i) for k, i in placed if k[0] == "group"], "_k binary, shard int")
    # Both have at most BUNDLES * shards or BIG * shards rows.
    where = dealt.join(F.broadcast(of_bundle), "bundle").select("_k", "shard").union(of_group.select("_k", "shard"))
    ranges = max(1, -(-rows.count() // (shards * ROWS_PER_SLOT_RANGE)))
    out = written(rows.join(where, "_k").withColumn("_c", F.pmod(F.xxhash64("doc_id", "_k"), F.lit(ranges)).cast("int")))
    # A slot is the start of its range, from the ranges' counts, plus the place in the range.
    counts = out.groupBy("shard", "_c").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_c", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("shard", "_c").orderBy("doc_id", "_k"))
    return out.withColumn("_place", place).join(before, ["shard", "_c"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"))
