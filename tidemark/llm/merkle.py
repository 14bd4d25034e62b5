"""Merkle manifest of a dataset: a tree for each group of rows, and a tree over the groups' roots.

Leaves are sorted over range partitions and numbered from the partitions' counts, so each partition holds a stretch of a
tree's leaves that begins and ends anywhere. A task keeps a mountain range: the unfinished run of each level. A leaf that
fills its run is carried: the run's digest is a node record and a member of the run above, in the base of the fanout. The
last run of a level may be short and is hashed as it is, without padding. What stays unfinished at a stretch's two edges
goes on to merging rounds, in which tasks see ever longer aligned stretches and run the same stack over completed peaks.

Proofs come from the stored records: paths of the nodes at one level by joins from the roots down, the rest in tasks that
hold one node's leaves and records, at most 1.5 * FANOUT ** CHUNK of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small, written

FANOUT = 3
#: Proof tasks hold the FANOUT ** CHUNK leaves below a node of this level at a time.
CHUNK = 8
ROWS_PER_PART, LEAST_PER_PART = 500_000, 2_000
#: Merging rounds lengthen the aligned stretches by this power of the fanout.
ROUND = 3
_RECORD = "_s string, _level int, _i long, _digest binary, _n long, _root boolean, _edge boolean"


class Manifest(NamedTuple):
    """Stored tables: leaves with their tree _s, place _i and tree size _n, and node records (_s, _level, _i, _digest, _n, _root)."""

    leaves: DataFrame
    nodes: DataFrame


def digest(*values: Column) -> Column:
    """SHA-256 (lower-case hex) of the values in turn: `-` for null, else byte count, `:` and the value."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def _hash(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def _sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def _mountains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes by tree and place in; the node records that they complete and the edges that they don't out."""
    tree, sizes, open_, out = None, [], {}, []

    def edges():
        for level, (_, members) in open_.items():
            out.extend((tree, level, i, d, sizes[0], False, True) for i, d in members)
        open_.clear()

    for batch in batches:
        for s, level, i, d, n in zip(*[batch.column(c).to_pylist() for c in ("_s", "_level", "_i", "_digest", "_n")], strict=True):
            if s != tree:
                edges()
                tree, sizes = s, _sizes(n)
                if n == 1:
                    out.append((s, 0, 0, d, 1, True, False))
            while level + 1 < len(sizes):
                run = i // FANOUT
                held = open_.get(level)
                if held is None or held[0] != run:
                    if held is not None:
                        out.extend((s, level, j, x, n, False, True) for j, x in held[1])
                    held = open_[level] = (run, [])
                held[1].append((i, d))
                if len(held[1]) < min(FANOUT, sizes[level] - FANOUT * run):
                    break
                del open_[level]
                level, i, d = level + 1, run, _hash([x for _, x in held[1]])
                out.append((s, level, i, d, n, level + 1 == len(sizes), False))
        if len(out) > 50_000:
            yield _records(out)
            out = []
    edges()
    yield _records(out)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["_s", "_level", "_i", "_digest", "_n", "_root", "_edge"])


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The trees of leaves (_s, _leaf in hex, the order's columns, others): leaves of a tree ascend by order, then by digest.

    Rows that are equal in all of these have leaves of their own beside each other. No leaves: two empty tables.
    """
    leaves = written(leaves)  # ranges are drawn from it, so that digests are made once
    total, spark = leaves.count(), leaves.sparkSession
    parts = max(1, total // ROWS_PER_PART, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_PER_PART))
    keys = ["_s", *order, "_leaf"]
    ranged = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = placed.groupBy("_s", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    of_tree = Window.partitionBy("_s")
    before = F.coalesce(F.sum("_rows").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("_s", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("_n")))
    indexed = written(placed.join(small(starts), ["_s", "_part"]).withColumn("_i", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift"))

    stretch = indexed.select("_s", F.lit(0).alias("_level"), "_i", F.col("_leaf").cast("binary").alias("_digest"), "_n")
    made = written(stretch.sortWithinPartitions("_s", "_i").mapInArrow(_mountains, _RECORD))
    records = [made.filter("NOT _edge")]
    power = len(_sizes(max(1, total // parts))) + 1
    while not (edges := made.filter("_edge")).isEmpty():
        place = F.col("_i") * F.pow(F.lit(float(FANOUT)), "_level").cast("long")
        dealt = edges.withColumn("_at", place).withColumn("_block", F.expr(f"_at div {FANOUT**power}"))
        made = written(dealt.repartition("_s", "_block").sortWithinPartitions("_s", "_at").mapInArrow(_mountains, _RECORD))
        records.append(made.filter("NOT _edge"))
        power += ROUND
    nodes = records[0]
    for more in records[1:]:
        nodes = nodes.union(more)
    return Manifest(indexed, nodes.drop("_edge"))


def paths(manifest: Manifest, above: DataFrame, level: int) -> DataFrame:
    """(_s, _c, _steps, ...) of every node of a level, and of the roots of trees that don't reach it: the digests to the left and
    to the right of the node in its run, then of its ancestors, then the steps that above (_s, _steps, others) has for the root.
    """
    nodes = manifest.nodes
    if not level:
        nodes = nodes.filter("_level > 0").union(manifest.leaves.select("_s", F.lit(0), "_i", F.col("_leaf").cast("binary"), "_n", (F.col("_n") == 1)))
    nodes = nodes.withColumn("_digest", F.col("_digest").cast("string"))
    run = nodes.filter(f"_level >= {level} AND NOT _root").groupBy("_s", "_level", F.expr(f"_i div {FANOUT}").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_i", "_digest"))).alias("_run"))
    side = lambda test: F.array_join(F.transform(F.filter("_run", test), lambda x: x["_digest"]), "")
    members = run.select("*", F.explode(F.transform("_run", lambda x: x["_i"])).alias("_c"))
    members = written(members.select("_s", "_level", "_up", "_c", F.struct(side(lambda x: x["_i"] < F.col("_c")).alias("l"), side(lambda x: x["_i"] > F.col("_c")).alias("r")).alias("_step")))
    roots = written(nodes.filter("_root").select("_s", "_level").join(above, "_s"))
    extra = [c for c in above.columns if c not in ("_s", "_steps")]
    top = roots.agg(F.coalesce(F.max("_level"), F.lit(0))).first()[0]
    shown = lambda df: df.select("_s", F.lit(0).cast("long").alias("_c"), "_steps", *extra)
    front = shown(roots.filter(F.col("_level") == max(top, level)))
    for here in range(top - 1, level - 1, -1):
        up = front.select("_s", F.col("_c").alias("_up"), F.col("_steps").alias("_rest"), *extra)
        below = members.filter(F.col("_level") == here).join(up, ["_s", "_up"])
        front = shown(roots.filter(F.col("_level") == here)).union(below.select("_s", "_c", F.concat(F.array("_step"), "_rest").alias("_steps"), *extra))
    return front.union(shown(roots.filter(F.col("_level") < level)))


def _proofs(root: bytes):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams of (head, node records, leaves) by tree and chunk in; proofs out."""
        key, head, levels, leaves, out = None, None, {}, [], []

        def flush():
            # Top-down: the steps above each node, and their digests in one text.
            steps, text = {0: head["steps"]}, {0: b"".join(x for step in head["steps"] for x in step)}
            for level in range(head["level"] - 1, -1, -1):
                row = leaves if level == 0 else levels[level]
                digests = [x[0] for x in row]
                new_steps, new_text = {}, {}
                for i, own in enumerate(digests):
                    first = i - i % FANOUT
                    l, r = b"".join(digests[first:i]), b"".join(digests[i + 1 : first + FANOUT])
                    up = i // FANOUT
                    if level:
                        new_steps[i], new_text[i] = [(l, r), *steps[up]], l + r + text[up]
                    else:
                        emit(row[i], own, l + r + text[up], [(l, r), *steps[up]])
                steps, text = new_steps, new_text
            if head["level"] == 0:
                emit(leaves[0], leaves[0][0], text[0], steps[0])

        def emit(leaf, own, siblings, path):
            folded = leaf[2] if leaf[2] is not None else own
            for l, r in path:
                folded = sha256(l + folded + r).hexdigest().encode()
            out.append((leaf[1], own, head["sub"], root, sha256(siblings).hexdigest(), folded, folded == root))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_s", "_c", "_level", "_digest", "doc_id", "_changed", "_n", "_steps")]
            for s, c, level, d, doc, changed, n, path in zip(*columns, strict=True):
                if (s, c) != key:
                    if head is not None:
                        flush()
                    key, levels, leaves = (s, c), {}, []
                    # The head comes first.
                    head = {"sub": d, "level": min(CHUNK, len(_sizes(n)) - 1), "steps": [(x["l"].encode(), x["r"].encode()) for x in path]}
                elif level:
                    levels.setdefault(level, []).append((d,))
                else:
                    leaves.append((d, doc, changed))
            if len(out) > 20_000:
                yield _proven(out)
                out = []
        if head is not None:
            flush()
        yield _proven(out)

    return prove


def _proven(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    text = lambda c: pa.array([x.decode() if isinstance(x, bytes) else x for x in c], pa.string())
    arrays = [pa.array(list(columns[0]), pa.int64()), *map(text, columns[1:6]), pa.array(list(columns[6]), pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def leaves_of(docs: DataFrame, columns: list[str], group: str, order: str, changed: Column | None = None) -> DataFrame:
    """(_s, doc_id, _leaf, _changed): leaves over the columns; _changed digests the row with its last column replaced by `changed`
    where that isn't null. The null group sorts before all others, also before the empty one.
    """
    own = [F.col(c) for c in columns]
    other = F.when(changed.isNotNull(), digest(*own[:-1], changed)) if changed is not None else F.lit(None).cast("string")
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_s"), F.col(order).cast("long").alias("doc_id"), digest(*own).alias("_leaf"), other.alias("_changed"))


def verify(leaves: DataFrame) -> DataFrame:
    """A row for each row of leaves (see leaves_of): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Group trees ascend by doc_id (null first), their roots by group. Null values count as such, empty texts as values; repeated
    rows have a leaf each. The columns that leaves_of doesn't name are not read. No rows give none.
    """
    forest = build(leaves, ["doc_id"])
    if forest.nodes.isEmpty():
        return leaves.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified")).limit(0)
    subroots = forest.nodes.filter("_root").select(F.lit("").alias("_s"), F.col("_s").alias("_group"), F.col("_digest").cast("string").alias("_leaf"))
    top = build(subroots, ["_group"])
    root = bytes(top.nodes.filter("_root").first()["_digest"])
    none = F.array().cast("array<struct<l:string,r:string>>")
    one = leaves.sparkSession.range(1).select(F.lit("").alias("_s"), none.alias("_steps"))
    tops = paths(top, one, 0).withColumnRenamed("_c", "_i").join(top.leaves, ["_s", "_i"])
    above = written(tops.select(F.col("_group").alias("_s"), "_steps", F.col("_leaf").alias("_sub")))
    sizes = forest.nodes.filter("_root").select("_s", "_n")
    heads = written(paths(forest, above, CHUNK).join(sizes, "_s"))

    no = lambda kind: F.lit(None).cast(kind)
    chunk = F.expr(f"_i div {FANOUT**CHUNK}")
    of_nodes = F.floor(F.col("_i") / F.pow(F.lit(float(FANOUT)), F.lit(CHUNK) - F.col("_level"))).cast("long")
    stream = heads.select("_s", "_c", F.lit(CHUNK).alias("_level"), F.lit(-1).cast("long").alias("_i"), F.col("_sub").cast("binary").alias("_digest"), no("long").alias("doc_id"), no("binary").alias("_changed"), "_n", "_steps")
    stream = stream.union(forest.nodes.filter(f"_level > 0 AND _level < {CHUNK} AND NOT _root").select("_s", of_nodes, "_level", "_i", "_digest", no("long"), no("binary"), "_n", no("array<struct<l:string,r:string>>")))
    stream = stream.union(forest.leaves.select("_s", chunk, F.lit(0), "_i", F.col("_leaf").cast("binary"), "doc_id", F.col("_changed").cast("binary"), "_n", no("array<struct<l:string,r:string>>")))
    dealt = stream.repartition("_s", "_c").sortWithinPartitions("_s", "_c", F.desc("_level"), "_i")
    return dealt.mapInArrow(_proofs(root), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
