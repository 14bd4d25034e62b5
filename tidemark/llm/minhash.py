"""Near-duplicate documents: MinHash signatures, banding, exact verification, connected components.

Every text that occurs more than once stands for its copies (a shuffle of 16-byte digests), so all later steps work on
different texts. Candidates are never all pairs of a band's bucket: a bucket first compares its members with one of them,
then components are found, and only members of buckets that still hold several components are compared further. Of these,
a count of the shingles that other components have too proves most unable to link; what is left is compared across
components in full, so no candidate pair of different components goes untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import small, text_of, written

SHINGLE = 5
HASHES, BANDS = 128, 32
MIN_PERCENT = 75
#: Pairs with fewer equal minima (of 128) are no candidates: at a similarity of 0.75 that is six deviations off.
LEAST_EQUAL = 64
#: Members of a bucket that are compared with so many others in one group of the last join, about.
BLOCK = 128
#: Parts into which the members that share a center are dealt.
SALTS = 16
#: Rows for which a table takes a task more, and tasks that it takes at least.
ROWS_PER_TASK, LEAST_TASKS = 20_000, 8
#: A signature's byte is the top one of the minimum times this: the minimum's own top bits are zero in large sets.
_SPREAD = np.uint32(0x9E3779B1)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_P), SHINGLE - 1 - i, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, stored: small tables don't take a task and a file for each shuffle partition."""
    return written(df.coalesce(max(LEAST_TASKS, rows // ROWS_PER_TASK)))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct 5-word shingles (of its whole sequence, if it has fewer words)."""
    return _shingles(text.lower().split())


def _shingles(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        out = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    else:
        n = len(h) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for i, p in enumerate(_POWERS):
            out += h[i : i + n] * p
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None], rng.integers(1, 1 << 63, HASHES // BANDS + 1, dtype=np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each universal hash a*x + b mod 2^32, the least value over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (a * x[None, i : i + 2048] + b).min(axis=1), out=least)
    return least


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, mix = _coefficients(7)
    rows = HASHES // BANDS
    for batch in batches:
        keys, counts, bands, sigs = [], [], [], []
        for text in batch.column("t").to_pylist():
            words = text.lower().split()
            s = _shingles(words)
            counts.append(len(s))
            if not len(s):
                keys.append(None), bands.append(None), sigs.append(None)
                continue
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            m = minima(s, a, b)
            wide = m.astype(np.uint64).reshape(BANDS, rows)
            key = (wide * mix[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * mix[rows]
            bands.append(key.view(np.int64))
            sigs.append(((m * _SPREAD) >> np.uint32(24)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_h"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "_h", "_k", "n_shingles", "_bands", "_sig"],
        )


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _h (hash of the text), _k (digest of the words, null without words), n_shingles, _bands (bucket keys), _sig
    (a byte a minimum).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("_h"), text_of(text).cast("binary").alias("t"))
    return rows.mapInArrow(_sign, "doc_id long, _h long, _k binary, n_shingles long, _bands array<long>, _sig binary")


def texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, t): the texts of the given nodes, whose rows are found by doc_id and the text's hash."""
    wanted = written(reps.select("node", F.col("rep").alias("doc_id"), "_h").join(small(nodes), "node"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("_h"), text_of(text).cast("binary").alias("t"))
    return rows.join(small(wanted), ["doc_id", "_h"]).select("node", "t").distinct()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
    for batch in batches:
        good = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            if x != last[0]:
                last = (x, shingle_set(x))
            other = shingle_set(y)
            both = len(np.intersect1d(last[1], other, assume_unique=True))
            good.append(100 * both >= MIN_PERCENT * (len(last[1]) + len(other) - both) > 0)
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the pairs (a, b) of nodes, a stored table, whose signatures agree and whose full shingle sets reach the similarity."""
    sig = lambda c: reps.select(F.col("node").alias(c), F.col("_sig").alias(f"s{c}"))
    likely = written(sig("a").join(small(pairs), "a").join(sig("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a long, b long"))
    nodes = packed(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * likely.count())
    texts = written(texts_of(nodes, reps, docs, text))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("t").alias(f"t{c}"))
    return written(side("a").join(small(likely), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components by alternating large-star and small-star; the least id names each.

    Each step joins edges with the least neighbour of their nodes, so no node's neighbours are ever gathered. Every round
    is written to the shared folder. It ends when all components are stars around their least nodes; each round brings nodes
    nearer to these, so there is no limit on the rounds (about log^2 of the largest component are enough).
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n = e.count()  # later rounds have no more
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = packed(both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")), 2 * n)
        # In stars a node has either one neighbour, its component's least node, or greater ones only.
        if near.filter("least < u AND n > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        large = both.join(small(near.select("u", F.least("u", "least").alias("m"))), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(large.filter("u <> v"), 2 * n)
        least = small(packed(large.groupBy("u").agg(F.min("v").alias("m")), n))
        small_ = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = packed(small_.filter("u <> v").distinct(), n)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "n", "s"])


def shared_shingles(held: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(sets, shared): rows (node, n, x) of all shingles x of sets of n, and (node, x) of those that some member of another
    component has too. Only the latter can be in an intersection across components.
    """
    who = packed(held.select("node", "c").distinct(), held.count())
    sets = texts_of(who.select("node"), reps, docs, text).mapInArrow(_sets, "node long, n long, s array<long>").dropDuplicates(["node"])
    one = written(sets.join(small(who), "node").select("node", "c", "n", F.explode("s").alias("x")))
    common = one.groupBy("x").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("x")
    return one, packed(one.join(common, "x").select("node", "x").distinct(), one.count())


def centred(held: DataFrame, sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, center, p): a member that others are likely copies of, and how many shared shingles of node it has too.

    For two members of one center the intersection is at most min(p, p') inside its set and min(s - p, s' - p') outside.
    A center of a large group meets its members in SALTS parts.
    """
    n = held.count()
    lead = held.groupBy("bucket").agg(F.max_by("node", F.struct(F.col("s") / F.col("n"), -F.col("node"))).alias("center"), F.max(F.col("s") / F.col("n")).alias("q"))
    center = packed(held.join(small(packed(lead, n)), "bucket").groupBy("node").agg(F.max_by("center", F.struct("q", -F.col("center"))).alias("center")), n)
    of = sets.join(center.select(F.col("center").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("center"), "x").distinct()
    of = of.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = shared.join(small(center), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    met = salted.join(of, ["center", "x", "salt"]).groupBy("node").agg(F.count("*").alias("p"))
    return packed(center.join(met, "node", "left").select("node", "center", F.coalesce("p", F.lit(0)).alias("p")), n)


def mixed_only(held: DataFrame, sizes: DataFrame | None, rows: int) -> DataFrame:
    """Of at most `rows` bucket members those that may still link across components: bucket, node, c and, with sizes, n and s.

    A link needs 100 |x & y| >= 75 |x | y|, which is 7 |x & y| >= 3 (|x| + |y|). The intersection is at most s of either, and
    the partner at least as large as its bucket's smallest member.
    """
    if sizes is not None:
        held = packed(held.join(small(sizes), "node"), rows)
        least = packed(held.groupBy("bucket").agg(F.min("n").alias("n0")), rows)
        held = held.join(small(least), "bucket").filter("7 * s >= 3 * (n + n0)").drop("n0")
    mixed = packed(held.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("bucket"), rows)
    return packed(held.join(small(mixed), "bucket", "left_semi"), rows)


def block_pairs(held: DataFrame, may: str) -> DataFrame:
    """(a, b), a < b: pairs of members of one bucket, in different components, for which `may` holds; each pair once, in the
    first bucket that both are in.

    A bucket's members are dealt to blocks of about BLOCK, and each two blocks meet under a key of their own, so that no key
    holds more than about BLOCK^2 pairs, however large the bucket is.
    """
    blocks = packed(held.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), held.count())
    dealt = held.join(small(blocks), "bucket").withColumn("i", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    names = ("node", "c", "n", "s", "center", "p", "_bands")
    x = dealt.select("bucket", "i", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), *[F.col(c).alias(f"{c}a") for c in names])
    y = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("_i"), F.col("i").alias("j"), *[F.col(c).alias(f"{c}b") for c in names]).withColumnRenamed("_i", "i")
    # Within a block every pair meets in both orders; of two blocks each pair meets once.
    met = x.join(y, ["bucket", "i", "j"]).filter(f"ca <> cb AND (i < j OR nodea < nodeb) AND {may} AND array_intersect(_bandsa, _bandsb)[0] = bucket")
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Texts without words (null, empty, white space) link with nothing. Rows that share a doc_id are one document with all
    their texts: what links with one of these links with the others. A null doc_id takes no part in links and has a null
    component_id; it is kept. An empty table gives an empty one.
    """
    signed = written(signatures(docs, text))
    taking_part = signed.filter("_k IS NOT NULL AND doc_id IS NOT NULL")
    # A node is a different text; its number is one of a stored table. Rows of one digest have equal bands and signatures.
    one = taking_part.groupBy("_k").agg(F.min(F.struct("doc_id", "_h")).alias("r"), F.first("_bands").alias("_bands"), F.first("_sig").alias("_sig"))
    reps = written(one.select("_k", F.col("r.doc_id").alias("rep"), "r._h", "_bands", "_sig", F.monotonically_increasing_id().alias("node")))
    rows = reps.select("node", F.explode("_bands").alias("bucket"))
    full = written(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1"))
    members = written(rows.join(small(full.select("bucket", "pivot")), "bucket").select("bucket", "node", "pivot"))

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    most = members.count()
    tested = packed(members.filter("node <> pivot").select(*ordered("node", "pivot")).distinct(), most)
    edges = verified(tested, reps, docs, text)
    several = written(taking_part.groupBy("doc_id").agg(F.min(F.xxhash64("_k")).alias("a"), F.max(F.xxhash64("_k")).alias("b")).filter("a <> b").select("doc_id"))
    if not several.isEmpty():
        own = written(taking_part.join(small(several), "doc_id", "left_semi").select("doc_id", "_k").distinct().join(reps.select("_k", "node"), "_k").select("doc_id", "node"))
        edges = written(edges.union(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))))
    # A bucket of two has been tested as a whole.
    members = members.join(small(written(full.filter("n > 2").select("bucket"))), "bucket", "left_semi").select("bucket", "node")
    sizes, labels = None, components(edges)
    for last in (False, True):
        held = mixed_only(members.join(small(labels), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c")), None, most)
        if held.isEmpty():
            break
        most = held.count()
        if sizes is None:
            sets, shared = shared_shingles(held, reps, docs, text)
            sizes = packed(sets.groupBy("node").agg(F.min("n").alias("n")).join(shared.groupBy("node").agg(F.count("*").alias("s")), "node"), most)
        held = mixed_only(held, sizes, most)
        if last:
            held = packed(held.join(small(centred(held, sets, shared)), "node").join(reps.select("node", "_bands"), "node"), most)
            both = "CASE WHEN centera = centerb THEN least(pa, pb) + least(sa - pa, sb - pb) ELSE least(sa, sb) END"
            new = block_pairs(held, f"7 * ({both}) >= 3 * (na + nb)")
        else:
            # The member that shares most with the others is the likeliest source of a group of edited copies.
            best = packed(held.groupBy("bucket").agg(F.max_by(F.struct("node", "c"), F.struct(F.col("s") / F.col("n"), -F.col("node"))).alias("p")), most)
            new = packed(held.join(small(best), "bucket").filter("c <> p.c").select(*ordered("node", "p.node")).distinct(), most)
        new = written(new.join(small(tested), ["a", "b"], "left_anti"))
        found = verified(new, reps, docs, text)
        if not found.isEmpty():  # a component's star stands for its edges
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        tested, members = tested.union(new), held.select("bucket", "node")
    named = reps.select("_k", "rep", "node").join(small(labels), "node", "left").select("_k", "rep", F.coalesce("component", "node").alias("c"))
    # Only components of several nodes need a look at the others' ids.
    least = written(named.groupBy("c").agg(F.count("*").alias("n"), F.min("rep").alias("component_id")).filter("n > 1").select("c", "component_id"))
    named = written(named.join(small(least), "c", "left").select("_k", F.coalesce("component_id", "rep").alias("component_id")))
    # Rows without a digest get one of their own, as equal join keys would meet in one task.
    own = signed.select("doc_id", "n_shingles", F.coalesce("_k", F.concat(F.lit("-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).cast("binary")).alias("_k"))
    out = own.join(named, "_k", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
