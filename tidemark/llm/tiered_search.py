"""Exact ranked search over a tiered index: postings of high impact first, lower tiers only where a proof fails.

Each task counts the asked terms of its documents; document frequencies follow from these counts. A posting's impact is its
term's weight times a saturating share of its count. The stored index has a row for each document and the postings of each
tier in columns of their own, so a search of the first tiers leaves the others on disk; with it goes, for every term, the
highest share below each tier (the residual bound).

A search sums impacts document by document in tasks and keeps ten documents an item and task. What the read tiers give is a
lower bound of a score; residual bounds of all terms that a document didn't show there make an upper one. An item is proven
once no document without a posting in the read tiers can reach its tenth lower bound: then the documents whose upper
bounds can are read whole. Any other item falls through to the next tier, and the last tier leaves nothing to prove.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, small, text_of, words_between, written

BEST = 10
#: The shares of all postings that the first and the first two tiers hold, about. Any shares give right results.
SHARES = (0.05, 0.3)
TIERS = len(SHARES) + 1
#: Items are searched in blocks of about so many distinct terms together, which the driver and each task hold.
TERMS_PER_BLOCK = 500_000
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a UTF-8 text: A-Z lower-cased, what separates terms made a space; bytes beyond ASCII belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_PIECE = 1 << 20
#: Contributions and cells (documents by items) that a task sums at once.
_AT_ONCE = 2_000_000


def terms_of(text: Column) -> Column:
    """Terms `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased."""
    return words_between(ascii_lower(text), _NO_TERM)


def _counts(text: bytes) -> Counter:
    """Terms of a whole text with their counts; long texts are split in pieces between terms."""
    folded, counts, start = text.translate(_FOLD), Counter(), 0
    while start < len(folded):
        end = len(folded) if len(folded) - start <= _PIECE else folded.find(b" ", start + _PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[start:end].split())
        start = end
    return counts


class _Lists:
    """Integer lists of different lengths as an Arrow array."""

    def __init__(self):
        self.values, self.ends = [], [0]

    def add(self, values) -> None:
        self.values.extend(values)
        self.ends.append(len(self.values))

    def array(self, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.values, kind))


_COUNTED = "r long, doc_id long, n long, total long, ids array<int>, counts array<long>"


def _counter(terms: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with asked terms; at the end a row (r = -1) of this task's documents, terms and frequencies."""
        ids, r = terms.value, TaskContext.get().partitionId() << 33
        docs, total, df = 0, 0, Counter()
        for batch in batches:
            rows, found, times = [], _Lists(), _Lists()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                counts = _counts(text.as_py())
                n = counts.total()
                docs, total = docs + (n > 0), total + n
                if hits := counts.keys() & ids.keys():
                    own = [ids[t] for t in hits]
                    df.update(own)
                    found.add(own)
                    times.add([counts[t] for t in hits])
                    rows.append((r, doc, n, 0))
                    r += 1
            yield _batch(rows, found, times)
        found, times = _Lists(), _Lists()
        found.add(df.keys())
        times.add(df.values())
        yield _batch([(-1, None, docs, total)], found, times)

    return count


def _batch(rows: list[tuple], found: _Lists, times: _Lists) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns), found.array(pa.int32()), times.array(pa.int64())], names=["r", "doc_id", "n", "total", "ids", "counts"])


_TIERED = "r long, doc_id long, " + ", ".join(f"ids{j} array<int>, shares{j} array<int>" for j in range(TIERS))


def _tierer(weights: Broadcast, least: tuple[float, ...], docs: int, total: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings by tier; at the end a row (r = -1) of each term's highest share in each tier."""
        w = weights.value
        highest = np.zeros((TIERS, len(w)), np.int64)
        for batch in batches:
            ids, tf, ends = _flat(batch.column("ids"), batch.column("counts"))
            # The length factor in Python's integers: its product passes 64 bits on large tables.
            m = np.array([25 + 75 * n * docs // total for n in batch.column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(m)), np.diff(ends))
            share = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            tier = sum((w[ids] * share < x).astype(np.int64) for x in least) if len(ids) else np.zeros(0, np.int64)
            out = [batch.column("r"), batch.column("doc_id")]
            for j in range(TIERS):
                own = tier == j
                np.maximum.at(highest[j], ids[own], share[own])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=len(m)))])
                out += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x[own], pa.int32())) for x in (ids, share)]
            yield pa.RecordBatch.from_arrays(out, names=_names(range(TIERS)))
        out = [pa.array([-1], pa.int64()), pa.array([None], pa.int64())]
        for j in range(TIERS):
            used = np.flatnonzero(highest[j])
            out += [pa.array([used], pa.list_(pa.int32())), pa.array([highest[j][used]], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(out, names=_names(range(TIERS)))

    return deal


def _names(tiers) -> list[str]:
    return ["r", "doc_id", *[c for j in tiers for c in (f"ids{j}", f"shares{j}")]]


def _flat(ids: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = ids.offsets.to_numpy()
    return ids.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.int64), ends - ends[0]


class _Asked(NamedTuple):
    """Items of a search by term: first[t]:first[t + 1] are the places of term t's items, what a full share gives them there, and
    what its residual bound gives.
    """

    first: np.ndarray
    item: np.ndarray
    gain: np.ndarray
    rest: np.ndarray
    items: int


def _asked(rows: list[tuple[int, int, int]], weights: np.ndarray, highest_below: np.ndarray) -> _Asked:
    """From (term, item, times) in the order of terms."""
    term, item, times = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    gain = times * weights[term]
    return _Asked(np.searchsorted(term, np.arange(len(weights) + 1)), item, gain, gain * highest_below[term], int(item.max()) + 1)


def _sums(key: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Exact 64-bit sums by cell: float sums of the values' two halves stay below 2 ** 53."""
    return (np.bincount(key, values >> 22, cells).astype(np.int64) << 22) + np.bincount(key, values & ((1 << 22) - 1), cells).astype(np.int64)


def _blocks(batch: pa.RecordBatch, tiers: int, asked: _Asked):
    """(documents from, to, sums, residual sums of the terms that were seen) for parts of a batch, as documents by items."""
    parts = [_flat(batch.column(f"ids{j}"), batch.column(f"shares{j}")) for j in range(tiers)]
    ids, share = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    doc = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(p[2])) for p in parts])
    order = np.argsort(doc, kind="stable")
    ids, share, doc = ids[order], share[order], doc[order]
    many = asked.first[ids + 1] - asked.first[ids]
    steps = np.concatenate([[0], np.cumsum(np.bincount(doc, many, batch.num_rows).astype(np.int64) + asked.items)])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(steps, steps[start] + _AT_ONCE, "right")) - 1)
        a, b = np.searchsorted(doc, [start, end])
        n = many[a:b]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.first[ids[a:b]], n)
        key = np.repeat(doc[a:b] - start, n) * asked.items + asked.item[place]
        cells = (end - start) * asked.items
        yield start, end, _sums(key, asked.gain[place] * np.repeat(share[a:b], n), cells).reshape(-1, asked.items), lambda k=key, p=place, c=cells: _sums(k, asked.rest[p], c).reshape(-1, asked.items)
        start = end


_FOUND = "item int, score long, doc_id long, r long"
_NULL = np.iinfo(np.int64).min


def _best_of(tiers: int, of: Broadcast):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The BEST documents of this task for each item by what the first tiers give."""
        asked = of.value
        kept = np.zeros((0, 4), np.int64)
        least = np.ones(asked.items, np.int64)
        for batch in batches:
            r, doc = batch.column("r").to_numpy(), batch.column("doc_id").fill_null(_NULL).to_numpy()
            for start, _, sums, _ in _blocks(batch, tiers, asked):
                row, item = np.nonzero(sums >= least)
                if not len(row):
                    continue
                more = np.stack([item, sums[row, item], doc[start + row], r[start + row]], axis=1)
                kept = np.concatenate([kept, more])
                kept = kept[np.lexsort((kept[:, 3], kept[:, 2], -kept[:, 1], kept[:, 0]))]
                rank = np.arange(len(kept)) - np.searchsorted(kept[:, 0], kept[:, 0])
                last = kept[rank == BEST - 1]
                least[last[:, 0]] = last[:, 1]
                kept = kept[rank < BEST]
        columns = [pa.array(kept[:, 0], pa.int32()), pa.array(kept[:, 1]), pa.array(kept[:, 2], mask=kept[:, 2] == _NULL), pa.array(kept[:, 3])]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "score", "doc_id", "r"])

    return best


def _reaching(tiers: int, of: Broadcast, least: np.ndarray):
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents whose upper bound reaches `least` for some item."""
        asked = of.value
        bound = _sums(asked.item, asked.rest, asked.items)
        for batch in batches:
            for start, end, sums, seen in _blocks(batch, tiers, asked):
                can = ((sums > 0) & (sums + bound - seen() >= least)).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("r").to_numpy()[start:end][can])], names=["r"])

    return reach


def _top(found: DataFrame) -> DataFrame:
    """found with its rank: the first BEST of an item by score, then doc_id (null first), then row."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "r")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


class Index(NamedTuple):
    """A stored index of documents over a block's terms, the terms' weights, and their highest shares below each tier."""

    rows: DataFrame
    weights: np.ndarray
    below: list[np.ndarray]


def build_index(docs: DataFrame, terms: list[str], text: str = "text") -> Index | None:
    """The tiered index of all documents over the given terms; None where no document has a term of any kind."""
    context = docs.sparkSession.sparkContext
    ids = context.broadcast({t.encode(): i for i, t in enumerate(terms)})
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    counted = written(whole.mapInArrow(_counter(ids), _COUNTED))
    of_tasks = counted.filter("r = -1")
    n, total = of_tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not n:
        return None
    df = np.zeros(len(terms), np.int64)
    for row in of_tasks.select(F.explode(F.arrays_zip("ids", "counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.counts").alias("df")).collect():
        df[row["ids"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    heavy = np.argsort(-weights, kind="stable")
    shares = np.cumsum(df[heavy]) / max(1, df.sum())
    typical = 1_000_000_000 // 1800  # the share of a term that a document of mean length has once
    least = tuple(float(weights[heavy[min(len(heavy) - 1, int(np.searchsorted(shares, s)))]] * typical) for s in SHARES)
    tiered = written(counted.filter("r >= 0").mapInArrow(_tierer(context.broadcast(weights), least, n, total), _TIERED))
    highest = np.zeros((TIERS, len(terms)), np.int64)
    for j in range(1, TIERS):
        tops = tiered.filter("r = -1").select(F.explode(F.arrays_zip(f"ids{j}", f"shares{j}")).alias("x"))
        for row in tops.groupBy(F.col(f"x.ids{j}").alias("t")).agg(F.max(f"x.shares{j}").alias("m")).collect():
            highest[j, row["t"]] = row["m"]
    below = [highest[j + 1 :].max(axis=0) if j + 1 < TIERS else np.zeros(len(terms), np.int64) for j in range(TIERS)]
    return Index(tiered.filter("r >= 0"), weights, below)


def search(index: Index, asked: list[tuple[int, int, int]]) -> DataFrame:
    """(item, rank, doc_id, score, tiers) of the BEST documents with a score above 0 for each item of asked (term, item, times)."""
    context, results, open_ = index.rows.sparkSession.sparkContext, [], sorted(asked)
    for tiers in range(1, TIERS + 1):
        if not open_:
            break
        below = index.below[tiers - 1]
        of = _asked(open_, index.weights, below)
        held = context.broadcast(of)
        rows = index.rows.select(_names(range(tiers)))
        found = written(_top(rows.mapInArrow(_best_of(tiers, held), _FOUND)))
        if tiers == TIERS:
            results.append(found.withColumn("tiers", F.lit(tiers)))
            break
        tenth = {r["item"]: r["score"] for r in found.filter(F.col("rank") == BEST).select("item", "score").collect()}
        bound = _sums(of.item, of.rest, of.items)
        proven = {i for i, score in tenth.items() if bound[i] < score}
        if proven:
            least = np.full(of.items, np.iinfo(np.int64).max)
            least[list(proven)] = [tenth[i] for i in proven]
            can = written(rows.mapInArrow(_reaching(tiers, held, least), "r long").distinct())
            whole = context.broadcast(_asked([x for x in open_ if x[1] in proven], index.weights, below))
            read = index.rows.join(small(can), "r", "left_semi").select(_names(range(TIERS)))
            results.append(written(_top(read.mapInArrow(_best_of(TIERS, whole), _FOUND))).withColumn("tiers", F.lit(tiers)))
            open_ = [x for x in open_ if x[1] not in proven]
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("item", "rank", "doc_id", "score", "tiers")


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score, tiers (how many were read) of the ten best documents of every row of items.

    Null and empty texts have no terms: such items get no rows, such documents are in no result and not counted. Equal scores
    go by doc_id, null first (the least 64-bit id counts as null). Repeated items and documents are rows of their own. Very long
    texts are read whole. Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    rows = written(items.select(F.col(item_id).alias("item_id"), terms_of(text_of(item_text)).alias("_terms"), F.monotonically_increasing_id().alias("_q")).filter(F.size("_terms") > 0))
    wanted = written(rows.select("_q", F.explode("_terms").alias("term")).groupBy("_q", "term").agg(F.count("*").alias("times")))
    blocks = -(-wanted.count() // TERMS_PER_BLOCK)
    out = rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("tiers")).limit(0)
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).collect()  # about TERMS_PER_BLOCK rows
        if not block:
            continue
        terms, numbers = {t: i for i, t in enumerate(sorted({x["term"] for x in block}))}, sorted({x["_q"] for x in block})
        index = build_index(docs, list(terms), text)
        if index is None:
            break
        of = {q: i for i, q in enumerate(numbers)}
        found = search(index, [(terms[x["term"]], of[x["_q"]], x["times"]) for x in block])
        named = spark.createDataFrame([(i, q) for q, i in of.items()], "item int, _q long")
        out = out.union(found.join(F.broadcast(named), "item").join(small(rows.select("_q", "item_id")), "_q").select("item_id", "rank", "doc_id", "score", "tiers"))
    return out
