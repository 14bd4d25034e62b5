"""Repeated passages by content-defined chunks: a gear rolling hash sets the cuts, digests find chunks that occur twice.

A cut depends on the last 16 bytes alone, so a passage is cut alike wherever it stands and an insertion moves no later
cut. Pairs of neighbouring chunks are exchanged as two 64-bit digests and a place; repeats inside a text are found where it is
cut. Chunks are short, so that little of a passage is lost in the partial ones at its ends; pairs are long enough that
common phrases alone don't make passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import doc_key, small, text_of, written

#: A cut where four bits of the hash are zero: chunks of about 16 bytes beyond the least size.
MASK, SHIFT = np.uint32(15), np.uint32(11)
LEAST, MOST = 8, 128
#: Shared pairs in a row count as a repeated passage from so many bytes on: about half of a passage of 50 words.
RUN = 120
#: Without a cut for MOST bytes, the next stands at the hash's greatest value in so many bytes beyond the least size.
NEAR = 32
SLAB, BLOCK = 1 << 22, 1 << 16
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + gear[byte] mod 2^32 at every byte, by doubling: five vector steps give all 32 terms."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the hash says so, but at least LEAST and at most about MOST bytes after the one before.

    Where it says so nowhere for over MOST bytes, cuts stand at its first greatest value in each NEAR bytes, so that
    repetitive passages too are cut alike in every place. No cut stands inside a character: those places are passed over.
    """
    n, out, last = len(data), [], 0

    def forced(to: int) -> None:
        nonlocal last
        gap = to - last > MOST
        while gap and to - last > LEAST + NEAR:
            base, end = last, min(to, last + BLOCK)
            back = min(base, 15)
            raw = np.frombuffer(data, np.uint8, end - base + back + (end < n), base - back)
            inside = (np.append(raw, 0)[back + 1 : back + 1 + end - base] & 0xC0) == 0x80
            # The low 16 bits depend on the last 16 bytes alone.
            rank = np.where(inside, -1, (rolling(raw)[back : back + end - base] & np.uint32(0xFFFF)).astype(np.int32))
            while to - last > LEAST + NEAR and last + LEAST + NEAR <= end:
                at = rank[last + LEAST - 1 - base : min(last + LEAST + NEAR, to - LEAST) - base]
                best = int(at.argmax())
                last += LEAST + best if at[best] >= 0 else NEAR
                out.append(last)

    for s in range(0, n, SLAB):
        back = min(s, 31)
        raw = np.frombuffer(data, np.uint8, min(SLAB, n - s) + back, s - back)
        starts = np.append(raw[1:] & 0xC0 != 0x80, s + SLAB >= n or data[s + SLAB] & 0xC0 != 0x80)
        hit = ((rolling(raw) >> SHIFT) & MASK == 0) & starts
        for at in (np.flatnonzero(hit[back:]) + s + 1).tolist():
            if at - last > MOST:
                forced(at)
            if at - last >= LEAST:
                last = at
                out.append(last)
    forced(n)
    if last < n:
        out.append(n)
    return out


def _digests(text: bytes, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk with the next (of a text's only one alone) both halves of the digest, and whether the text holds it
    once (0), for the first time of several (1) or again (2).
    """
    digest = xxhash.xxh3_128_digest
    pairs = [digest(text[s:e]) for s, e in zip([0, *ends], ends[1:] or ends)]
    own = np.zeros(len(pairs), np.int8)
    if len(set(pairs)) < len(pairs):
        first: dict[bytes, int] = {}
        for i, x in enumerate(pairs):
            if (j := first.setdefault(x, i)) != i:
                own[i], own[j] = 2, 1
    halves = np.frombuffer(b"".join(pairs), ">i8").astype(np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1], own


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start = batch.column("t"), 0
        while start < len(texts):  # rows of about SLAB bytes at a time
            held, size, i = [], 0, start
            while i < len(texts) and size < SLAB:
                text = texts[i].as_py()
                ends = cuts(text)
                held.append((np.array(ends, np.int32), *_digests(text, ends)))
                size += len(text)
                i += 1
            lists = [_lists(list(x), t) for x, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int8()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_d").slice(start, i - start), batch.column("_h").slice(start, i - start), *lists], names=["_d", "_h", "ends", "d1", "d2", "own"])
            start = i


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """_d, _h, ends (of the chunks, in bytes), d1, d2 (digests of each chunk with the next, or of a text's only one), own
    (0: the text holds that pair once, 1: for the first time of several, 2: again).
    """
    t = text_of(text)
    return docs.select(*doc_key(docs, t), t.cast("binary").alias("t")).mapInArrow(_chunks, "_d long, _h long, ends array<int>, d1 array<long>, d2 array<long>, own array<byte>")


SPANS = "array<struct<start:int,end:int,later:boolean,dropped:array<struct<start:int,end:int>>>>"


def _merged(places: list[dict], run: int) -> list[list[int]]:
    """Places in a row become one, [start, end]; those of at least `run` bytes are returned."""
    out = []
    for x in places:
        if out and x["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["e"])
        else:
            out.append([x["s"], x["e"]])
    return [x for x in out if x[1] - x[0] >= run]


def _runs(run: int):
    place = [("start", pa.int32()), ("end", pa.int32())]
    kind = pa.list_(pa.struct([*place, ("later", pa.bool_()), ("dropped", pa.list_(pa.struct(place)))]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared pairs in a row become a span; dropped are the runs in it of pairs that an earlier document holds too."""
        for batch in batches:
            out = []
            for found in batch.column("found").to_pylist():
                found.sort(key=lambda x: x["s"])
                taken, spans, i = _merged([x for x in found if x["later"]], run), [], 0
                for s, e in _merged(found, run):
                    dropped = []
                    while i < len(taken) and taken[i][0] < e:
                        dropped.append({"start": taken[i][0], "end": taken[i][1]})
                        i += 1
                    spans.append({"start": s, "end": e, "later": bool(dropped), "dropped": dropped})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_h"), batch.column("n_chunks"), pa.array(out, kind)], names=["_d", "_h", "n_chunks", "spans"])

    return merge


def repeated_passages(docs: DataFrame, text: str = "text", run: int = RUN) -> DataFrame:
    """A row for each row of docs: doc_id, _d, _h, n_bytes, n_chunks, spans (start, end, later, dropped).

    A span is a passage of at least `run` bytes (0: of any size) of which every pair of chunks occurs elsewhere too, in
    another row or in the same text, in UTF-8 offsets. Of equal pairs the first in the order of doc_id (nulls first), hash
    of the text and offset stays; dropped: the passages in the span, of at least `run` bytes, whose pairs all come later,
    so that taking them out leaves one copy; later: there are such. Rows that are equal in doc_id and text can't be told
    apart: they get equal spans, which say that the rows repeat, and none of them is later than another. Null and empty
    texts have no chunks. Repeated rows stay; an empty table gives an empty one.
    """
    every = chunks(docs, text)
    pair = F.arrays_zip("d1", "d2", "own")
    # Of a row's equal pairs one is sent; a hot pair shrinks to a row for each task before the shuffle.
    one = every.select("_d", F.explode(F.filter(pair, lambda c: c["own"] < 2)).alias("c")).select(F.col("c.d1").alias("d1"), F.col("c.d2").alias("d2"), "_d")
    seen = one.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("_d").alias("first"))
    shared = written(seen.filter("n > 1").select("d1", "d2", "first"))
    at = lambda i: F.struct(F.coalesce(F.get("ends", i - 1), F.lit(0)).alias("s"), F.coalesce(F.get("ends", i + 1), F.get("ends", i)).alias("e"), F.get("d1", i).alias("d1"), F.get("d2", i).alias("d2"), F.get("own", i).alias("own"))
    # A place more for each row brings its number of chunks, so that texts are cut twice only.
    count = F.struct(F.lit(-1).alias("s"), F.size("ends").alias("e"), F.col("_h").alias("d1"), F.col("_d").alias("d2"), F.lit(3).cast("byte").alias("own"))
    places = every.select("_d", "_h", F.explode(F.concat(F.transform("own", lambda _, i: at(i)), F.array(count))).alias("c")).select("c.*", "_d", "_h")
    met = places.join(shared, ["d1", "d2"], "left").filter("first IS NOT NULL OR own > 0")
    # The least id may have several rows; then the least hash of these decides.
    rows = docs.select(*doc_key(docs, text_of(text)))
    several = written(rows.groupBy("_d").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).filter("a <> b").select("_d"))
    behind = (F.col("own") == 2) | F.coalesce(F.col("_d") > F.col("first"), F.lit(False))
    if not several.isEmpty():
        tied = met.filter("_d = first").join(small(several), "_d", "left_semi").groupBy("d1", "d2").agg(F.min("_h").alias("h0"))
        met = met.join(tied, ["d1", "d2"], "left")
        behind = behind | F.coalesce((F.col("_d") == F.col("first")) & (F.col("_h") > F.col("h0")), F.lit(False))
    place, t = F.struct("s", "e", behind.alias("later")), text_of(text)
    found = met.groupBy("_d", "_h").agg(F.collect_set(F.when(F.col("own") < 3, place)).alias("found"), F.max(F.when(F.col("own") == 3, F.col("e"))).cast("long").alias("n_chunks"))
    spans = found.mapInArrow(_runs(run), f"_d long, _h long, n_chunks long, spans {SPANS}")
    out = docs.select("doc_id", *doc_key(docs, t), F.octet_length(t).cast("long").alias("n_bytes")).join(spans, ["_d", "_h"], "left")
    return out.select("doc_id", "_d", "_h", "n_bytes", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """The text without what its spans drop."""
    later = F.sort_array(F.flatten(F.transform(spans, lambda s: s["dropped"])))
    data = text.cast("binary")
    # Bytes between the dropped parts, which may cut characters, join as hex.
    end = lambda i: F.coalesce(F.get(later, i)["end"], F.lit(0))
    upto = lambda i: F.coalesce(F.get(later, i)["start"], F.octet_length(data))
    pieces = F.transform(F.sequence(F.lit(0), F.size(later)), lambda i: F.hex(F.substring(data, end(i - 1) + 1, upto(i) - end(i - 1))))
    return F.when(F.size(later) == 0, text).otherwise(F.decode(F.unhex(F.array_join(pieces, "")), "UTF-8"))
