"""Packing documents into sequences: best-fit decreasing in parts, certified by dual-feasible-function bounds.

Tokenised pieces are dealt to parts. A part places its pieces, longest first, where they fit best, and computes a lower
bound on the number of bins for them; one that meets its bound is done. The pieces of the others' bins that aren't full
are exchanged: dealt anew to fewer parts and packed again, as long as that takes fewer bins.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import small, text_of, written

CAPACITY = 1024
END = 2
PIECES_PER_PART = 50_000
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str):
    """text -> ids as the `tokenizers` file gives them without added tokens.

    The same vocabulary as ranks gives the same ids several times faster; texts that hold the special token's string,
    which only the former treats apart, or that the faster one can't take, go to the former.
    """
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(ranks), "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    slow = functools.lru_cache(maxsize=1)(lambda: __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path(tokenizer)))

    def encode(text: str) -> np.ndarray:
        if _SPECIAL not in text:
            try:
                return fast.encode_to_numpy(text)
            except ValueError as error:  # a run of white space that is beyond the regular expression's stack
                if "Regex error" not in str(error):
                    raise
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which has the rest."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _tokenise(tokenizer: str, ranks: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, full = encoder(tokenizer, ranks), (1 << 62) + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                ids = np.append(encode(text), [END]).astype("<u4")
                for i, (s, n) in enumerate(cut(len(ids), capacity)):
                    own = None
                    if n == capacity:
                        own, full = full, full + 1
                    rows.append((doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes()), own))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECE)

    return pieces


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "own"]
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part long, bins long, bound long"


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, own (a sequence number for pieces that fill one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t"))
    return rows.mapInArrow(_tokenise(tokenizer, ranks, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, own long")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound on the bins for counts[n] items of size n: the best of two families of dual feasible functions.

    Such a function u has sum(u(x)) <= 1 for any sizes x that fit into one bin of size 1, so ceil(sum of u) bounds the bins.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    below, weight = np.cumsum(counts), np.cumsum(counts * size)
    for k in range(1, capacity // 2 + 1):
        # sizes over capacity - k count as 1, those under k as 0, others as they are; both ends are one function
        mid = weight[capacity - k] - weight[k - 1]
        best = max(best, int(below[capacity] - below[capacity - k]) - int(-mid // capacity))
    for k in range(1, 101):
        # x stays where (k + 1)x is whole; else it is rounded down to a multiple of 1/(k + 1) and weighed by 1/k
        whole, rest = np.divmod((k + 1) * size, capacity)
        u = np.where(rest == 0, k * whole, (k + 1) * whole)
        best = max(best, -(-int((counts * u).sum()) // (k * (k + 1))))
    return best


class BestFit:
    """Open bins by free space. place() puts an item where the least space stays free, else into a new bin."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.bins, self.free, self.mask = capacity, 0, [[] for _ in range(capacity + 1)], 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset)."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            i = self.free[room].pop()
            if not self.free[room]:
                self.mask ^= 1 << room
        else:
            room, i = self.capacity, self.bins
            self.bins += 1
        left = room - size
        if left:
            self.free[left].append(i)
            self.mask |= 1 << left
        return i, self.capacity - room


def _pack(capacity: int, number: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (number << 24) + TaskContext.get().partitionId()
        fit, counts = BestFit(capacity), np.zeros(capacity + 1, np.int64)
        nothing = lambda n: pa.nulls(n, pa.int64())
        for batch in batches:
            sizes = batch.column("length").to_pylist()
            placed = [fit.place(n) for n in sizes]
            counts += np.bincount(sizes, minlength=capacity + 1)
            ids = pa.array([(part << 24) + i for i, _ in placed], pa.int64())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE[:5]), ids, pa.array([o for _, o in placed], pa.int64()), pa.array([part] * n, pa.int64()), nothing(n), nothing(n)], names=[x.split()[0] for x in _PLACED.split(", ")])
        if fit.bins:  # the last row certifies the part
            row = {"part": part, "bins": fit.bins, "bound": lower_bound(counts, capacity)}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(k)], pa.int32() if k == "piece" else pa.int64()) for k in (x.split()[0] for x in _PLACED.split(", "))], names=[x.split()[0] for x in _PLACED.split(", ")])

    return pack


def _packed(rows: DataFrame, parts: int, number: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(placed pieces, certificates)."""
    # Pieces of one document may share all columns, so the deal hashes them with the round, not their ids alone.
    dealt = rows.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(number))).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    out = written(dealt.mapInArrow(_pack(capacity, number), _PLACED))
    return out.filter("bins IS NULL").drop("bins", "bound"), out.filter("bins IS NOT NULL").select("part", "bins", "bound")


def best_fit_packing(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, per_part: int = PIECES_PER_PART, **tokenizer: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null text is empty and so is one token, the end. Repeated rows are packed each for itself; pieces of equal length are
    placed in the order of doc_id and piece, so ties decide nothing but places. An empty table gives an empty one. Parts
    hold about `per_part` pieces, and up to four times as many in exchanges, so a task's memory doesn't depend on the input.
    Rounds of exchange go on as long as one saves a sequence; after one that doesn't, fewer and larger parts are tried, until
    they are as large as they may be. certified: the sequence is full, or its part meets the lower bound on its number.
    """
    every = written(pieces(docs, text, capacity, **tokenizer))
    todo = every.filter("own IS NULL").drop("own")
    keep = [*_PIECE[:5], "sequence_id", "offset"]
    done = [every.filter("own IS NOT NULL").select(*_PIECE[:5], F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    placed, parts_of = _packed(todo, max(1, -(-todo.count() // per_part)), 1, capacity)
    failed, tried = 0, 0
    for number in itertools.count(2):
        # Certified parts stay as they are. So do full bins of the others, unless that leaves nothing to gain.
        open_parts = parts_of.filter("bins > bound").select("part")
        n_open = open_parts.count()
        if not n_open:
            break
        if not failed:
            mine = placed.join(small(open_parts), "part", "left_semi")
            gaps = mine.groupBy("sequence_id").agg(F.sum("length").alias("used")).filter(F.col("used") < capacity).select("sequence_id")
            loose = written(mine.join(gaps, "sequence_id", "left_semi"))
            n, old = loose.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        parts = max(1, -(-n // (4 * per_part)), min(n_open >> (1 + failed), -(-n // per_part)))
        if failed and parts == tried:
            break
        again, certified = _packed(loose.select(*_PIECE[:5]), parts, number, capacity)
        new = certified.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
        tried = parts
        if new >= old:
            failed += 1
            continue
        failed = 0
        stays = placed.join(loose.select("sequence_id").distinct(), "sequence_id", "left_anti")
        done.append(stays.select(*keep, F.lit(True).alias("certified")))  # full, or of a part that meets its bound
        placed, parts_of = again, certified
    gap = small(parts_of.filter("bins > bound").select("part", F.lit(False).alias("met")))
    full = F.sum("length").over(Window.partitionBy("sequence_id")) == capacity
    done.append(placed.join(gap, "part", "left").select(*keep, (F.coalesce("met", F.lit(True)) | full).alias("certified")))
    return functools.reduce(DataFrame.union, done)
