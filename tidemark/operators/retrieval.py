"""Lexical and vector retrieval over filtered chunks, fused by ranks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text import tokens
from tidemark.storage import BROADCAST_BYTES, BROADCAST_ROWS, packed_size, small, written

K1, B, RRF = 1.5, 0.75, 60
#: Scores (chunks by queries) that a task holds at once, and the distance below which two may be equal once rounded.
CELLS, NEAR = 2_000_000, 2e-9


def term_frequencies(chunks: DataFrame, pattern: str = r"[a-z0-9$%.\-]+") -> DataFrame:
    """(chunk_id, dl, term, tf)."""
    t = chunks.select("chunk_id", tokens(F.col("text"), pattern).alias("w"))
    return t.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, query: list[str]) -> DataFrame:
    """(chunk_id, score) of chunks that hold a query term; a term that the query repeats counts each time.

    Corpus statistics are those of the given chunks, that is, after any filter. Only the query's terms are exploded.
    """
    spark = chunks.sparkSession
    terms = spark.createDataFrame([(t,) for t in query], "term string").groupBy("term").agg(F.count("*").alias("times"))
    wanted = F.array(*[F.lit(t) for t in sorted(set(query))])
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("w")).select("chunk_id", F.size("w").alias("dl"), F.filter("w", lambda w: F.array_contains(wanted, w)).alias("hit"))
    corpus = F.broadcast(split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    tf = split.select("chunk_id", "dl", F.explode("hit").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df.join(terms, "term")), "term").join(corpus)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.groupBy("chunk_id").agg(F.sum(F.col("times") * idf * weight).alias("score"))


def bm25_each(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, chunk_id, score) for every row of queries (query, text), as bm25 gives them one by one.

    Chunks meet queries by equal terms; only terms of queries are counted.
    """
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("w")).select("chunk_id", F.size("w").alias("dl"), "w")
    corpus = F.broadcast(split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    tf = split.select("chunk_id", "dl", F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    j = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").join(corpus)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.select("chunk_id", "term", (idf * weight).alias("part")).join(asked, "term").groupBy("query", "chunk_id").agg(F.sum(F.col("times") * F.col("part")).alias("score"))


def _hits(terms: pa.Array):
    """From batches (chunk_id, dl, w): the numbers of the terms in w, ascending, and how often each occurs there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            of, at = words.flatten(), pc.index_in(words.flatten(), value_set=terms)
            row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.is_valid(at).to_numpy(zero_copy_only=False) if len(of) else np.zeros(0, bool)
            cell, times = np.unique(row[known] * len(terms) + at.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(cell, np.arange(len(batch) + 1) * len(terms)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell % len(terms), times)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("dl"), *lists], names=["chunk_id", "dl", "term", "tf"])

    return count


def _best(idf: np.ndarray, avgdl: float, first: np.ndarray, query: np.ndarray, times: np.ndarray, queries: int, k: int):
    """From batches of _hits: of each query the chunks that may be among the k best of the batch. Term t is in the queries query[i], so
    many times, for i from first[t] to first[t + 1]. Of chunks with one score the k least ids are enough.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // queries)
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                n = len(batch)
                terms, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
                row = pc.list_parent_indices(batch.column("term")).to_numpy(zero_copy_only=False).astype(np.int64)
                dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(float)[row]
                part = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                many = first[terms + 1] - first[terms]
                at = np.repeat(first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())
                scores = np.bincount(query[at] * n + np.repeat(row, many), times[at] * np.repeat(part, many), queries * n).reshape(queries, n)
                least = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else np.zeros((queries, 1))
                q, i = np.nonzero((scores > 0) & (scores >= least - NEAR))
                place = np.empty(n, np.int64)
                place[pc.sort_indices(batch.column("chunk_id"), null_placement="at_start").to_numpy(zero_copy_only=False)] = np.arange(n)
                order = np.lexsort((place[i], scores[q, i], q))
                q, i = q[order], i[order]
                value = scores[q, i]
                new = np.concatenate([[True], (q[1:] != q[:-1]) | (value[1:] != value[:-1])]) if len(q) else np.zeros(0, bool)
                kept = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) < k
                q, i, value = q[kept], i[kept], value[kept]
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), batch.column("chunk_id").take(pa.array(i)), pa.array(value)], names=["q", "chunk_id", "score"])

    return score


def best_each(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, chunk_id, place): top_each(bm25_each(chunks, queries), k).

    Where the queries' terms are few enough to broadcast, a task scores its chunks against all queries and hands on the best
    of each batch, so neither words nor scores are shuffled. Otherwise, and where chunks share an id, they meet by joins.
    """
    asked = written(queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")))
    rows, size = packed_size(asked)
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not rows or rows > BROADCAST_ROWS or size > BROADCAST_BYTES or not twice.isEmpty():
        return top_each(bm25_each(chunks, queries), k)
    names = [r["query"] for r in asked.select("query").distinct().collect()]  # at most BROADCAST_ROWS, as counted
    number = {q: i for i, q in enumerate(names)}
    table = sorted((r["term"], number[r["query"]], r["times"]) for r in asked.collect())
    terms = sorted({t for t, _, _ in table})
    count = Counter(t for t, _, _ in table)
    first = np.cumsum([0, *(count[t] for t in terms)])

    split = chunks.select("chunk_id", tokens(F.col("text")).alias("w")).select("chunk_id", F.size("w").alias("dl"), "w")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    hits = written(split.mapInArrow(_hits(pa.array(terms, pa.string())), f"chunk_id {kind}, dl int, term array<int>, tf array<int>"))
    n, avgdl = hits.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(terms))
    for r in hits.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term
        df[r["term"]] = r["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    score = _best(idf, avgdl or 1.0, first, np.array([q for _, q, _ in table]), np.array([t for *_, t in table], float), len(names), k)
    best = top_each(hits.filter(F.size("term") > 0).mapInArrow(score, f"q int, chunk_id {kind}, score double").withColumnRenamed("q", "query"), k)
    known = chunks.sparkSession.createDataFrame(list(enumerate(names)), f"q int, query {queries.schema['query'].dataType.simpleString()}")
    return best.withColumnRenamed("query", "q").join(F.broadcast(known), "q").select("query", "chunk_id", "place")


def top_each(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query, chunk_id, place) of the best k of each query; tasks keep k rows of a query before the exchange."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "chunk_id"))
    return scored.select("query", "chunk_id", place.alias("place")).filter(F.col("place") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(chunk_id, score): cosine to the query vector, in full."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding")
    return vectors.select("chunk_id", (_dot(v, q) / F.nullif(F.sqrt(_dot(v, v)) * F.lit(sum(x * x for x in query) ** 0.5), F.lit(0.0))).alias("score"))


def top(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best k with their places from 1; equal scores (to `digits` places) are ordered by id."""
    best = scored.orderBy(F.desc(F.round("score", digits)), "chunk_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", digits)), "chunk_id")))


def fuse(*lists: DataFrame, weight: int = RRF) -> DataFrame:
    """(chunk_id, score): sum of 1 / (60 + place) over the lists that a chunk is in."""
    every = lists[0].select("chunk_id", "place")
    for x in lists[1:]:
        every = every.union(x.select("chunk_id", "place"))
    return every.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (weight + F.col("place"))).alias("score"))


def search(chunks: DataFrame, vectors: DataFrame, query: list[str], vector: list[float], where: Column | None = None, k: int = 10) -> DataFrame:
    """Hybrid search: a hard filter, the top 50 of each list, fusion, the top k."""
    some = chunks if where is None else chunks.filter(where)
    near = vectors.join(some.select("chunk_id"), "chunk_id", "left_semi")
    return top(fuse(top(cosine(near, vector), 50), top(bm25(some, query), 50)), k, 12)


def evaluate(ranked: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(queries, hit_rate, mrr): ranked (query, chunk_id, place) against (query, expected substring, in any case)."""
    j = chunks.select("chunk_id", "text").join(small(written(ranked)), "chunk_id").join(wanted, "query").filter(F.contains(F.lower("text"), F.lower("expected")))
    first = j.groupBy("query").agg(F.min("place").alias("place"))
    every = wanted.select("query").join(first, "query", "left")
    return every.agg(F.count("*").alias("queries"), F.avg(F.col("place").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))
