"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over chunks of WIDTH bytes that overlap by half and cover the whole document;
each filter's largest response is kept, and one linear layer turns these into a probability. Training takes a bounded
sample of labelled documents on the driver; scoring runs in the tasks, over whole texts in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

STEP = 16
WIDTH = 2 * STEP
EMBED, FILTERS = 6, 32
#: The sample that is learned from: at most so many labelled documents, of so many bytes together.
TRAIN_ROWS, TRAIN_TOTAL = 4000, 64 << 20
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 11
#: Bytes that are convolved at once.
SLAB = 1 << 20
_PAD = 256


@dataclass(frozen=True)
class Network:
    embedding: np.ndarray  # 257 x EMBED; the last row, of the padding, is 0
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def responses(self, blocks: np.ndarray) -> np.ndarray:
        """Of each two neighbouring blocks (n x STEP bytes): n - 1 x FILTERS. A chunk is the two blocks together."""
        x = self.embedding[blocks].reshape(len(blocks), -1)
        half = STEP * EMBED
        y = x @ np.concatenate([self.filters[:half], self.filters[half:]], axis=1)
        return y[:-1, :FILTERS] + y[1:, FILTERS:]


def blocks_of(text: bytes) -> np.ndarray:
    """The document in blocks of STEP bytes, two at least, with padding at the end."""
    n = max(2, -(-len(text) // STEP))
    out = np.full(n * STEP, _PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, STEP)


def _slabs(texts: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(numbers, pieces): the documents' blocks in lists of about SLAB bytes. Documents share lists, and long ones are cut
    into pieces that share a block, so that no chunk is lost.
    """
    numbers, pieces, size, per = [], [], 0, SLAB // STEP
    for i, b in enumerate(texts):
        for s in range(0, len(b) - 1, per - 1):
            numbers.append(i)
            pieces.append(b[s : s + per])
            size += pieces[-1].size
            if size >= SLAB:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
    if pieces:
        yield numbers, pieces


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """len(texts) x FILTERS largest responses."""
    best = np.full((len(texts), FILTERS), -np.inf, np.float32)
    for numbers, pieces in _slabs(list(map(blocks_of, texts))):
        y = net.responses(np.concatenate(pieces))
        first = np.concatenate([[0], np.cumsum([len(b) for b in pieces])[:-1]])
        # The response between two documents stands before each next start and is left out.
        edges = np.stack([first, first + [len(b) - 1 for b in pieces]], axis=1).ravel()
        top = np.maximum.reduceat(np.concatenate([y, y[:1]]), edges)[::2]
        for i, t in zip(numbers, top, strict=True):
            np.maximum(best[i], t, out=best[i])
    return best


def _winners(net: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest responses as in pooled(), and the chunks that gave them: len(texts) x FILTERS x WIDTH bytes."""
    best = np.full((len(texts), FILTERS), -np.inf, np.float32)
    won = np.full((len(texts), FILTERS, WIDTH), _PAD, np.int16)
    for numbers, pieces in _slabs(texts):
        y, a = net.responses(np.concatenate(pieces)), 0
        for i, b in zip(numbers, pieces, strict=True):
            at = y[a : a + len(b) - 1].argmax(axis=0)
            top = y[a + at, np.arange(FILTERS)]
            new = top > best[i]
            best[i][new] = top[new]
            won[i][new] = np.concatenate([b[at[new]], b[at[new] + 1]], axis=1)
            a += len(b)
    return best, won


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    z = np.maximum(pooled(net, texts) + net.bias, 0) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-z.astype(float)))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> Network:
    """Log loss by Adam. Only the chunk that wins a filter's pool passes its gradient on to filter and embedding."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels, np.float32)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    p = {
        "embedding": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "out_bias": np.array(np.log(rate / (1 - rate)), np.float32),
    }
    p["embedding"][_PAD] = 0
    if len(set(labels)) < 2:  # nothing to tell apart: every document gets the rate of its only class
        p["out"][:] = 0
        return Network(**p)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    blocks = [blocks_of(t) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            ids = order[s : s + BATCH]
            top, chunk = _winners(Network(**p), [blocks[i] for i in ids])
            top = top + p["bias"]
            act = np.maximum(top, 0)
            dz = (1 / (1 + np.exp(-(act @ p["out"] + p["out_bias"]))) - y[ids]) / len(ids)
            dtop = np.where(top > 0, dz[:, None] * p["out"], 0).astype(np.float32)
            x = p["embedding"][chunk].reshape(len(ids), FILTERS, -1)
            dx = (dtop[:, :, None] * p["filters"].T).reshape(-1, EMBED)
            flat = chunk.ravel()
            g = {
                "embedding": np.stack([np.bincount(flat, dx[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32),
                "filters": np.einsum("bk,bki->ik", dtop, x),
                "bias": dtop.sum(axis=0),
                "out": act.T @ dz,
                "out_bias": dz.sum(),
            }
            g["embedding"][_PAD] = 0
            step += 1
            for k, (m, v) in moments.items():
                m *= 0.9
                m += 0.1 * g[k]
                v *= 0.999
                v += 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(**{k: v.astype(np.float32) for k, v in p.items()})


def sample(docs: DataFrame, labels: DataFrame, training: Column, text: str, label: str, rows: int, total: int) -> list[tuple]:
    """(doc_id, label, text): the labelled documents with the least id hashes, as many as the two bounds allow.

    The bytes bound ends the sample where the next document would pass it; a long document is never passed over for its
    size while others are taken after it. One document is taken at least. Texts are read once the sample is known.
    """
    some = labels.filter(training & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", text_of(text).cast("binary").alias("_t")).join(F.broadcast(some), "doc_id").withColumn("_h", F.xxhash64("_t"))  # at most `rows` narrow rows
    # Rows that repeat id, text and label count once, however many they are.
    listed = found.select("doc_id", "_h", "_y", F.octet_length("_t").alias("_n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h", "_y").limit(rows).collect()
    size = np.cumsum([r._n for r in listed])
    taken = {(r.doc_id, r._h) for r in listed[: max(1, int(np.searchsorted(size, total, side="right")))]}
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(taken), f"doc_id {kind}, _h long")
    got = found.join(F.broadcast(wanted), ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h", "_y"]).select("doc_id", "_y", "_t").collect()
    return sorted((r.doc_id, r._y, bytes(r._t)) for r in got)


def fit(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, total: int = TRAIN_TOTAL) -> Network:
    """Learns from at most `rows` labelled rows, of `total` bytes together, for which `training` (of doc_id) holds.

    All chunks of these documents are learned from. Labels other than 0 and 1 and null ids are passed over.
    """
    got = sample(docs, labels, training, text, label, rows, total)
    return train([t for _, _, t in got], [y for _, y, _ in got])


def _scorer(net: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(net, batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", label: str = "quality") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (probability of label 1), predicted.

    `training` says, from doc_id alone, which rows may be learned from; the others, and null ids, are held out. Null texts
    are empty; they get a score like all others. Without labels of both classes every score is the rate of label 1, or one
    half without any. Repeated rows stay; an empty table gives an empty one.
    """
    net = fit(docs, labels, training, text, label)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (~F.coalesce(training, F.lit(False))).alias("held_out"), text_of(text).cast("binary").alias("t"))
    return rows.mapInArrow(_scorer(net), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
