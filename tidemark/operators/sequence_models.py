"""Sequence classifiers, a recurrent and an attention network, trained by synchronous data-parallel gradient descent.

Every step is one Spark job for all folds and networks: tasks run forward and backward passes over their rows of the step's batch
and add up gradients, the shuffle brings a slice of a network's gradients from all tasks together, where they are added as they
stream by, and the driver takes an AdamW step. A row's batch and dropout follow from a hash of row, epoch and place, so a task
that runs again gives the same sums. Losses of the held-back tail come along in the first job of the epoch after.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.boosting import mixed
from tidemark.storage import written

HIDDEN, HEADS, LENGTH = 48, 4, 20
KINDS = ("lstm", "transformer")
#: Sequences of a fold that a network asks for, to learn from and to be tested on, and beside a held-back tail.
LEAST_TRAIN, LEAST_TEST, LEAST_FIT = 120, 20, 32
SLICE = 4096
ROWS_PER_TASK = 2_000


class Settings(NamedTuple):
    epochs: int = 60
    patience: int = 8
    steps: int = 4  # batches of an epoch
    rate: float = 4e-3  # for batches of a quarter of the rows
    decay: float = 1e-4
    clip: float = 1.0
    dropout: float = 0.3
    tail: float = 0.2
    seed: int = 42


Params = dict[str, np.ndarray]


def initial(kind: str, features: int, seed: int, length: int = LENGTH) -> Params:
    rng, h = np.random.default_rng(seed), HIDDEN
    u = lambda scale, *shape: rng.uniform(-scale, scale, shape)
    norm = lambda name: {f"{name}.g": np.ones(h), f"{name}.b": np.zeros(h)}
    head = {"head.w": u(h**-0.5, h), "head.b": u(h**-0.5, 1)}
    if kind == "lstm":
        return {"x": u(h**-0.5, features, 4 * h), "h": u(h**-0.5, h, 4 * h), "b": u(h**-0.5, 4 * h), **norm("n"), **head}
    wide = 2 * h
    return {
        "in.w": u(features**-0.5, features, h), "in.b": u(features**-0.5, h), "pos": np.zeros((length, h)), **norm("n1"),
        "qkv.w": u((6 / (4 * h)) ** 0.5, h, 3 * h), "qkv.b": np.zeros(3 * h), "out.w": u(h**-0.5, h, h), "out.b": np.zeros(h), **norm("n2"),
        "up.w": u(h**-0.5, h, wide), "up.b": u(h**-0.5, wide), "down.w": u(wide**-0.5, wide, h), "down.b": u(wide**-0.5, h), **norm("n"), **head,
    }


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(x: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _mask(key: np.ndarray | None, site: int, shape: tuple, rate: float) -> np.ndarray | float:
    """Dropout: 0 or 1 / (1 - rate) for each element, by the hashes of the rows; 1 where no rows are given."""
    if key is None or not rate:
        return 1.0
    n = int(np.prod(shape[1:]))
    with np.errstate(over="ignore"):
        h = mixed(mixed(key.astype(np.uint64) + np.uint64(site * 0x9E37))[:, None] ^ np.arange(n, dtype=np.uint64)[None, :])
    return ((h >= np.uint64(rate * 2**64)) / (1 - rate)).reshape(shape)


def _norm(x: np.ndarray, p: Params, name: str):
    mean = x.mean(axis=-1, keepdims=True)
    scale = 1 / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    z = (x - mean) * scale
    return z * p[f"{name}.g"] + p[f"{name}.b"], (z, scale)


def _norm_back(d: np.ndarray, held, p: Params, name: str, g: Params) -> np.ndarray:
    z, scale = held
    axes = tuple(range(d.ndim - 1))
    g[f"{name}.g"], g[f"{name}.b"] = (d * z).sum(axis=axes), d.sum(axis=axes)
    e = d * p[f"{name}.g"]
    return scale * (e - e.mean(axis=-1, keepdims=True) - z * (e * z).mean(axis=-1, keepdims=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(p: Params, x: np.ndarray, key, rate: float):
    """(logits, backward): backward takes the logits' slopes to the parameters'."""
    n, steps, _ = x.shape
    h, c, held, size = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), [], HIDDEN
    for t in range(steps):
        a = x[:, t] @ p["x"] + h @ p["h"] + p["b"]
        i, f, o = _sigmoid(a[:, :size]), _sigmoid(a[:, size : 2 * size]), _sigmoid(a[:, 3 * size :])
        u = np.tanh(a[:, 2 * size : 3 * size])
        new = f * c + i * u
        held.append((h, c, i, f, u, o, np.tanh(new)))
        h, c = o * held[-1][-1], new
    z, norm = _norm(h, p, "n")
    drop = _mask(key, 1, z.shape, rate)

    def backward(d: np.ndarray) -> Params:
        g = {"head.w": (z * drop).T @ d, "head.b": d.sum(keepdims=True), "x": np.zeros_like(p["x"]), "h": np.zeros_like(p["h"]), "b": np.zeros_like(p["b"])}
        dh, dc = _norm_back(np.outer(d, p["head.w"]) * drop, norm, p, "n", g), np.zeros((n, HIDDEN))
        for t in range(steps - 1, -1, -1):
            before, c_before, i, f, u, o, tc = held[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * u * i * (1 - i), dc * c_before * f * (1 - f), dc * i * (1 - u * u), dh * tc * o * (1 - o)], axis=1)
            g["x"] += x[:, t].T @ da
            g["h"] += before.T @ da
            g["b"] += da.sum(axis=0)
            dh, dc = da @ p["h"].T, dc * f
        return g

    return (z * drop) @ p["head.w"] + p["head.b"][0], backward


def _transformer(p: Params, x: np.ndarray, key, rate: float):
    """One pre-normalised encoder layer and the mean over time; see _lstm."""
    n, steps, _ = x.shape
    h, each = HIDDEN, HIDDEN // HEADS
    h0 = x @ p["in.w"] + p["in.b"] + p["pos"][:steps]
    a, norm1 = _norm(h0, p, "n1")
    qkv = (a @ p["qkv.w"] + p["qkv.b"]).reshape(n, steps, 3, HEADS, each).transpose(2, 0, 3, 1, 4)
    q, k, v = qkv
    s = q @ k.transpose(0, 1, 3, 2) / each**0.5
    s = np.exp(s - s.max(axis=-1, keepdims=True))
    w = s / s.sum(axis=-1, keepdims=True)
    drop_w = _mask(key, 2, w.shape, rate)
    mix = ((w * drop_w) @ v).transpose(0, 2, 1, 3).reshape(n, steps, h)
    drop_a = _mask(key, 3, mix.shape, rate)
    h1 = h0 + (mix @ p["out.w"] + p["out.b"]) * drop_a
    b, norm2 = _norm(h1, p, "n2")
    up = b @ p["up.w"] + p["up.b"]
    drop_u = _mask(key, 4, up.shape, rate)
    act = np.maximum(up, 0) * drop_u
    drop_d = _mask(key, 5, h1.shape, rate)
    h2 = h1 + (act @ p["down.w"] + p["down.b"]) * drop_d
    z, norm = _norm(h2.mean(axis=1), p, "n")
    drop = _mask(key, 1, z.shape, rate)

    def backward(d: np.ndarray) -> Params:
        g = {"head.w": (z * drop).T @ d, "head.b": d.sum(keepdims=True)}
        rows = lambda e: e.reshape(-1, e.shape[-1])
        dz = _norm_back(np.outer(d, p["head.w"]) * drop, norm, p, "n", g)
        d2 = np.repeat(dz[:, None, :] / steps, steps, axis=1)
        e = d2 * drop_d
        g["down.w"], g["down.b"] = rows(act).T @ rows(e), rows(e).sum(axis=0)
        e = e @ p["down.w"].T * drop_u * (up > 0)
        g["up.w"], g["up.b"] = rows(b).T @ rows(e), rows(e).sum(axis=0)
        d1 = d2 + _norm_back(e @ p["up.w"].T, norm2, p, "n2", g)
        e = d1 * drop_a
        g["out.w"], g["out.b"] = rows(mix).T @ rows(e), rows(e).sum(axis=0)
        e = (e @ p["out.w"].T).reshape(n, steps, HEADS, each).transpose(0, 2, 1, 3)
        dv = (w * drop_w).transpose(0, 1, 3, 2) @ e
        dw = e @ v.transpose(0, 1, 3, 2) * drop_w
        ds = w * (dw - (dw * w).sum(axis=-1, keepdims=True)) / each**0.5
        dq, dk = ds @ k, ds.transpose(0, 1, 3, 2) @ q
        e = np.stack([dq, dk, dv]).transpose(1, 3, 0, 2, 4).reshape(n, steps, 3 * h)
        g["qkv.w"], g["qkv.b"] = rows(a).T @ rows(e), rows(e).sum(axis=0)
        d0 = d1 + _norm_back(e @ p["qkv.w"].T, norm1, p, "n1", g)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:steps] = d0.sum(axis=0)
        g["in.w"], g["in.b"] = rows(x).T @ rows(d0), rows(d0).sum(axis=0)
        return g

    return (z * drop) @ p["head.w"] + p["head.b"][0], backward


NETWORKS = {"lstm": _lstm, "transformer": _transformer}


def losses(logits: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    """Logistic loss of each row; positive rows count `weight` times."""
    return np.where(y > 0, weight, 1.0) * np.logaddexp(0, np.where(y > 0, -logits, logits))


def _slopes(logits: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    return np.where(y > 0, weight, 1.0) * (_sigmoid(logits) - y)


class Step(NamedTuple):
    """What tasks need for one job: parameters and class weights of each (fold, kind), the place of the batch, rows of the tail or not."""

    params: dict[tuple[int, str], Params]
    weights: dict[int, float]
    epoch: int
    batch: int
    settings: Settings


_SUMS = "fold int, kind string, part string, slice int, total array<double>"


def _passes(of: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over this task's rows: for `fit` (rows, loss, gradients), for `tail` (rows, loss), as slices."""
        step, total = of.value, {}
        s = step.settings
        for batch in batches:
            fold, key, y, tail, x = _tensors(batch)
            with np.errstate(over="ignore"):
                salt = mixed(key.astype(np.uint64) ^ np.uint64(s.seed * 10_007 + step.epoch))
            for (f, kind), p in step.params.items():
                own = (fold == f) & ~tail & (salt % np.uint64(s.steps) == np.uint64(step.batch))
                if own.any():
                    logits, backward = NETWORKS[kind](p, x[own], salt[own], s.dropout)
                    sums = np.concatenate([[own.sum(), losses(logits, y[own], step.weights[f]).sum()], flat(backward(_slopes(logits, y[own], step.weights[f])))])
                    total[f, kind, "fit"] = total.get((f, kind, "fit"), 0) + sums
                own = (fold == f) & tail
                if step.batch == 0 and own.any():
                    logits, _ = NETWORKS[kind](p, x[own], None, 0.0)
                    total[f, kind, "tail"] = total.get((f, kind, "tail"), 0) + np.array([own.sum(), losses(logits, y[own], step.weights[f]).sum()])
        yield from _slices(total)

    return run


def _slices(total: dict) -> Iterator[pa.RecordBatch]:
    for (f, kind, part), sums in total.items():
        cut = [sums[i : i + SLICE] for i in range(0, len(sums), SLICE)]
        n = len(cut)
        yield pa.RecordBatch.from_arrays([pa.array([f] * n, pa.int32()), pa.array([kind] * n), pa.array([part] * n), pa.array(range(n), pa.int32()), pa.array(cut, pa.list_(pa.float64()))], names=["fold", "kind", "part", "slice", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds slices up as they stream by."""
    total: dict = {}
    for batch in batches:
        for f, kind, part, i, x in zip(*[batch.column(c).to_pylist() for c in ("fold", "kind", "part", "slice")], batch.column("total"), strict=True):
            x = x.values.to_numpy()
            total[f, kind, part, i] = total[f, kind, part, i] + x if (f, kind, part, i) in total else x
    for (f, kind, part, i), x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([kind]), pa.array([part]), pa.array([i], pa.int32()), pa.array([x], pa.list_(pa.float64()))], names=["fold", "kind", "part", "slice", "total"])


def _tensors(batch: pa.RecordBatch):
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
    steps = batch.column("steps")[0].as_py() if batch.num_rows else 1
    x = x.reshape(batch.num_rows, steps, -1) if batch.num_rows else np.zeros((0, 1, 1))
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return get("fold"), get("key"), get("label"), get("tail").astype(bool), x


def standardised(samples: DataFrame, features: int, tail: float = Settings().tail) -> DataFrame:
    """(fold, train, ticker, date, fwd_return, key, label, tail, steps, x): sequences in units of their fold's training values, over
    samples and time together, as flat arrays. tail marks the latest share of the training samples, whole dates, if LEAST_FIT are left.
    """
    step = samples.filter("train").select("fold", F.explode("sequence").alias("v"))
    stats = step.groupBy("fold").agg(F.array(*[F.avg(F.col("v")[i].cast("double")) for i in range(features)]).alias("m"), F.array(*[F.stddev_pop(F.col("v")[i].cast("double")) for i in range(features)]).alias("s"))
    dates = samples.filter("train").groupBy("fold", "date").agg(F.count("*").alias("n"))
    by = Window.partitionBy("fold")  # a row a date
    after = F.sum("n").over(by.orderBy(F.desc("date")))
    dates = dates.select("fold", "date", ((after <= F.floor(F.sum("n").over(by) * tail)) & (F.sum("n").over(by) * (1 - tail) >= LEAST_FIT)).alias("late"))
    cut = dates.filter("late").groupBy("fold").agg(F.min("date").alias("cut"))
    own = samples.join(F.broadcast(stats), "fold").join(F.broadcast(cut), "fold", "left")  # a row a fold
    scaled = F.flatten(F.transform("sequence", lambda v: F.transform(v, lambda x, i: (x.cast("double") - F.get("m", i)) / F.when(F.get("s", i) > 0, F.get("s", i)).otherwise(1.0))))
    late = F.col("train") & F.coalesce(F.col("date") >= F.col("cut"), F.lit(False))
    return own.select("fold", "train", "ticker", "date", "fwd_return", F.xxhash64("ticker", "date").alias("key"), (F.col("fwd_return") > 0).cast("double").alias("label"), late.alias("tail"), F.size("sequence").alias("steps"), scaled.alias("x"))


def clipped(g: np.ndarray, most: float) -> np.ndarray:
    size = float(np.sqrt(g @ g))
    return g * (most / (size + 1e-6)) if size > most else g


def fit(rows: DataFrame, features: int, kinds: tuple[str, ...] = KINDS, s: Settings = Settings()) -> tuple[dict, list[dict]]:  # noqa: B008
    """({(fold, kind): parameters}, history) from the training rows of standardised().

    Training of a network ends after `patience` epochs without a lower loss on its tail (on the rows learned from, where there
    is no tail); the best epoch's parameters are given back.
    """
    rows = written(rows.filter("train").select("fold", "key", "label", "tail", "steps", "x").repartition(max(1, rows.count() // ROWS_PER_TASK)))
    shape = rows.groupBy("fold").agg(F.count_if("tail").alias("late"), F.avg(F.when(~F.col("tail"), F.col("label"))).alias("rate"), F.max("steps").alias("steps")).collect()
    weights = {r["fold"]: (1 - r["rate"]) / r["rate"] if 0 < (r["rate"] or 0) < 1 else 1.0 for r in shape}
    has_tail = {r["fold"]: r["late"] > 0 for r in shape}
    like = {k: initial(k, features, 0, max((r["steps"] for r in shape), default=LENGTH)) for k in kinds}
    now = {(r["fold"], k): flat(initial(k, features, s.seed + r["fold"], r["steps"])) for r in shape for k in kinds}
    best = {m: (np.inf, p, 0) for m, p in now.items()}
    first, second, taken = {m: 0.0 for m in now}, {m: 0.0 for m in now}, dict.fromkeys(now, 0)
    active, history = set(now), []
    context = rows.sparkSession.sparkContext
    for epoch in range(s.epochs + 1):
        learned = {m: [0.0, 0.0] for m in active}
        for batch in range(s.steps):
            step = Step({m: shaped(now[m], like[m[1]]) for m in sorted(active)}, weights, epoch, batch, s)
            held = context.broadcast(step)
            found = rows.mapInArrow(_passes(held), _SUMS).repartition("fold", "kind", "part", "slice").mapInArrow(_added, _SUMS).orderBy("slice").collect()  # a network's size
            held.unpersist()
            sums: dict = {}
            for r in found:
                sums.setdefault((r["fold"], r["kind"], r["part"]), []).append(np.array(r["total"]))
            if batch == 0 and epoch:  # the loss of the epoch before, on the tail
                for m in sorted(active):
                    loss = before[m]
                    if has_tail[m[0]]:
                        n, total = sums[*m, "tail"][0]
                        loss = total / n
                    history.append({"fold": m[0], "kind": m[1], "epoch": epoch - 1, "train_loss": before[m], "val_loss": loss})
                    worse = best[m][2] + 1
                    best[m] = (loss, now[m], 0) if loss < best[m][0] - 1e-5 else (best[m][0], best[m][1], worse)
                    if best[m][2] >= s.patience:
                        active.discard(m)
            if not active or epoch == s.epochs:
                break
            for m in active:
                if (*m, "fit") not in sums:
                    continue
                total = np.concatenate(sums[*m, "fit"])
                learned[m][0] += total[0]
                learned[m][1] += total[1]
                g = clipped(total[2:] / total[0], s.clip)
                taken[m] += 1
                first[m], second[m] = 0.9 * first[m] + 0.1 * g, 0.999 * second[m] + 0.001 * g * g
                move = first[m] / (1 - 0.9 ** taken[m]) / (np.sqrt(second[m] / (1 - 0.999 ** taken[m])) + 1e-8)
                now[m] = now[m] * (1 - s.rate * s.decay) - s.rate * move
        if not active:
            break
        before = {m: learned[m][1] / max(1.0, learned[m][0]) for m in active}
    return {m: shaped(p, like[m[1]]) for m, (_, p, _) in best.items()}, history


def scores(rows: DataFrame, params: dict[tuple[int, str], Params]) -> DataFrame:
    """(fold, ticker, date, model, score, fwd_return) of rows of standardised() under each network of their fold."""
    held = rows.sparkSession.sparkContext.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, _, _, _, x = _tensors(batch)
            for (f, kind), p in held.value.items():
                own = np.flatnonzero(fold == f)
                if len(own):
                    logits, _ = NETWORKS[kind](p, x[own], None, 0.0)
                    part = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([part.column("fold"), part.column("ticker"), part.column("date"), pa.array([kind] * len(own)), pa.array(_sigmoid(logits)), part.column("fwd_return")], names=["fold", "ticker", "date", "model", "score", "fwd_return"])

    return rows.mapInArrow(score, "fold int, ticker string, date date, model string, score double, fwd_return double")


def samples_in_folds(rows: DataFrame, table: DataFrame, sequences: DataFrame) -> DataFrame:
    """(fold, train, ticker, date, fwd_return, sequence): the sequences that end on the prepared rows (placed, with `at`) of each fold.
    Sequences reach back over the whole history before their end. Folds with too few are left out.
    """
    test = (F.col("at") >= F.col("test_start")) & (F.col("at") < F.col("test_end"))
    train = F.col("at") < F.col("train_end")
    ends = rows.join(F.broadcast(table), train | test).select("fold", train.alias("train"), "ticker", "date", "fwd_return")  # a handful of folds
    out = written(ends.join(sequences, ["ticker", "date"]))
    good = out.groupBy("fold").agg(F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("m")).filter(f"n >= {LEAST_TRAIN} AND m >= {LEAST_TEST}")
    return out.join(F.broadcast(good.select("fold")), "fold", "left_semi")
