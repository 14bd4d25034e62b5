"""Second-order gradient boosting on histograms, for all folds at once.

Features become bins by each fold's own quantiles. Every level of a tree is one aggregation over the folds' training rows:
tasks sum gradients and Hessians by (fold, node, feature, bin), the shuffle adds the tasks' sums up, and the driver, which
sees at most folds * nodes * features * bins cells, takes the best splits. Margins are stored every REFRESH trees; between these
tasks apply the newest trees. Row and column samples are hashes of row, tree and fold, so a task that runs again takes the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import written

REFRESH = 20
ROWS_PER_TASK = 100_000
#: Tasks that add up the cells of several tasks: cells are bounded, so these don't follow the shuffle partitions of the session.
ADDERS = 8


class Settings(NamedTuple):
    trees: int = 200
    depth: int = 3
    rate: float = 0.05
    ridge: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    least_hessian: float = 1.0
    bins: int = 256
    seed: int = 42


#: Gains of a split below this are none.
LEAST_GAIN = 1e-6


class Tree(NamedTuple):
    """A tree in level order: node i has the children 2i + 1 and 2i + 2; feature -1 marks leaves. Left are bins up to `bin`."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_rows(key: np.ndarray, fold: int, tree: int, s: Settings) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = mixed(np.array([s.seed * 1_000_003 + fold * 10_007 + tree]))
        return mixed(key.astype(np.uint64) ^ salt) < np.uint64(min(s.rows, 1 - 2**-52) * 2**64)


def sampled_columns(n: int, fold: int, tree: int, s: Settings) -> np.ndarray:
    """The max(1, share) features with the least hashes, in their order."""
    with np.errstate(over="ignore"):
        h = mixed(np.arange(n) * 7_919 + mixed(np.array([s.seed + fold * 10_007 + tree * 101])).astype(np.int64))
    return np.sort(np.argsort(h, kind="stable")[: max(1, int(n * s.columns))])


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node in which each row of bins (rows by features) ends."""
    node = np.zeros(len(bins), np.int64)
    for _ in range(int(np.log2(len(tree.feature) + 1))):
        f = tree.feature[node]
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > tree.bin[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def margins(trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for t in trees:
        out += t.value[leaf_of(t, bins)]
    return out


def bin_edges(train: DataFrame, features: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Ascending cuts for each fold and feature: values of its training rows at even ranks. A row's bin is the number of cuts up
    to its value. The quantile sketches are small whatever the rows.
    """
    at = [i / bins for i in range(1, bins)]
    cuts = train.groupBy("fold").agg(*[F.percentile_approx(F.col(f).cast("double"), at, 20_000).alias(f"_{i}") for i, f in enumerate(features)])
    return {r["fold"]: [np.unique(np.array(r[f"_{i}"] or [], float)) for i in range(len(features))] for r in cuts.collect()}  # a row a fold


def binned(rows: DataFrame, features: list[str], edges: dict[int, list[np.ndarray]], keep: list[str]) -> DataFrame:
    """keep, with `bins`: a byte or two for each feature, by the edges of the row's fold; rows of folds without edges go."""
    held = rows.sparkSession.sparkContext.broadcast(edges)
    kept = [f for f in rows.select(keep).schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            out = np.zeros((len(fold), len(features)), np.int16)
            known = np.isin(fold, list(held.value))
            for f, cuts in held.value.items():
                own = fold == f
                for i, c in enumerate(cuts):
                    out[own, i] = np.searchsorted(c, batch.column(f"_x{i}").to_numpy(zero_copy_only=False)[own], "right")
            table = [batch.column(c.name) for c in kept] + [_lists(out)]
            yield pa.RecordBatch.from_arrays(table, names=[*[c.name for c in kept], "bins"]).filter(pa.array(known))

    from pyspark.sql.types import ArrayType, ShortType, StructType

    shown = rows.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    return shown.mapInArrow(place, StructType([*kept]).add("bins", ArrayType(ShortType())))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.int64)


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> tuple[int, int, float]:
    """(feature, bin, gain) of the split with the greatest gain from sums by (feature, bin); the first of equals; (-1, 0, 0) for none."""
    gs, hs = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = gs - gl, hs - hl
    gain = np.where((hl >= s.least_hessian) & (hr >= s.least_hessian), gl**2 / (hl + s.ridge) + gr**2 / (hr + s.ridge) - gs**2 / (hs + s.ridge), 0.0)
    gain = np.round(gain, 9)  # tasks add in any order
    gain = gain[columns]
    i, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(columns[i]), int(b), float(gain[i, b])) if gain[i, b] > LEAST_GAIN else (-1, 0, 0.0)


def _summed(rows: DataFrame, fresh: dict[int, list[Tree]], growing: dict[int, Tree], level: int, tree: int, n: int, s: Settings, tasks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian sums (node of the level, feature, bin) of each fold over the tree's sampled rows. What one task sums is
    whole; the sums of several are added up by a shuffle.
    """
    first, nodes = 2**level - 1, 2**level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds, key = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            bins, y, margin = _matrix(batch, n), batch.column("label").to_numpy(zero_copy_only=False), batch.column("margin").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                f = int(fold)
                if f not in growing:
                    continue
                own = np.flatnonzero(folds == fold)
                own = own[sampled_rows(key[own], f, tree, s)]
                node = leaf_of(growing[f], bins[own]) - first
                own, node = own[node >= 0], node[node >= 0]  # rows of earlier leaves are done
                p = 1 / (1 + np.exp(-margin[own] - margins(fresh[f], bins[own])))
                cell = ((node[:, None] * n + np.arange(n)) * s.bins + bins[own]).ravel()
                out = total.setdefault(f, np.zeros((2, nodes * n * s.bins)))
                out[0] += np.bincount(cell, np.repeat(p - y[own], n), out.shape[1])
                out[1] += np.bincount(cell, np.repeat(p * (1 - p), n), out.shape[1])
        for f, out in total.items():
            used = np.flatnonzero(out[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), f), pa.int32()), pa.array(used, pa.int32()), pa.array(out[0][used]), pa.array(out[1][used])], names=["fold", "cell", "g", "h"])

    cells = rows.select("fold", "key", "label", "margin", "bins").mapInArrow(sums, "fold int, cell int, g double, h double")
    if tasks > 1:
        cells = cells.repartition(min(ADDERS, tasks), "fold", "cell").groupBy("fold", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found = {f: (np.zeros((nodes, n, s.bins)), np.zeros((nodes, n, s.bins))) for f in growing}
    for r in cells.toArrow().to_batches():
        fold, cell, g, h = (r.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "cell", "g", "h"))
        for f in found:
            own = fold == f
            found[f][0].ravel()[cell[own]], found[f][1].ravel()[cell[own]] = g[own], h[own]
    return found


def fit(train: DataFrame, features: list[str], edges: dict[int, list[np.ndarray]], s: Settings = Settings()) -> dict[int, list[Tree]]:  # noqa: B008
    """Boosted trees of each fold from rows (fold, key, label, features): key is a 64-bit hash that tells rows apart, label 0 or 1.

    Margins begin at 0. Rows that are equal, key included, are sampled together. A fold without rows has no trees.
    """
    n, folds = len(features), sorted(edges)
    size = 2 ** (s.depth + 1) - 1
    trees: dict[int, list[Tree]] = {f: [] for f in folds}
    fresh: dict[int, list[Tree]] = {f: [] for f in folds}
    rows = written(binned(train, features, edges, ["fold", "key", "label"]).withColumn("margin", F.lit(0.0)))
    tasks = max(1, rows.count() // ROWS_PER_TASK)  # few rows take one task a level, not one for each core
    rows = written(rows.repartition(tasks)).coalesce(tasks)
    for tree in range(s.trees):
        growing = {f: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for f in folds}
        columns = {f: sampled_columns(n, f, tree, s) for f in folds}
        open_ = {f: [0] for f in folds}
        for level in range(s.depth + 1):
            if level == 0:
                sums = _summed(rows, fresh, growing, 0, tree, n, s, tasks)
            else:
                sums = {f: below[f] for f in folds}
            first, below = 2**level - 1, {}
            splits = {}
            for f in folds:
                for i in open_[f]:
                    g, h = sums[f][0][i - first], sums[f][1][i - first]
                    growing[f].value[i] = -s.rate * g[0].sum() / (h[0].sum() + s.ridge)
                    if level < s.depth:
                        feature, cut, gain = best_split(g, h, columns[f], s)
                        if feature >= 0:
                            growing[f].feature[i], growing[f].bin[i], growing[f].gain[i] = feature, cut, gain
                            splits[f, i] = (feature, cut)
                open_[f] = [c for i in open_[f] if (f, i) in splits for c in (2 * i + 1, 2 * i + 2)]
            if level == s.depth or not splits:
                break
            if level + 1 < s.depth:
                below = _summed(rows, fresh, growing, level + 1, tree, n, s, tasks)
            else:  # the last level needs its nodes' sums only, which lie in the cells of the level before
                below = {f: _halves(sums[f], growing[f], first, n, s) for f in folds}
        for f in folds:
            trees[f].append(growing[f])
            fresh[f].append(growing[f])
        if (tree + 1) % REFRESH == 0 and tree + 1 < s.trees:
            rows = written(_moved(rows, fresh, n)).coalesce(tasks)
            fresh = {f: [] for f in folds}
    return trees


def _halves(sums: tuple[np.ndarray, np.ndarray], tree: Tree, first: int, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a split level's children in the first bin of the first feature, from the level's own cells."""
    nodes = sums[0].shape[0]
    out = tuple(np.zeros((2 * nodes, n, 1)) for _ in range(2))
    for i in range(nodes):
        f, b = tree.feature[first + i], tree.bin[first + i]
        if f >= 0:
            for x, y in zip(sums, out, strict=True):
                y[2 * i, 0, 0], y[2 * i + 1, 0, 0] = x[i, f, : b + 1].sum(), x[i, f, b + 1 :].sum()
    return out


def _moved(rows: DataFrame, fresh: dict[int, list[Tree]], n: int) -> DataFrame:
    """rows with the newest trees in their margins."""
    held = rows.sparkSession.sparkContext.broadcast(fresh)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, bins = batch.column("fold").to_numpy(zero_copy_only=False), _matrix(batch, n)
            margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
            for fold in np.unique(folds):
                own = folds == fold
                margin[own] += margins(held.value[int(fold)], bins[own])
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(move, rows.schema)


def predict(rows: DataFrame, features: list[str], edges: dict[int, list[np.ndarray]], trees: dict[int, list[Tree]], keep: list[str]) -> DataFrame:
    """keep, with the probability `score` of label 1 under the trees of the row's fold."""
    n = len(features)
    scored = _moved(binned(rows, features, edges, keep).withColumn("margin", F.lit(0.0)), trees, n)
    return scored.select(*keep, (1 / (1 + F.exp(-F.col("margin")))).alias("score"))


def importances(trees: dict[int, list[Tree]], features: list[str]) -> list[tuple[int, str, float, int]]:
    """(fold, feature, importance, splits): mean gain of a feature's splits as a share of the features' sum."""
    out = []
    for f, grown in sorted(trees.items()):
        gain, count = np.zeros(len(features)), np.zeros(len(features), np.int64)
        for t in grown:
            used = t.feature >= 0
            np.add.at(gain, t.feature[used], t.gain[used])
            np.add.at(count, t.feature[used], 1)
        mean = gain / np.maximum(count, 1)
        out += [(f, name, float(m / mean.sum()) if mean.sum() > 0 else 0.0, int(c)) for name, m, c in zip(features, mean, count, strict=True)]
    return out
