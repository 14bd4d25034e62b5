import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.queries import op12_merkle, tampered

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return sha256(text.encode()).hexdigest()


def climb(level):
    """All levels of a tree, and for each leaf the digests left and right of its path."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    sides = []
    for i in range(len(level)):
        path = []
        for row in levels[:-1]:
            first = i - i % 3
            path.append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
            i //= 3
        sides.append(path)
    return levels[-1][0], sides


def plain(rows):
    def leaf(values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for r in rows:
        other = r[4]
        if other is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            other = other.replace("\n", "")
        groups[r[1]].append((r[0], leaf(r), leaf((*r[:4], other))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1], strict=True):
            fold = x[2]
            for l, r in path + top:
                fold = h(l + fold + r)
            out.append((x[0], x[1], trees[s][0], root, h("".join(l + r for l, r in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def spark_rows(docs):
    return sorted(map(tuple, merkle.verify(merkle.leaves_of(docs, COLUMNS, "source", "doc_id", tampered(docs))).collect()), key=repr)


def test_documents(spark, sf_dir, documents):
    got = sorted(map(tuple, op12_merkle(spark, sf_dir).collect()), key=repr)
    assert got == plain([tuple(r) for r in documents.select(COLUMNS).collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize(("chunk", "parts"), [(1, 7), (2, 1), (8, 7)])
def test_trees_of_all_sizes(spark, monkeypatch, chunk, parts):
    """Stretches that begin anywhere, short last runs, trees below, at and above a chunk, and merging in several rounds."""
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    monkeypatch.setattr(merkle, "LEAST_PER_PART", 1)
    monkeypatch.setattr(merkle, "ROUND", 1)
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 400 // parts)
    rows = [(i, f"s{size}", "en", i % 5, f"line {i}\nend" if i % 3 else f"line {i}") for size in (1, 2, 3, 4, 8, 9, 10, 27, 28, 81, 100, 244) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_rows(docs) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select(COLUMNS).collect()]
    assert spark_rows(odd_docs) == plain(rows)
    assert merkle.verify(merkle.leaves_of(no_docs, COLUMNS, "source", "doc_id")).count() == 0
    lone = odd_docs.filter("doc_id = 1")
    assert spark_rows(lone) == plain([(1, "a", "en", 0, None)]) and spark_rows(lone)[0][4] == h("")


def test_records_are_the_whole_tree(spark):
    leaves = spark.range(100).select(F.lit("=a").alias("_s"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("_leaf"))
    nodes = merkle.build(leaves, ["k"]).nodes
    sizes = {r["_level"]: r["count"] for r in nodes.groupBy("_level").count().collect()}
    assert sizes == {1: 34, 2: 12, 3: 4, 4: 2, 5: 1} and nodes.distinct().count() == 53
