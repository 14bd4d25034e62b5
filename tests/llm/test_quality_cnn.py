import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_cnn as q


def training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score_quality(docs.join(labels.select("doc_id"), "doc_id"), labels, training()).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert len(rows) > 40 and right > 0.95 and (good[:, None] > bad).mean() > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_whole_text_counts(spark):
    net = q.train([b"good words here " * 20] * 8 + [b"good words here " * 19 + b"#### $$$$ %%%% &&"] * 8, [1] * 8 + [0] * 8, epochs=60)
    clean = b"good words here " * 90_000
    p = q.probabilities(net, [clean, clean + b"#### $$$$ %%%% &&", b"", b"good words here "])
    assert p[0] > 0.5 > p[1] and 0 <= p[2] <= 1


def test_pool_matches_direct_convolution():
    rng = np.random.default_rng(3)
    net = q.train([rng.bytes(n) for n in (5, 40, 900, 33)], [0, 1, 0, 1], epochs=1)
    texts = [rng.bytes(n) for n in (0, 1, 31, 32, 33, 500, q.SLAB + 77)]
    got = q.pooled(net, texts)
    for t, row in zip(texts, got, strict=True):
        b = q.blocks_of(t)
        x = np.concatenate([net.embedding[b[:-1]].reshape(len(b) - 1, -1), net.embedding[b[1:]].reshape(len(b) - 1, -1)], axis=1)
        assert np.allclose(row, (x @ net.filters).max(axis=0), atol=1e-4)


def test_winners_match_the_pool(monkeypatch):
    rng = np.random.default_rng(4)
    net = q.train([rng.bytes(n) for n in (5, 40, 900, 33)], [0, 1, 0, 1], epochs=1)
    monkeypatch.setattr(q, "SLAB", 160)
    texts = [rng.bytes(n) for n in (0, 31, 500, 33, 700)]
    best, won = q._winners(net, [q.blocks_of(t) for t in texts])
    assert np.array_equal(best, q.pooled(net, texts))
    for row, chunks in zip(best, won, strict=True):
        x = net.embedding[chunks].reshape(q.FILTERS, -1)
        assert np.allclose(row, (x * net.filters.T).sum(axis=1), atol=1e-4)


def test_long_documents_are_learned_from(spark):
    rows = [(i, "plain words " * 3000 + ("#### $$$$ &&&& " * 5 if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    got = q.sample(docs, labels, F.col("doc_id") < 30, "text", "quality", 20, 1 << 30)
    assert len(got) == 20 and all(len(t) > 30_000 for _, _, t in got)
    few = q.sample(docs, labels, F.col("doc_id") < 30, "text", "quality", 20, 120_000)
    assert set(few) < set(got) and sum(len(t) for _, _, t in few) <= 120_000 and len(few) == 3
    assert len(q.sample(docs, labels, F.col("doc_id") < 30, "text", "quality", 20, 5)) == 1


def test_columns_of_labels_that_clash(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = labels.withColumns({c: F.lit("clash") for c in ("text", "_y", "_t", "_h", "_n", "score", "held_out")})
    rows = lambda t: sorted(map(tuple, q.score_quality(documents, t, training()).collect()))
    assert rows(labels) == rows(odd)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, None), (5, 1, 0), (7, 1, 0), (None, 1, 1), (2, None, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    rows = q.score_quality(odd_docs, labels, training()).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert q.score_quality(no_docs, labels, training()).count() == 0
    assert {r.score for r in q.score_quality(odd_docs, labels.filter("false"), training()).collect()} == {0.5}
