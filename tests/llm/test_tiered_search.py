import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import tiered_search
from tidemark.llm.queries import op13_ranked_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """(item_id, rank, doc_id, score) for every item against every document."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c, length in counted:
            m = 100 - 75 + (75 * length * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_all_items(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(op13_ranked_search(spark, sf_dir)) == plain([tuple(r) for r in documents.select("doc_id", "text").collect()], items)


@pytest.fixture(scope="module")
def skewed():
    """Every document holds common words; a few hold rare ones, so their items are proven from the first tier."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join([*rng.choice(["the", "of", "and", "to"], 20), *rng.choice([f"word{j}" for j in range(60)], 12)])) for i in range(600)]
    docs = [(i, t + (" Zebra quagga okapi" if i % 40 == 0 else " zebra" if i % 97 == 0 else "")) for i, t in docs]
    return docs, [(0, "the zebra, QUAGGA okapi"), (1, "the of and"), (2, "word1 word2 word2 the"), (3, "nothing here"), (4, "zebra")]


@pytest.mark.parametrize("at_once", [50, 2_000_000])
def test_proofs_and_fall_through(spark, monkeypatch, skewed, at_once):
    monkeypatch.setattr(tiered_search, "_AT_ONCE", at_once)
    docs, items = skewed
    out = tiered_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")).cache()
    assert found(out) == plain(docs, items)
    tiers = {r["item_id"]: r["tiers"] for r in out.select("item_id", "tiers").distinct().collect()}
    assert tiers[0] == 1 and tiers[1] == tiered_search.TIERS and 3 not in tiers


def test_bounds_hold(spark, skewed):
    """No share below a tier is above its bound, and the tiers hold every posting of the terms once."""
    docs, _ = skewed
    names = sorted({t for _, text in docs for t in terms(text)})
    index = tiered_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), names)
    got = Counter()
    for row in index.rows.collect():
        for j in range(tiered_search.TIERS):
            for t, share in zip(row[f"ids{j}"], row[f"shares{j}"], strict=True):
                got[row["doc_id"], names[t]] += 1
                assert all(share <= index.below[i][t] for i in range(j))
    assert got == Counter((d, t) for d, text in docs for t in set(terms(text)))


def test_blocks_of_items(spark, monkeypatch, skewed):
    monkeypatch.setattr(tiered_search, "TERMS_PER_BLOCK", 3)
    docs, items = skewed
    out = tiered_search.ranked_search(spark.createDataFrame(docs[:50], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(out) == plain(docs[:50], items)


def test_odd_rows(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(tiered_search, "_PIECE", 1000)
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "mail LONG 漢字 ß one"), (1, "mail LONG 漢字 ß one"), (None, "ñ 1 É word " * 3000), (2, None), (3, ""), (4, "?!"), (5, "long long " + "1" * 40_000)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("_q", "_terms", "item", "doc_id", "rank", "score", "r")})
    assert found(tiered_search.ranked_search(odd_docs, asked)) == plain(docs, items)
    assert tiered_search.ranked_search(no_docs, asked).count() == 0
    assert tiered_search.ranked_search(odd_docs, asked.filter("false")).count() == 0
    assert tiered_search.ranked_search(odd_docs.filter("doc_id < 4"), asked).count() == 0
    ties = spark.createDataFrame([(i, "same text") for i in (9, 7, None, 8, 7)], "doc_id long, text string")
    assert [tuple(r) for r in tiered_search.ranked_search(ties.union(spark.createDataFrame([(i, "other") for i in range(20)], ties.schema)), asked.limit(1).withColumn("text", F.lit("same"))).orderBy("rank").select("rank", "doc_id").collect()] == [(1, None), (2, 7), (3, 7), (4, 8), (5, 9)]
