import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney as kn


def tokens(text):
    return [*text.encode().lower().split(), None]


class Brute:
    """The same model from plain dictionaries."""

    def __init__(self, texts):
        self.words, pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.pairs, self.total, self.context, self.low = pairs, Counter(), defaultdict(Counter), Counter()
        for (u, w), n in pairs.items():
            self.total[u] += n
            self.context[u][min(n, 3)] += 1
            self.low[w] += 1
        self.d = kn.discounts(*[sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)])
        self.dl = kn.discounts(*[sum(n == i for n in self.low.values()) for i in (1, 2, 3, 4)])
        self.low_total, self.low_by = sum(self.low.values()), Counter(min(n, 3) for n in self.low.values())

    def p(self, u, w):
        total, low = self.low_total, self.low_by
        g1 = sum(self.dl[i - 1] * low[i] for i in (1, 2, 3)) / total
        n = self.low[w]
        p1 = max(n - (self.dl[min(n, 3) - 1] if n else 0), 0) / total + g1 / (len(self.words) + 1)
        if not self.total[u]:
            return p1
        n = self.pairs[u, w]
        gamma = sum(self.d[i - 1] * self.context[u][i] for i in (1, 2, 3)) / self.total[u]
        return max(n - (self.d[min(n, 3) - 1] if n else 0), 0) / self.total[u] + gamma * p1

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True))


def test_scores_match_dictionaries(documents, texts):
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = kn.score_texts(documents, training).collect()
    used = {d: t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2}
    b = Brute(used.values())
    n, v = sum(b.words.values()), len(b.words)
    assert len(rows) == len(texts) and {r.doc_id for r in rows if not r.held_out} == set(used)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in b.words for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((b.words[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(b.score(texts[r.doc_id]))


def test_pair_keys_are_one_to_one():
    rng = np.random.default_rng(5)
    for bits, shard_bits in ((32, 4), (33, 3), (33, 6), (40, 17), (42, 25)):
        keys = kn.PairKeys(bits, shard_bits)
        before, word = (rng.integers(0, 1 << bits, 4000) for _ in range(2))
        before[:2000] = before[0]
        shard, key = keys.split(before, word)
        assert shard.min() >= 0 and shard.max() < 1 << shard_bits
        assert len(np.unique(shard)) > min(1 << shard_bits, 4000) / 3  # one context's pairs are in many shards
        for s in np.unique(shard)[:50]:
            b, w = keys.joined(int(s), key[shard == s])
            assert np.array_equal(b, before[shard == s]) and np.array_equal(w, word[shard == s])


def test_wider_numbers_give_the_same_scores(spark, monkeypatch):
    """The way that is taken beyond 2^32 words, several shards in a task, and shards that aren't mapped."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 30))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = [kn.token_hashes(t.encode()) for _, t in rows]
    want = kn._scores(kn.Arrays(kn.train(df)), docs)
    monkeypatch.setattr(kn, "PARTITIONS", 4)
    wide = kn.train(df, number_bits=35)
    assert wide.pairs == kn.PairKeys(35, 7)
    for a, b in zip(want, kn._scores(kn.Arrays(wide), docs), strict=True):
        assert np.allclose(a, b)
    unmapped = kn.Arrays(kn.replace(wide, uri="tested" + wide.uri), held_bytes=2000, maps=9)
    monkeypatch.setattr(kn, "_fs", lambda uri: __import__("pyarrow.fs").fs.FileSystem.from_uri(uri.removeprefix("tested")))
    for a, b in zip(want, kn._scores(unmapped, docs), strict=True):
        assert np.allclose(a, b)
    assert len(unmapped.maps) <= 9 and (unmapped.bytes <= 2000 or len(unmapped.maps) == 1)


def test_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 30))) for i in range(40)]
    stored = kn.train(spark.createDataFrame(rows, "doc_id long, text string"))
    m = kn.Arrays(stored)
    for before in (-1, 0, 3, stored.n_words):
        words = np.arange(-1, stored.n_words)
        assert m.probabilities(np.full(len(words), before), words).sum() == pytest.approx(1)


def test_odd_rows(odd_docs, no_docs):
    rows = kn.score_texts(odd_docs, F.col("doc_id") > 4).collect()
    assert len(rows) == 11 and all(r.held_out for r in rows if r.doc_id is None or r.doc_id < 5)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert kn.score_texts(no_docs).count() == 0
    nothing = kn.score_texts(odd_docs, F.lit(False)).collect()
    assert {r.base_score for r in nothing} == {0.0} and {r.train_tokens for r in nothing} == {0}
