import zlib
from collections import Counter, defaultdict

from tidemark.llm import sharding


def check(rows, texts):
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(texts)
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            data = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
            of[data].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of.values())


def test_bytes_are_even(documents, texts):
    rows = sharding.shard_by_bytes(documents, 8).collect()
    check(rows, texts)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert set(load) == set(range(8))
    groups = Counter(texts.values())
    largest = max(n * (len(t.encode()) + 1) for t, n in groups.items())
    assert max(load.values()) - min(load.values()) <= max(largest, sum(load.values()) // 200)


def test_heap_is_longest_first():
    assert [b for _, b in sharding.longest_first([(9, "a"), (7, "b"), (6, "c"), (5, "d"), (1, "e")], 2)] == [0, 1, 1, 0, 1]


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_by_bytes(odd_docs, 3).collect()
    assert len(rows) == 11 and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    by = {}
    for r in rows:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in by.values())
    assert sharding.shard_by_bytes(no_docs, 3).count() == 0


def plain(texts, shards):
    """{text: shard} by the same rules without Spark, for one task: groups to bundles, then bundles and large groups to shards."""
    import hashlib

    size = Counter()
    for t in texts:
        size[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    limit = sum(size.values()) // (sharding.BIG * shards)

    def least(items, bins):
        load, out = [(0, i) for i in range(bins)], {}
        for n, item in items:
            a, i = min(load)
            load[load.index((a, i))] = (a + n, i)
            out[item] = i
        return out

    rest = sorted(((n, k) for k, n in size.items() if n <= limit), key=lambda x: (-x[0], x[1]))
    bundle = least(rest, sharding.BUNDLES * shards)
    loads = Counter()
    for n, k in rest:
        loads[bundle[k]] += n
    items = [(n, ("bundle", i)) for i, n in loads.items()] + [(n, ("group", k)) for k, n in size.items() if n > limit]
    of = least(sorted(items, key=lambda x: (-x[0], x[1])), shards)
    return {t: of["group", k] if (k := hashlib.md5((t or "").encode()).digest()) not in bundle else of["bundle", bundle[k]] for t in texts}


def test_shards_match_plain_scheduling(spark, monkeypatch):
    import random

    monkeypatch.setattr(sharding, "BUNDLES", 8)
    rng = random.Random(5)
    texts = ["x" * rng.choice((3, 3, 3, 40, 900)) + str(rng.randrange(120)) for _ in range(400)] + [None, "", "one group" * 200] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(texts, 3)
    for again in (df, df.repartition(5)):  # ties are settled by digests, not by the order of rows
        assert {r.doc_id: r.shard for r in sharding.shard_by_bytes(again, 3).collect()} == {i: want[t] for i, t in enumerate(texts)}
