from itertools import combinations

import pytest

from tidemark.llm import minhash


def words_set(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """Component of each id over all pairs of sets that reach the similarity."""
    sets = {d: words_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_components_match_all_pairs(spark):
    """On the thousand documents of sf0.01: no link of all pairs is missed."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents).collect()}
    assert got == brute({r.doc_id: r.text or "" for r in documents.collect()})


def test_every_pair_of_blocks_meets_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(b, n, n % 3, 5, 5, 0, 0, [b for b, many in ((1, 50), (2, 3), (3, 1)) if n < many]) for b, many in ((1, 50), (2, 3), (3, 1)) for n in range(many)]
    held = spark.createDataFrame(rows, "bucket long, node long, c long, n long, s long, center long, p long, _bands array<long>")
    want = {(a, b) for a in range(50) for b in range(a + 1, 50) if a % 3 != b % 3}
    got = minhash.block_pairs(held, "true").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_unlike_members_of_one_bucket(spark, monkeypatch):
    """Documents that share half of a template: large buckets that hold many components, one link among them."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = __import__("random").Random(3)
    head = [f"h{j}" for j in range(40)]
    rows = {i: " ".join(head + [f"t{rng.randrange(10**9)}" for _ in range(14 + i % 3)]) for i in range(60)}
    rows[60] = rows[31] + " more"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute(rows)


def test_rows_that_share_an_id_keep_the_links_of_all_texts(spark):
    word = lambda k, n=40: " ".join(f"{k}{j}" for j in range(n))
    rows = [(5, word("a")), (5, word("b")), (1, word("a") + " x"), (2, word("b") + " y"), (9, word("c")), (9, word("d")), (7, word("e"))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (9, 9), (7, 7)}


def test_long_path_is_one_component(spark):
    """More rounds than a fixed number of them would do: until nothing changes."""
    ids = __import__("random").Random(4).sample(range(10_000), 400)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.component for r in minhash.components(edges).collect()} == {min(ids)}


def test_chain_and_large_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(60):  # neighbours overlap, the ends of the chain don't
        rows[i] = " ".join(base[i // 2 :] + [f"x{j}" for j in range(i // 2)])
    for i in range(100, 160):
        rows[i] = " ".join([f"g{j}" for j in range(80)] + [f"tail{i}"])
    for i in range(200, 230):
        rows[i] = "the very same text in thirty rows of the table"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_small_components_take_few_tasks(spark, monkeypatch):
    """However many partitions shuffles have, and without a further round once all components are stars."""
    parts = []
    monkeypatch.setattr(minhash, "written", lambda df, write=minhash.written: parts.append(df.rdd.getNumPartitions()) or write(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 60)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
        assert len(minhash.components(edges).collect()) == 58
        assert len(parts) == 2 and parts[1] <= minhash.LEAST_TASKS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_path_and_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("text,n", [(b"", 0), (b"a b", 1), (b"a b c d e", 1), (b"A b c d e a B c d e", 5)])
def test_sets(text, n):
    assert len(minhash.shingle_set(text)) == n
