import random

from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup as cd


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_resist_insertions():
    rng = random.Random(5)
    text = words(rng, 3000).encode()
    a, b = cd.cuts(text), cd.cuts(text[:4000] + b"an insertion" + text[4000:])
    pieces = lambda t, c: {t[s:e] for s, e in zip([0, *c], c)}
    new = pieces(text[:4000] + b"an insertion" + text[4000:], b) - pieces(text, a)
    assert a[-1] == len(text) and len(new) <= 4
    sizes = [e - s for s, e in zip([0, *a], a)]
    assert max(sizes) <= cd.MOST + 3 and min(sizes[:-1]) >= cd.LEAST


def test_cuts_keep_characters_whole():
    text = ("é漢🙂" * 3000).encode()
    c = cd.cuts(text)
    assert b"".join(text[s:e].decode().encode() for s, e in zip([0, *c], c)) == text
    assert cd.cuts(b"") == [] and cd.cuts(b"x") == [1]


def test_cuts_match_the_recurrence():
    data = words(random.Random(6), 400).encode()
    h, want = 0, []
    for i, x in enumerate(data):
        h = (2 * h + int(cd._GEAR[x])) & 0xFFFFFFFF
        want.append(h)
    assert cd.rolling(__import__("numpy").frombuffer(data, "u1")).tolist() == want


def test_planted_passages_are_found(spark):
    rng = random.Random(7)
    passages = [words(rng, n) for n in (51, 60, 80, 200)]
    rows = []
    for i in range(120):
        rows.append((i, words(rng, 150) + (" " + passages[i % 4] if i < 40 else "") + " " + words(rng, 150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in cd.repeated_passages(df).collect()}
    assert {d for d, s in got.items() if s} == set(range(40))
    for d in range(40):
        text = rows[d][1]
        start = text.index(passages[d % 4])
        for s in got[d]:
            assert s.start >= start - cd.MOST and s.end <= start + len(passages[d % 4]) + cd.MOST
            assert s.later == (d >= 4)


def test_without_leaves_one_copy(spark):
    rng = random.Random(8)
    same, tails = words(rng, 120), [words(rng, 100) for _ in range(3)]
    df = spark.createDataFrame([(i, f"é{t} {same} ñ{t[:40]}") for i, t in enumerate(tails)], "doc_id long, text string")
    found = cd.repeated_passages(df).join(df, "doc_id").select("doc_id", "text", cd.without(F.col("text"), F.col("spans")).alias("new"))
    out = {r.doc_id: r for r in found.collect()}
    assert out[0].new == out[0].text
    assert all(len(out[i].new) < len(out[i].text) - 500 and out[i].new.startswith("é" + tails[i][:50]) for i in (1, 2))


def test_first_of_a_shared_edit_keeps_the_edit_alone(spark):
    rng = random.Random(9)
    head, tail, edit, new = words(rng, 200), words(rng, 200), words(rng, 12), words(rng, 120)
    edited = f"{head} {edit} {tail}"
    rows = [(1, f"{head} {tail}"), (2, edited), (3, edited), (4, f"{new} {head}"), (5, f"{new} {head}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = cd.repeated_passages(df).join(df, "doc_id").select("doc_id", "text", "spans", cd.without(F.col("text"), F.col("spans")).alias("new"))
    out = {r.doc_id: r for r in found.collect()}
    assert out[1].new == out[1].text and out[3].new == out[5].new == ""
    assert edit in out[2].new and len(out[2].new) < len(edit) + 4 * cd.MOST and [(s.start, s.end, s.later) for s in out[2].spans] == [(0, len(edited), True)]
    assert out[4].new.startswith(new) and len(out[4].new) < len(new) + 2 * cd.MOST


def test_short_passages_are_all_found(spark):
    """Passages of 51 to 60 words in two documents each, against the places where they were planted; some repeat a word."""
    rng = random.Random(10)
    rows, planted = [], {}
    for i in range(600):
        n = rng.randint(51, 60)
        passage = words(rng, n) if i % 10 else " ".join([words(rng, 1)] * n)
        for d in (2 * i, 2 * i + 1):
            before = words(rng, 40)
            rows.append((d, f"{before} {passage} {words(rng, 40)}"))
            planted[d] = (len(before) + 1, len(before) + 1 + len(passage))
    got = {r.doc_id: r.spans for r in cd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = {d for d, (s, e) in planted.items() if e - s > 2 * cd.RUN and not any(x.start < e and x.end > s for x in got[d])}
    assert not missed


def brute(rows, run):
    """{(doc_id, text): [(start, end, dropped)]} from plain loops over all chunk pairs in the order of id, hash and place."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    keys = sorted({(-1 if d is None else d, hashes[t or ""], t or "") for d, t in rows})
    copies = {k: sum((-1 if d is None else d, t or "") == (k[0], k[2]) for d, t in rows) for k in keys}
    seen, times, places = {}, {}, {}
    for key in keys:
        data = key[2].encode()
        ends, start = cd.cuts(data), 0
        for i in range(max(1, len(ends) - 1) if ends else 0):
            end = ends[min(i + 1, len(ends) - 1)]
            pair = data[start:end]
            later = seen.setdefault(pair, (key, start)) != (key, start)
            times[pair] = times.get(pair, 0) + copies[key]
            places.setdefault(key, []).append((start, end, pair, later))
            start = ends[i]

    def merged(pieces):
        out = []
        for s, e in sorted(pieces):
            if out and s <= out[-1][1]:
                out[-1][1] = max(e, out[-1][1])
            else:
                out.append([s, e])
        return [(s, e) for s, e in out if e - s >= run]

    found = {}
    for (d, _, t), p in places.items():
        dropped = merged((s, e) for s, e, pair, later in p if later)
        found[d, t] = [(s, e, [x for x in dropped if s <= x[0] < e]) for s, e in merged((s, e) for s, e, pair, _ in p if times[pair] > 1)]
    return found


def check_brute(df, run):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, run)
    got = cd.repeated_passages(df, run=run).withColumn("_id", F.coalesce("doc_id", F.lit(-1))).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault((-1 if d is None else d, len((t or "").encode())), set()).add(t or "")
    for r in got:
        spans = [(s.start, s.end, [(x.start, x.end) for x in s.dropped]) for s in r.spans]
        assert any(spans == want.get((r._id, t), []) for t in texts[r._id, r.n_bytes]), (r._id, r.n_bytes)
        assert all(s.later == bool(s.dropped) for s in r.spans)
    return got


def test_all_documents_match_brute_force(documents):
    got = check_brute(documents, cd.RUN)
    assert any(r.spans for r in got) and not all(r.spans for r in got)
    check_brute(documents, 0)


def test_odd_rows_match_brute_force(odd_docs):
    check_brute(odd_docs, 40)


def test_repeats_inside_a_text_and_between_rows_without_ids(spark):
    rng = random.Random(11)
    same, other = words(rng, 200), words(rng, 200)
    rows = [(1, f"{same} {words(rng, 60)} {same}"), (None, f"{words(rng, 60)} {other}"), (None, f"{other} {words(rng, 60)}"), (3, words(rng, 300)), (3, f"{words(rng, 50)} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_brute(df, cd.RUN)
    got = cd.repeated_passages(df).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert len(one.spans) == 2 and [s.later for s in one.spans] == [False, True]
    assert sorted(any(s.later for s in r.spans) for r in got if r.doc_id is None) == [False, True]
    assert sorted(any(s.later for s in r.spans) for r in got if r.doc_id == 3) == [False, True]


def test_a_span_drops_only_what_came_before(spark):
    """Document 2 holds the head of document 1's passage, then one that document 3 has too: the head alone is dropped."""
    rng = random.Random(12)
    head, tail = words(rng, 130), words(rng, 130)
    rows = [(1, f"{words(rng, 40)} {head}"), (2, f"{words(rng, 40)} {head} {tail}"), (3, f"{tail} {words(rng, 40)}")]
    got = {r.doc_id: r.spans for r in cd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = lambda d: sum(x.end - x.start for s in got[d] for x in s.dropped)
    assert size(1) == 0 and len(head) - 2 * cd.MOST < size(2) < len(head) + 2 * cd.MOST and size(3) > len(tail) - 2 * cd.MOST


def test_odd_rows(odd_docs, no_docs):
    rows = cd.repeated_passages(odd_docs, run=40).collect()
    assert len(rows) == 11 and all(r.n_chunks == 0 for r in rows if r.doc_id == 1)
    assert all(r.spans for r in rows if r.doc_id in (5, 6, 8, 9)) and not any(r.spans for r in rows if r.doc_id in (1, 2, 7))
    assert cd.repeated_passages(no_docs).count() == 0
