"""Operators of DataFrame functions alone, against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_rules, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


HARD = [
    "a@b.c_d@e.f x@y.z", "a@b.c.d@e.f.", "%+-@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1.1 001.002.003.004 1.2.3", "9999999999.1.1.1",
    "4111111111111111", "4111-1111 1111-1111", "4111  1111 1111 1111", "4111 1111 1111 1111-", "14111111111111111 5", "+1 (415) 555-2671", "+1..........2+44 20 7946 0958",
    "+1 234 567 890 1234567", "🙂 ü 4111111111111111 é x@y.zz", "1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+4111111111111111", "x@y.z" * 50, "@@@", "+", "0.0.0.0", "@a.b a@b a@.b",
]


def test_base_spans(spark, documents, texts):
    rows = [(i, t) for i, t in enumerate(HARD)]
    both = documents.select("doc_id", "text").union(spark.createDataFrame([(100_000 + i, t) for i, t in rows], "doc_id long, text string"))
    texts = texts | {100_000 + i: t for i, t in rows}
    got = {r.doc_id: [(s.start, s.k, s.end) for s in r.spans] for r in pii.find_pii(both, [F.col("doc_id")]).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        assert [s for s in got[d] if s[1] < pii.BASE] == base_spans(t), t[:80]


def test_added_spans_and_redaction(spark):
    rows = [(i, f'Text {i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and key AKIA{hashlib.md5(str(i).encode()).hexdigest()[:16].upper()} end. Dr. Anna Example wrote to a{i}@b.example.') for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(df, [F.col("doc_id"), F.col("text")])
    out = found.select("spans", pii.redacted(F.col("text"), F.col("spans")).alias("new")).collect()
    for r in out:
        assert [s.k for s in r.spans if s.k < 4] == [0] and sum(s.k == 4 for s in r.spans) == 2
        assert 'token = "[SECRET]" and key [SECRET] end.' in r.new and r.new.endswith(" [EMAIL].") or r.new.endswith("[EMAIL]")
    clean = spark.createDataFrame([(1, "the quick brown fox isn't named in 2024 or at 10:30, and abcdefghijklmnop is a word")], "doc_id long, text string")
    assert pii.find_pii(clean, [F.col("doc_id")]).first().spans == []


def test_pii_odd_rows(odd_docs, no_docs):
    rows = pii.find_pii(odd_docs, [F.col("doc_id"), F.col("kept"), F.col("score")]).collect()
    assert len(rows) == 11
    assert [[s.k for s in r.spans] for r in rows if r.doc_id in (5, 6)] == [[0, 3, 1]] * 3
    assert all(not r.spans for r in rows if r.doc_id in (1, 2, 3, 8, 9))
    assert pii.find_pii(no_docs, [F.col("doc_id")]).count() == 0


def index_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def leaks(docs, items):
    """(n_words, n_hit, item ids) of each document by comparing all windows."""
    windows = {}
    for i, t in items:
        w = index_words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[s : s + n])), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = index_words(t), set(), set()
        for n in {n for n, _ in windows}:
            for p in range(len(w) - n + 1):
                if x := windows.get((n, tuple(w[p : p + n]))):
                    ids |= x
                    hit |= set(range(p, p + n))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_windows_match_brute_force(spark, documents, sf_dir, odd_docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    extra = [(900, "one two three"), (901, None), (902, "..."), (None, "Ä É ñ ß"), (903, "long " * 25), (900, "one two three"), (904, "the")]
    items += extra
    bench = bench.select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    both = documents.select("doc_id", "text").union(odd_docs.filter("doc_id <> 8 OR doc_id IS NULL").select("doc_id", "text")).union(spark.createDataFrame([(7777, "x " + items[3][1] + " y " + items[3][1] + " long long " + "long " * 12)], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in decontam.decontaminate(both, bench).collect()), key=str)
    assert got == leaks([(r.doc_id, r.text) for r in both.collect()], items)


def test_long_items_and_many_items(spark):
    """An item of 20,000 words, whose common words recur all over it, and a thousand short ones."""
    import random

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}" if rng.random() < 0.7 else f"r{rng.randrange(10**6)}"
    long = [word() for _ in range(20_000)]
    items = [(0, " ".join(long))] + [(1 + i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(1000)]
    docs = [(1, " ".join(long)), (2, "x " + " ".join(long[5000:9000]) + " y"), (3, " ".join(long[:2000][::-1])), (4, " ".join(w for i, w in enumerate(long[:500]) if i % 9))]
    docs += [(10 + i, f"{' '.join(word() for _ in range(20))} {items[1 + 7 * i][1]} {' '.join(word() for _ in range(20))}") for i in range(100)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in decontam.decontaminate(*frames).collect()), key=str)
    assert got == leaks(docs, items)


def test_columns_of_the_benchmark_that_clash(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = bench.withColumns({c: F.lit("clash") for c in ("_item", "_b", "_q", "_s", "_w", "_d", "_h", "doc_id", "hits", "n_hit")})
    rows = lambda b: sorted(map(str, decontam.decontaminate(documents, b).collect()))
    assert rows(bench) == rows(odd)


def test_proximity_and_no_rows(spark, no_docs, documents):
    words = [f"rare{i}" for i in range(14)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(w + (" filler" if i == 5 else "") for i, w in enumerate(words))), (3, "nothing of it")], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (False, 0)}
    assert decontam.decontaminate(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(documents, bench.filter("false")).collect())


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_statistics(documents, texts, odd_docs):
    both = documents.select("doc_id", "text", "source").union(odd_docs.select("doc_id", "text", "source"))
    want = sorted((str(r.doc_id), *statistics(r.text)) for r in both.collect())
    got = line_rules.line_rules(both).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def test_lines_of_a_host(spark, no_docs):
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731  digits are alike in normalised lines
    body = lambda i: " ".join(f"w{letters(i)}x{letters(j)}" for j in range(60))
    rows = [(i, f"Cookie Notice  {i % 10}\n{body(i)}", "a") for i in range(30)]
    rows += [(100 + i, body(1000), "a") for i in range(40)]  # copies aren't boilerplate
    rows += [(200, "cookie notice 7\n" * 40 + body(2000), "a"), (300, f"cookie notice 1\n{body(300)}", "b"), (301, body(301), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_rules.line_rules(df).collect()}
    assert all(got[i].n_removed_lines == 1 and got[i].n_removed_words == 3 and got[i].kept for i in range(30))
    assert all(got[i].n_removed_lines == 0 and got[i].kept for i in [*range(100, 140), 300, 301])
    assert got[200].n_removed_lines == 40 and not got[200].kept
    one = line_rules.line_rules(df).filter("doc_id = 3").join(df, "doc_id").select(line_rules.without_lines(F.col("text"), F.col("removed")).alias("t")).first()
    assert one.t == body(3)
    assert line_rules.line_rules(no_docs).count() == 0


@pytest.mark.parametrize("line,same", [("  A  b\t9 ", "a b 0"), ("ÄB 12", "äb 00")])
def test_normal_line(spark, line, same):
    assert spark.createDataFrame([(line,)], "x string").select(line_rules.normal_line(F.col("x")).alias("y")).first().y == same


def test_em_matches_plain_loops():
    """Two kinds of spans, true ones mostly voted for; against expectation-maximisation written out."""
    import math
    import random

    import numpy as np

    rng = random.Random(2)
    draw = lambda p: rng.choices((0, 1, 2), p)[0]
    rows = [tuple(draw(p) for p in (((0.2, 0.1, 0.7), (0.6, 0.0, 0.4), (0.3, 0.1, 0.6)) if i % 3 else ((0.3, 0.6, 0.1), (1.0, 0.0, 0.0), (0.4, 0.5, 0.1)))) for i in range(300)]
    different = sorted(set(rows))
    n = [rows.count(v) for v in different]
    prior, odds = -1.0, [{0: 0.0, 1: -1.5, 2: 1.5} for _ in range(3)]
    p = lambda v: 1 / (1 + math.exp(-(prior + sum(odds[i][x] for i, x in enumerate(v)))))
    for _ in range(7):
        q = [p(v) for v in different]
        yes = sum(a * b for a, b in zip(n, q))
        prior, new = math.log((yes + 1) / (sum(n) - yes + 1)), []
        for i in range(3):
            by = {}
            for x in range(3):
                on = (sum(a * b for a, b, v in zip(n, q, different) if v[i] == x) + 1) / (yes + 3)
                off = (sum(a * (1 - b) for a, b, v in zip(n, q, different) if v[i] == x) + 1) / (sum(n) - yes + 3)
                by[x] = math.log(on / off)
            new.append({0: by[0], 1: min(by[1], 0), 2: max(by[2], 0)})
        odds = new
    got = pii.expectation_maximisation(np.array(different), np.array(n), 7)
    assert got[0] == pytest.approx(prior) and got[2] == pytest.approx([p(v) for v in different])
    assert [list(map(float, row)) for row in got[1]] == [pytest.approx([o[0], o[1], o[2]]) for o in odds]
    true = [i % 3 > 0 for i in range(300)]
    final = dict(zip(different, pii.expectation_maximisation(np.array(different), np.array(n))[2]))
    assert sum((final[v] > 0.5) == t for v, t in zip(rows, true)) > 255


def test_added_spans_follow_the_model(spark):
    """Candidates, votes and choice of added spans against regular expressions and the fitted weights in plain Python."""
    import math
    import random

    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = [(i, f'user_name_{i} said token = "{hexes(40)}" to Dr. Anna Smith; order 1234-x{i}yzzzzzzzz. SSN 123-45-{6000 + i} and 999-45-6789.') for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df, [F.col("doc_id")]).collect()
    secret, number, name = (re.compile(pii._PATTERNS[k].replace(r"\p{Lu}", "[A-Z]").replace(r"\p{L}", "[A-Za-z]")) for k in ("secret", "number", "name"))
    for r in found:
        text, base = rows[r.doc_id][1], base_spans(rows[r.doc_id][1])
        want = [(m.start(), k, m.end()) for k, p in ((4, secret), (5, number), (6, name)) for m in p.finditer(text)]
        want = [s for s in want if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        assert [(s.start, s.k, s.end) for s in r._spans] == sorted(want + base)
    model = pii.fit(spark.createDataFrame(found, pii.candidates(df, [F.col("doc_id")]).schema))
    score = lambda s: 1 / (1 + math.exp(-(model.kind_weights[s.k] + sum(w * x for w, x in zip(model.feature_weights, s.x)))))
    got = {r.doc_id: [(s.start, s.k, s.end) for s in r.spans] for r in pii.find_pii(df, [F.col("doc_id")]).collect()}
    assert got == {r.doc_id: [(s.start, s.k, s.end) for s in r._spans if s.k < 4 or score(s) > 0.5] for r in found}
    kinds = {k for s in got.values() for _, k, _ in s}
    assert {4, 6} <= kinds


