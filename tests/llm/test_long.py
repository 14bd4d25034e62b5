"""Long texts with many matches, counts beyond 32 bits, repeated attempts and repeated ids."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, kneser_ney, pii, quality_cnn, warc
from tidemark.llm.shared import scan


def test_scan_is_a_running_fold(spark):
    rows = spark.createDataFrame([([3] * n,) for n in (0, 1, 255, 256, 257, 1000)], "x array<int>")
    step = lambda a, i: (a + F.get("x", i), F.when(i % 2 == 0, F.array(a + F.get("x", i))).otherwise(F.array().cast("array<int>")))
    for r in rows.select(F.size("x").alias("n"), scan(F.size("x"), F.lit(0), "int", step).alias("out")).collect():
        assert r.out == [3 * (i + 1) for i in range(0, r.n, 2)]


def addresses(n):
    return " ".join(f"10.{i % 250}.{i // 250 % 250}.7 key=sk_live_{i:016x}" if i % 10 == 0 else f"10.{i % 250}.{i // 250 % 250}.7" for i in range(n))


def test_a_log_of_fifty_thousand_addresses(spark):
    def took(n):
        docs = spark.createDataFrame([(1, addresses(n))], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.find_pii(docs, [F.col("doc_id"), F.col("text")]).select("spans", "text", pii.redacted(F.col("text"), F.col("spans")).alias("out")).first()
        return time.perf_counter() - began, row

    took(100)
    (first, _), (second, row) = took(25_000), took(50_000)
    assert second < 3 * first + 5  # the work doubles with the text
    assert sum(s.k == pii.KINDS.index("ip") for s in row.spans) == 50_000 and [s.start for s in row.spans] == sorted(s.start for s in row.spans)
    want, at = [], 0
    for s in row.spans:
        if s.start >= at:
            want += [row.text[at : s.start], f"[{pii.KINDS[s.k].upper()}]"]
        at = max(at, s.end)
    assert row.out == "".join(want) + row.text[at:]


def test_overlapping_spans_leave_one_mark(spark):
    rows = [("ab🙂cdefgh", [(1, 0, 3), (2, 1, 5), (5, 2, 6), (7, 0, 8)]), ("abc", []), ("abc", [(0, 0, 3)]), ("", [])]
    docs = spark.createDataFrame(rows, "text string, spans array<struct<start:int,k:int,end:int>>")
    k = [f"[{x.upper()}]" for x in pii.KINDS]
    # The third begins within the second; the fourth where the third ended but for one character.
    assert [r[0] for r in docs.select(pii.redacted(F.col("text"), F.col("spans"))).collect()] == [f"a{k[0]}{k[2]}f{k[0]}h", "abc", k[0], ""]


def test_ten_thousand_dropped_parts(spark):
    text = "".join(f"ä{i:05d}" for i in range(40_000))
    data = text.encode()
    dropped = [(7 * 4 * i + 7, 7 * 4 * i + 14) for i in range(10_000)]  # every fourth piece of seven bytes
    docs = spark.createDataFrame([(text, [(0, len(data), True, dropped)]), ("none", [])], f"text string, spans {chunk_dedup.SPANS}")
    out = [r[0] for r in docs.select(chunk_dedup.without(F.col("text"), F.col("spans"))).collect()]
    assert out == ["".join(f"ä{i:05d}" for i in range(40_000) if i % 4 != 1), "none"]


def test_pair_counts_pass_32_bits(tmp_path):
    uri = f"file://{tmp_path}"
    write = kneser_ney._store(uri, "pair", "times")
    small, large = np.array([3, 1, 2]), np.array([5, 9])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1, 1], pa.int32()), pa.array(np.concatenate([small, large])), pa.array([30, 2**32 - 1, 20, 2**32 + 5, 7])], names=["s", "k", "n"])
    list(write(iter([batch])))
    arrays = kneser_ney.Arrays(kneser_ney.Stored(uri, 4))
    assert arrays.times(0).tolist() == [2**32 - 1, 20, 30] and arrays.times(0).itemsize == 4
    assert arrays.times(1).tolist() == [2**32 + 5, 7] and arrays.times(1).itemsize == 8 and len(arrays.times(2)) == 0


def test_attempts_of_a_task_write_files_of_their_own(tmp_path, monkeypatch):
    """A second attempt gets its rows in another order; what the first one reported stays as it was."""

    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):  # noqa: N802
            return 3

        def taskAttemptId(self):  # noqa: N802
            return self.attempt

    pages = [(i, f"http://h.org/{i}", f"<p>{i}</p>".encode() * 50, None) for i in range(40)]
    reported = []
    for attempt, rows in ((11, pages), (12, pages[::-1])):
        monkeypatch.setattr(warc.TaskContext, "get", lambda a=attempt: Context(a))
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([None] * 40, pa.int64())], names=["page_id", "url", "html", "refers_to"])
        write = warc._writer(f"file://{tmp_path}", b"", 1, 1000)
        made = [(p, n, open(p, "rb").read()) for b in write(iter([batch])) for p, n in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True)]
        assert len(made) > 1 and sum(n for _, n, _ in made) == 40
        reported.append(made)
    assert not {p for p, _, _ in reported[0]} & {p for p, _, _ in reported[1]}
    assert all(open(p, "rb").read() == held for p, _, held in reported[0])


@pytest.mark.parametrize("times", [1, 20_000])
def test_an_id_that_repeats_is_taken_once(spark, times):
    docs = spark.range(times).select(F.lit(5).cast("long").alias("doc_id"), F.lit("some text").alias("text")).union(spark.createDataFrame([(6, "other"), (5, "third")], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    got = quality_cnn.sample(docs, labels, F.lit(True), "text", "quality", 100, 1 << 20)
    assert got == [(5, 1, b"some text"), (5, 1, b"third"), (6, 0, b"other")]
