import hashlib

import pyarrow.fs as pafs
import pytest

from tidemark.llm import warc
from tidemark.llm.shared import shared_dir, written

PAGE = "<html>" + "body " * 400 + "</html>"
ROWS = [(1, "http://a", PAGE), (2, "http://b", "short"), (3, "http://c", "short"), (4, None, PAGE), (5, "http://d\r\nX: y", None), (9, "http://e", PAGE), (6, "http://f", ""), (None, "http://g", PAGE), (7, "http://h", "é漢🙂" * 600), (7, "http://h", "é漢🙂" * 600)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)


def test_round_trip(pages):
    rows = warc.archive_and_read(pages).collect()
    want = sorted((str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in ROWS)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in rows) == want
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows if r.payload_bytes == len(PAGE)} == {(9, "response", None), (1, "revisit", 9), (4, "revisit", 9), (None, "revisit", 9)}
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 1000)


def test_files_hold_texts_and_a_dictionary(pages, spark):
    folder = shared_dir(spark)
    files = written(warc.write_warc(pages, f"file://{folder}")).collect()
    assert sum(f.records for f in files) == len(ROWS)
    fs, blocks = pafs.LocalFileSystem(), []
    for f in files:
        with fs.open_input_stream(f.path, compression=None) as s:
            assert s.read(4) == (0x184D2A5D).to_bytes(4, "little")
        with fs.open_input_stream(f.path, compression=None) as s:
            blocks += [warc.parsed(x)["block"].decode() for x in warc.read_archive(s)]
    assert sorted(b for b in blocks if b) == sorted(["short", "short", PAGE, "é漢🙂" * 600, "é漢🙂" * 600])


def test_no_pages(pages):
    assert warc.archive_and_read(pages.filter("false")).count() == 0


def test_a_cut_record_is_refused():
    data = warc.record(1, "u", b"abc", None)
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parsed(data[:-5])


def test_the_sample_is_spread_over_the_table(spark):
    many = spark.range(0, 3000, 1, 3).selectExpr("id AS page_id", "concat('http://', id) AS url", "cast(repeat(cast(id AS string), 30) AS binary) AS html")
    got = [int(warc.parsed(r)["WARC-Record-ID"].split(":")[2]) for r in warc.sampled(many, 300, 1 << 20)]
    assert len(got) == 300 and [sum(k * 1000 <= i < k * 1000 + 1000 for i in got) > 60 for k in range(3)] == [True] * 3
    assert got == [int(warc.parsed(r)["WARC-Record-ID"].split(":")[2]) for r in warc.sampled(many.repartition(7), 300, 1 << 20)]
    few = warc.sampled(many, 300, 1000)
    assert 1 <= len(few) and sum(len(warc.parsed(r)["block"]) for r in few) <= 1000
    assert len(warc.sampled(many, 300, 1)) == 1


def test_files_are_closed_at_their_size(spark):
    import random

    rng = random.Random(1)
    rows = [(i, "u", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))) for i in range(40)]
    pages, folder = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{shared_dir(spark)}"
    files = written(warc.write_warc(pages, folder, file_bytes=80_000))
    assert files.count() > 1 and files.selectExpr("sum(records) AS n").first().n == 40
    assert sorted(r.page_id for r in warc.read_warc(spark, files, folder).collect()) == list(range(40))


def test_rows_that_repeat_a_page_id_have_ids_of_their_own():
    a, b = (warc.parsed(warc.record(1, "u", x, None)) for x in (b"one", b"two"))
    assert a["WARC-Record-ID"] != b["WARC-Record-ID"]
    assert warc.parsed(warc.record(2, "u", b"one", 1))["WARC-Refers-To"] == a["WARC-Record-ID"]


def test_extra_columns_with_clashing_names(spark, pages):
    from pyspark.sql import functions as F

    odd = pages.withColumns({c: F.lit("clash") for c in ("_k", "first", "n", "_at", "_n", "refers_to", "payload_bytes", "path", "records")})
    rows = lambda df: sorted(map(str, warc.archive_and_read(df).collect()))
    assert rows(odd) == rows(pages)
