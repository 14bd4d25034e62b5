"""WARC archives compressed record by record with a Zstandard dictionary that stands in each file's first frame.

A sample of records, spread over the whole table by a hash, trains the dictionary. Tasks write files of bounded size: a
skippable frame holds the dictionary, and every record is a frame of its own, so any record can be read from its offset
alone. Records with equal payloads become revisits of one response. The reader works through whole files, one a task at
a time.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir, small, text_of, written

#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
DICTIONARY_BYTES = 64 * 1024
#: The dictionary is trained on at most so many records, of so many bytes together (on one at least).
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 8 << 20
#: A file is closed once it has so many bytes.
FILE_BYTES = 1 << 30
LEVEL = 3
#: The magic number that the WARC-Zstandard convention gives its dictionary frame.
_DICTIONARY_FRAME = 0x184D2A5D
#: What a trained dictionary begins with.
_TRAINED = b"\x37\xa4\x30\xec"
_END = b"\r\n"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, html: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without a block whose headers keep length and digest of the full payload.

    Ids are made of page_id and digest, so that rows which repeat a page_id with other payloads have ids of their own.
    """
    kind, digest = "response" if refers_to is None else "revisit", hashlib.sha1(html).hexdigest()
    body = html if refers_to is None else b""
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", _urn(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []),
        ("X-Payload-Length", str(len(html))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))),
    ]
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head), b""]
    return _END.join(lines) + _END + body + _END + _END


def parsed(data: bytes) -> dict:
    """A record's headers, and its block as `block`."""
    end = data.index(_END + _END)
    first, *lines = data[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != _END + _END:
        raise ValueError("a record's block doesn't have its Content-Length")
    return head | {"block": block}


def _dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the sample; a few records, or ones too alike to train on, serve as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def sampled(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Records of the pages (page_id, url, html) with the least hashes of id and address, in that order."""
    place = F.xxhash64("page_id", "url").alias("_at")
    ends = pages.select(place, F.octet_length("html").alias("_n")).orderBy("_at", "_n").limit(records).collect()
    taken, total = [], 0
    for r in ends:
        total += r._n
        if taken and total > size:
            break
        taken.append(r)
    if not taken:
        return []
    # Rows that share id and address may be more than were counted; as many as were taken are read.
    got = pages.select("*", place).filter(F.col("_at").isin(sorted({r._at for r in taken})) & (F.octet_length("html") <= max(r._n for r in taken)))
    rows = got.orderBy("_at", F.octet_length("html"), F.xxhash64("html")).limit(len(taken)).collect()
    return [record(r.page_id, r.url, bytes(r.html), None) for r in rows]


def _writer(folder: str, dictionary: bytes, kind: int, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True).compress
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        context, f, number, n = TaskContext.get(), None, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal f, number, n
            f.close()
            # A file shows only when it is whole. Each attempt has names of its own, as rows may come in another order then.
            path = f"{top}/part-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
            fs.move(f"{top}/_{context.taskAttemptId()}", path)
            done = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])
            f, number, n = None, number + 1, 0
            return done

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                if f is None:
                    f = fs.open_output_stream(f"{top}/_{context.taskAttemptId()}", compression=None)
                    f.write(struct.pack("<II", _DICTIONARY_FRAME, len(dictionary)) + dictionary)
                f.write(compress(record(*(c[i].as_py() for c in cols))))
                n += 1
                if f.tell() >= most:
                    yield closed()
        if f is not None:
            yield closed()

    return write


def read_archive(f) -> Iterator[bytes]:
    """The records of an archive, frame by frame; memory is bounded by a record and a buffer."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != _DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    content = f.read(n)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == _TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    rest = b""
    while True:
        rest = rest or f.read(1 << 20)
        if not rest:
            return
        one, parts = d.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
            if one.eof:
                break
            if not (rest := f.read(1 << 20)):
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        number = lambda urn: int(x) if urn and (x := urn.split(":")[2]) else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as f:
                    for data in read_archive(f):
                        r = parsed(data)
                        digest, kind = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"]
                        if kind == "response" and hashlib.sha1(r["block"]).hexdigest() != digest:
                            raise ValueError(f"{path}: {r['WARC-Record-ID']} doesn't have its digest")
                        size = len(r["block"]) if kind == "response" else int(r["X-Payload-Length"])
                        rows.append((number(r["WARC-Record-ID"]), r["WARC-Target-URI"], size, digest, kind, number(r.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def write_warc(pages: DataFrame, folder: str, html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives the pages below `folder`, a shared one; (path, records) of its files.

    Of pages with equal payloads of at least LEAST_REVISIT bytes that with the largest page_id is the response. A null
    html is an empty payload, a null page_id has an empty record id and is never referred to unless its whole group has
    none, in which case all are responses. Rows that repeat a page_id and a payload repeat a record. The dictionary is
    trained on a sample that is spread over the whole table (see sampled()). An empty table gives no files.
    """
    body = text_of(html).cast("binary")
    long_ = F.octet_length(body) >= LEAST_REVISIT
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.when(long_, F.unhex(F.sha1(body))).alias("_k"))
    d = _dictionary(sampled(p.select("page_id", "url", "html")))
    content = d.as_bytes()
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == _TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    same = written(p.filter("_k IS NOT NULL").groupBy("_k").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("_k", "first"))
    # Rows without a key get one each, so that a shuffle doesn't gather them.
    p = p.withColumn("_k", F.coalesce("_k", F.coalesce("page_id", F.lit(-1)).cast("string").cast("binary"))).join(small(same), "_k", "left")
    p = p.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return p.mapInArrow(_writer(folder, content, kind, file_bytes), "path string, records long")


def read_warc(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the files."""
    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, html: str = "html") -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_warc(spark, written(write_warc(pages, uri, html)), uri)
