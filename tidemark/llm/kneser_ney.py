"""Language-model scores: interpolated modified Kneser-Ney over word pairs, counted in Spark, read from mapped arrays.

Counting has two passes. The first counts words and stores them as arrays sorted by a 64-bit hash; a word's place is its
number. The second counts pairs of numbers and stores them sorted by a hash of the pair. What the formula needs of each
context and word is stored by number. Arrays lie in the shared folder in shards of bounded size, which tasks find by name;
workers map them (or hold a bounded set of them, where the folder isn't a mounted one), so scoring takes little memory of
its own for the model and looks up each batch's different pairs once.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir, text_of, written

END = xxhash.xxh3_64_intdigest(b" end ")  # no word holds a space
#: Different words or pairs that a shard of an array holds at most, about; numbers in a block of an array by number.
SHARD = 1 << 21
BLOCK = 1 << 20
#: Tokens whose n-grams are combined in a task before they are sent.
COMBINE = 1 << 22
#: Tokens that are scored at once.
SCORED = 1 << 19
#: Partitions that shards are dealt to at most; a partition writes its shards one after the other.
PARTITIONS = 1 << 13
#: What a worker holds open at most: mapped files, and bytes of shards of a folder that isn't mounted.
MAPS, HELD_BYTES = 4096, 256 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)
_UNMIX = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's tokens: its words, A-Z lower-cased, then the end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def mixed(pair: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit keys."""
    x = pair.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def unmixed(h: np.ndarray) -> np.ndarray:
    """The keys of such hashes."""
    x = (h ^ (h >> np.uint64(32))) * _UNMIX
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class PairKeys:
    """One-to-one (shard, key) of pairs of numbers below 2^bits, over 2^shard_bits shards.

    A pair has 2 x bits bits. The key keeps 64 of them, mixed; what is beyond (none for up to 2^32 numbers) is in the
    shard's number, whose other bits are the key's top ones.
    """

    bits: int
    shard_bits: int

    @property
    def extra(self) -> int:
        return max(0, 2 * self.bits - 64)

    def split(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, w, b = before.astype(np.uint64), word.astype(np.uint64), np.uint64(self.bits)
        key = mixed((a << b) | w)
        shard = key >> np.uint64(64 - (self.shard_bits - self.extra))
        if self.extra:
            high = (a >> np.uint64(64 - self.bits)) ^ (key & np.uint64((1 << self.extra) - 1))
            shard |= high << np.uint64(self.shard_bits - self.extra)
        return shard.astype(np.int64), key

    def joined(self, shard: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, b = unmixed(key), np.uint64(self.bits)
        before, word = low >> b, low & np.uint64((1 << self.bits) - 1)
        if self.extra:
            high = np.uint64(shard >> (self.shard_bits - self.extra)) ^ (key & np.uint64((1 << self.extra) - 1))
            before |= high << np.uint64(64 - self.bits)
        return before.astype(np.int64), word.astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams occur once, twice, three and four times; 0.5, 1, 1.5 where that fails."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= i + 1 for i, x in enumerate(d)):
            return d
    return 0.5, 1.0, 1.5


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Stored:
    """Where the arrays of a model are, and the numbers that hold for all."""

    uri: str
    bits: int
    pairs: PairKeys = PairKeys(32, 4)
    n_tokens: int = 0
    n_words: int = 0
    d: tuple = (0.5, 1.0, 1.5)
    d_low: tuple = (0.5, 1.0, 1.5)
    low_total: int = 0
    low_gamma: float = 1.0


class Arrays:
    """Arrays of a stored model, mapped; where the shared folder isn't a mounted one, a shard is read when it is used. Those
    used last stay open, within bounds. A shard without a file is empty.
    """

    _open: dict[str, Arrays] = {}

    def __init__(self, stored: Stored, held_bytes: int = HELD_BYTES, maps: int = MAPS) -> None:
        self.s, self.most, self.maps_most = stored, held_bytes, maps
        self.maps: OrderedDict[tuple[str, int], tuple[np.ndarray, int]] = OrderedDict()
        self.bytes = 0

    @classmethod
    def of(cls, stored: Stored) -> Arrays:
        held = cls._open.get("")
        if held is None or held.s != stored:  # while the model is trained, its first arrays are a Stored of their own
            held = cls._open[""] = cls(stored)
        return held

    def _read(self, name: str, shard: int, kind: str) -> tuple[np.ndarray, int]:
        uri = f"{self.s.uri}/{name}-{shard}"
        try:
            if urlparse(uri).scheme == "file":
                return np.memmap(urlparse(uri).path, kind, "r"), 0
            fs, path = _fs(uri)
            with fs.open_input_file(path) as f:
                data = f.read()
            return np.frombuffer(data, kind), len(data)
        except FileNotFoundError:
            return np.empty(0, kind), 0

    def get(self, name: str, shard: int, kind: str) -> np.ndarray:
        key = (name, shard)
        if key in self.maps:
            self.maps.move_to_end(key)
            return self.maps[key][0]
        array, size = self.maps[key] = self._read(name, shard, kind)
        self.bytes += size
        while len(self.maps) > 1 and (len(self.maps) > self.maps_most or self.bytes > self.most):
            self.bytes -= self.maps.popitem(last=False)[1][1]
        return array

    def times(self, shard: int) -> np.ndarray:
        """Counts of a shard's pairs, as wide as their bytes say."""
        raw, n = self.get("times", shard, "<u1"), len(self.get("pair", shard, "<u8"))
        return raw.view(f"<u{len(raw) // n}") if n else raw

    def _sharded(self, keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
        """Of sorted keys, the slice of each shard by their top bits."""
        edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        edges = [0, *edges, len(keys)]
        for i in range(len(edges) - 1):
            if edges[i] < edges[i + 1]:
                yield i, slice(edges[i], edges[i + 1])

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of sorted word hashes; unknown words have the number -1 and the count 0."""
        first = self.get("first", 0, "<i8")
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for i, at in self._sharded(hashes, self.s.bits):
            have = self.get("hash", i, "<u8")
            if len(have):
                place = np.minimum(np.searchsorted(have, hashes[at]), len(have) - 1)
                hit = have[place] == hashes[at]
                ids[at] = np.where(hit, first[i] + place, -1)
                counts[at] = np.where(hit, self.get("count", i, "<i8")[place], 0)
        return ids, counts

    def pair_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        shard, key = self.s.pairs.split(before, word)
        order = np.lexsort((key, shard)) if self.s.pairs.extra else np.argsort(key)
        shard, key, out = shard[order], key[order], np.zeros(len(key), np.int64)
        edges = [*np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(key)] if len(key) else []
        for a, b in zip(edges, edges[1:]):
            have = self.get("pair", int(shard[a]), "<u8")
            if len(have):
                place = np.minimum(np.searchsorted(have, key[a:b]), len(have) - 1)
                out[a:b] = np.where(have[place] == key[a:b], self.times(int(shard[a]))[place], 0)
        back = np.empty_like(out)
        back[order] = out
        return back

    def by_number(self, name: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids))
        block = ids // BLOCK
        for b in np.unique(block[ids >= 0]):
            have, mine = self.get(name, int(b), "<f8"), block == b
            if len(have):
                out[mine] = have[ids[mine] % BLOCK]
        return out

    def probabilities(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """p(word | before) of numbers; -1 is an unknown word, n_words as `before` the start of a text."""
        s = self.s
        times = np.zeros(len(word), np.int64)
        known = (before >= 0) & (word >= 0)
        times[known] = self.pair_counts(before[known], word[known])
        low = self.by_number("follows", word)  # in how many contexts the word occurs
        less = np.array([0.0, *s.d_low])[np.minimum(low, 3).astype(int)]
        uniform = 1 / (s.n_words + 1)
        p1 = np.maximum(low - less, 0) / max(s.low_total, 1) + (s.low_gamma if s.low_total else 1.0) * uniform
        total = self.by_number("total", before)
        gamma = np.where(total > 0, self.by_number("gamma", before), 1.0)
        less = np.array([0.0, *s.d])[np.minimum(times, 3)]
        return np.where(total > 0, np.maximum(times - less, 0) / np.maximum(total, 1), 0.0) + gamma * p1


def _combined(keys_of: Callable[[list[np.ndarray]], tuple[np.ndarray | None, np.ndarray]], bits: int):
    """(p, s, k, n): counts of the keys of tokens, combined within a task as far as COMBINE tokens go; s is a key's shard (its
    top bits, where keys_of gives none) and p the partition that writes it.
    """
    shift = max(0, bits - PARTITIONS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            shard, keys = keys_of(held)
            if shard is None:
                keys = np.sort(keys)
                shard = keys >> np.uint64(64 - bits)
            else:
                order = np.lexsort((keys, shard))
                shard, keys = shard[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1])]))
            shard = shard[first].astype(np.int32)
            n = np.diff(np.append(first, len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(shard >> shift), pa.array(shard), pa.array(keys[first].view(np.int64)), pa.array(n)], names=["p", "s", "k", "n"])

        for batch in batches:
            for text in batch.column("t").to_pylist():
                held.append(token_hashes(text))
                size += len(held[-1])
                if size >= COMBINE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def _words_of(docs: list[np.ndarray]) -> tuple[None, np.ndarray]:
    return None, np.concatenate(docs)


def _pairs_of(stored: Stored):
    def pairs(docs: list[np.ndarray]) -> tuple[np.ndarray | None, np.ndarray]:
        hashes = np.concatenate(docs)
        different, at = np.unique(hashes, return_inverse=True)
        ids = Arrays.of(stored).words(different)[0][at]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])] = stored.n_words
        shard, key = stored.pairs.split(before, ids)
        return (shard if stored.pairs.extra else None), key

    return pairs


def _put(uri: str, arrays: dict[str, np.ndarray], shard: int) -> pa.Table:
    """Writes a shard's arrays, each under its final name only when whole; a repeated task replaces equal content."""
    fs, top = _fs(uri)
    fs.create_dir(top, recursive=True)
    for name, a in arrays.items():
        aside = f"{top}/_{name}-{shard}-{np.random.default_rng().integers(1 << 62)}"
        with fs.open_output_stream(aside, compression=None) as f:
            f.write(np.ascontiguousarray(a).data)
        fs.move(aside, f"{top}/{name}-{shard}")
    return pa.table({"name": list(arrays), "shard": pa.array([shard] * len(arrays), pa.int64()), "n": pa.array([len(a) for a in arrays.values()], pa.int64())})


_FILES = "name string, shard long, n long"


def _bits(n: int) -> int:
    return max(4, (n // SHARD).bit_length() + 1)


def _column(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    c = t.column(name)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).to_numpy(zero_copy_only=False)


def _store(uri: str, keys: str, counts: str, kind: str = ""):
    """Counts without a kind take four bytes each, eight in shards that hold one of over 32 bits (see Arrays.times). Writes the shards of a partition, whose rows come shard by shard; each is sorted by its keys. One is held at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def put() -> Iterator[pa.RecordBatch]:
            k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k)
            n = n.astype(kind or ("<u4" if n.max() < 1 << 32 else "<u8"))
            yield from _put(uri, {keys: k[order], counts: n[order]}, shard).to_batches()

        for b in batches:
            s, k, n = (_column(b, c) for c in ("s", "k", "n"))
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1), len(s)] if len(s) else []
            for x, y in zip(edges, edges[1:]):
                if held and int(s[x]) != shard:
                    yield from put()
                    held = []
                shard = int(s[x])
                held.append((k[x:y].view(np.uint64).copy(), n[x:y].copy()))
        if held:
            yield from put()

    return write


def _counted(texts: DataFrame, keys_of: Callable, bits: int) -> DataFrame:
    """(p, s, k, n) with the rows of a shard in one partition, in a row: one shuffle serves the sums and the files."""
    dealt = texts.mapInArrow(_combined(keys_of, bits), "p int, s int, k long, n long").repartitionById(min(PARTITIONS, 1 << bits), F.col("p"))
    return dealt.groupBy("p", "s", "k").agg(F.sum("n").alias("n")).sortWithinPartitions("s")


def _contexts(stored: Stored):
    """Of each shard of pairs: sums over its pairs by context (side 0), by word (side 1), and how many occur 1 to 4 times."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(stored)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                key, times = np.asarray(arrays.get("pair", i, "<u8")), np.asarray(arrays.times(i)).astype(np.int64)
                for side, ids in enumerate(stored.pairs.joined(i, key) if len(key) else ()):
                    order = np.argsort(ids, kind="stable")
                    ids, t = ids[order], times[order]
                    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                    sums = lambda x, f=first: pa.array(np.add.reduceat(x.astype(np.int64), f))
                    cols = [pa.array(np.full(len(first), side, np.int32)), pa.array(ids[first]), sums(t), sums(np.ones(len(t))), sums(t == 1), sums(t == 2), sums(t == 3), sums(t == 4)]
                    yield pa.RecordBatch.from_arrays(cols, names=["side", "id", "total", "pairs", "n1", "n2", "t3", "t4"])

    return read


def train(docs: DataFrame, text: str = "text", number_bits: int = 32) -> Stored:
    """Counts all words and word pairs of docs and stores the model. Words have numbers of `number_bits` bits, or of as many
    more as their number needs (42 at most, for four million million different words).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    texts = docs.select(text_of(text).cast("binary").alias("t"))

    # Shards are numbered before words are counted: texts rarely have more than one different word in 64 bytes.
    most = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    bits = _bits(most // 64)
    files = written(_counted(texts, _words_of, bits).mapInArrow(_store(uri, "hash", "count", "<i8"), _FILES))
    # One number for each shard of words, so for 64 MB of text or more: where the numbers of its words begin.
    sizes = np.zeros(1 << bits, np.int64)
    for r in files.filter("name = 'hash'").select("shard", "n").collect():
        sizes[r.shard] = r.n
    n_words = int(sizes.sum())
    stored = Stored(uri, bits)
    if not n_words:
        return stored
    _put(uri, {"first": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")}, 0)
    n_tokens = spark.range(0, 1 << bits, 1, min(PARTITIONS, 1 << bits)).mapInArrow(_token_sums(stored), "n long").agg(F.sum("n")).first()[0]
    number_bits = max(number_bits, (n_words + 1).bit_length())
    if number_bits > 42:
        raise ValueError("over 2^42 different words")
    pairs = PairKeys(number_bits, max(_bits(n_tokens), 2 * number_bits - 63))
    stored = replace(stored, pairs=pairs, n_tokens=n_tokens, n_words=n_words)

    # Shards by the hash of the pair, so that a word that is in a third of all pairs doesn't fill one.
    written(_counted(texts, _pairs_of(stored), pairs.shard_bits).mapInArrow(_store(uri, "pair", "times"), _FILES))
    shards = spark.range(0, 1 << pairs.shard_bits, 1, min(PARTITIONS, 1 << pairs.shard_bits))
    part = shards.mapInArrow(_contexts(stored), "side int, id long, total long, pairs long, n1 long, n2 long, t3 long, t4 long")
    by_id = written(part.groupBy("side", "id").agg(*[F.sum(c).alias(c) for c in ("total", "pairs", "n1", "n2", "t3", "t4")]))
    contexts, follows = (by_id.filter(F.col("side") == i) for i in (0, 1))
    d = discounts(*contexts.agg(*[F.sum(c) for c in ("n1", "n2", "t3", "t4")]).first())
    times = lambda i: F.count_if(F.col("pairs") == i)
    low_total, *low = follows.agg(F.sum("pairs"), *map(times, (1, 2, 3, 4)), F.count_if(F.col("pairs") > 2)).first()
    d_low = discounts(*low[:4])
    low_gamma = (d_low[0] * low[0] + d_low[1] * low[1] + d_low[2] * low[4]) / low_total

    def by_number(values: Callable[[pa.Table], dict[str, np.ndarray]]):
        def put(t: pa.Table) -> pa.Table:
            b = t.column("shard")[0].as_py()
            at, out = _column(t, "id") - b * BLOCK, {}
            for name, x in values(t).items():
                out[name] = np.zeros(BLOCK, "<f8")
                out[name][at] = x
            return _put(uri, out, b)

        return put

    def of_context(t: pa.Table) -> dict[str, np.ndarray]:
        total, pairs, n1, n2 = (_column(t, c).astype(float) for c in ("total", "pairs", "n1", "n2"))
        return {"total": total, "gamma": (d[0] * n1 + d[1] * n2 + d[2] * (pairs - n1 - n2)) / total}

    block = F.floor(F.col("id") / BLOCK).cast("long")
    written(contexts.withColumn("shard", block).groupBy("shard").applyInArrow(by_number(of_context), _FILES))
    written(follows.withColumn("shard", block).groupBy("shard").applyInArrow(by_number(lambda t: {"follows": _column(t, "pairs").astype(float)}), _FILES))
    return replace(stored, d=d, d_low=d_low, low_total=low_total, low_gamma=low_gamma)


def _token_sums(stored: Stored):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(stored)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(arrays.get("count", i, "<i8").sum()) for i in batch.column("id").to_pylist()], pa.int64())], names=["n"])

    return read


def _slices(texts: list[bytes]) -> Iterator[list[np.ndarray]]:
    """The texts' tokens, in lists of about SCORED tokens at most (one text at least)."""
    docs, size = [], 0
    for t in texts:
        d = token_hashes(t)
        if docs and size + len(d) > SCORED:
            yield docs
            docs, size = [], 0
        docs.append(d)
        size += len(d)
    if docs:
        yield docs


def _scores(m: Arrays, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each document."""
    lengths = np.array([len(d) for d in docs])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    different, at = np.unique(np.concatenate(docs), return_inverse=True)
    known, counts = m.words(different)
    counts = counts[at]
    base = np.log10((counts + 1) / (m.s.n_tokens + 1 * (m.s.n_words + 1)))
    # A pair of places in the slice's list of words stands for all that the model sees of it; one more starts a text.
    place = at.astype(np.int64)
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[start] = len(different)
    pair, where = np.unique((before << 32) | place, return_inverse=True)
    numbers = np.append(known, m.s.n_words)
    p = np.log10(m.probabilities(numbers[pair >> 32], known[pair & 0xFFFFFFFF]))[where]
    return lengths, *(np.add.reduceat(x, start) for x in ((counts > 0).astype(np.int64), base, p))


def _scorer(stored: Stored):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_scores(Arrays.of(stored), docs) for docs in _slices(batch.column("t").to_pylist())]
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, training: Column | None = None, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model is trained on the rows where `training` holds (all by default; a null is no). Null texts are empty and so
    are the end alone. Without training rows each token scores alike. Repeated rows stay; an empty table gives an empty one.
    """
    use = F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)
    stored = train(docs.filter(use), text)
    rows = docs.select("doc_id", (~use).alias("held_out"), text_of(text).cast("binary").alias("t"))
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(_scorer(stored), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(stored.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
