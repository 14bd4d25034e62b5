"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, decontam, kneser_ney, line_rules, merkle, minhash, packing, pii, pipeline, quality_cnn, sharding, tiered_search, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document; base_sha256 digests those that the four patterns alone give."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"), [F.col("doc_id")])
    base = F.filter("spans", lambda s: s["k"] < pii.BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(pii.BASE)], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels of those whose remainder isn't 1."""
    return quality_cnn.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(3) != 1)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share: for each document where they stand and how much of it a deduplication takes out."""
    out = chunk_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    dropped = F.flatten(F.transform("spans", lambda s: s["dropped"]))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_bytes", "n_chunks", F.size("spans").cast("long").alias("n_repeats"), size(F.col("spans")).alias("repeated_bytes"), size(dropped).alias("dropped_bytes"), places.alias("repeats"), (F.size("spans") > 0).alias("repeated"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those whose remainder isn't 2."""
    return kneser_ney.score_texts(_table(spark, sf_dir, "documents"), _remainder(7) != 2).drop("perplexity")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark: words hit, items found."""
    out = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict of the line-frequency rules for every document."""
    out = line_rules.line_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words", "base_failed", "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, and what the archives then hold."""
    out = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes, copies together."""
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The contract's rules.
URL_RULES = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))


def symbol_pages(pages: DataFrame) -> DataFrame:
    """URLs of pages that are one twentieth symbols: what a crawl would put on its list."""
    html = F.coalesce("html", F.lit(""))
    return pages.filter(20 * (F.length(html) - F.length(F.translate(html, "#*$%", ""))) > F.length(html)).select("url")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all page URLs: rules, then the list of addresses under which some page is full of symbols."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, symbol_pages(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def tampered(docs: DataFrame) -> Column:
    """The text without newlines where 2 divides the id's CRC-32 and there are some, else null."""
    return F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents by source, each document's proof, and which of them still lead to the root after tampering."""
    docs = _table(spark, sf_dir, "documents")
    return merkle.verify(merkle.leaves_of(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered(docs)))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return tiered_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tiers")


OP5_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
same AS (SELECT body, max(page_id) AS first FROM p WHERE octet_length(body) >= 1000 GROUP BY body)
SELECT page_id, CAST(octet_length(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN same ON p.body = same.body
"""

OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t FROM docs),
lines AS (
  SELECT r, host, t, line, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]', '0', 'g') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
starts AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM starts) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS n_of FROM docs GROUP BY host),
often AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS c FROM lines GROUP BY host, norm) JOIN hosts USING (host)
  WHERE c > 10 AND 100 * c > 5 * n_of),
taken AS (SELECT r, count(*) AS nl, sum(n) AS nw FROM lines JOIN often USING (host, norm) GROUP BY r),
stats AS (
  SELECT r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM words),
every AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(nl, 0) AS BIGINT) AS n_removed_lines,
         CAST(coalesce(nw, 0) AS BIGINT) AS n_removed_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM docs JOIN stats USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN taken USING (r))
SELECT *, NOT base_failed AND 100 * n_removed_words <= 50 * n_words AS kept FROM every
"""


OP11_SQL = r"""
WITH parts AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
forms AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS short,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS kept FROM parts),
named AS (SELECT *, CASE WHEN short <> '' THEN short || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM forms),
listed AS (SELECT DISTINCT canonical FROM named WHERE canonical IS NOT NULL AND 20 * (length(html) - length(translate(html, '#*$%', ''))) > length(html)),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed USING (canonical)
"""


OP12_SQL = r"""
WITH RECURSIVE
step AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS c FROM step),
shown AS (
  SELECT doc_id, source, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda a, b: xor(a >> 8, crc.c[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS even,
         concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS front
  FROM documents, crc),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN even THEN sha256(front || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS changed
  FROM shown),
placed AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM leaves),
nodes AS (
  SELECT s, 0 AS level, i, leaf AS d, n FROM placed
  UNION ALL SELECT s, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY s, level, i // 3),
subs AS (SELECT s, level AS depth, d AS subroot, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, k AS i, subroot AS d, m AS n FROM subs
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3),
every AS (SELECT s, level, i, d, n FROM nodes WHERE n > 1 UNION ALL SELECT s, depth + level, i, d, n FROM (SELECT DISTINCT s, depth FROM subs), tops WHERE n > 1),
steps AS (
  SELECT r, doc_id, leaf, changed, s, 0 AS level, i AS spot FROM placed
  UNION ALL SELECT r, doc_id, leaf, changed, steps.s, level + 1, CASE WHEN level + 1 = depth THEN k ELSE spot // 3 END FROM steps JOIN subs USING (s)
  WHERE level + 1 < depth + (SELECT max(level) FROM tops)),
sides AS (
  SELECT r, steps.level, coalesce(string_agg(d, '' ORDER BY i) FILTER (i < spot), '') AS lo, coalesce(string_agg(d, '' ORDER BY i) FILTER (i > spot), '') AS hi
  FROM steps JOIN every ON steps.s = every.s AND steps.level = every.level AND every.i // 3 = spot // 3 GROUP BY r, steps.level),
proofs AS (SELECT r, list({'lo': lo, 'hi': hi} ORDER BY level) AS path FROM sides GROUP BY r),
folds AS (
  SELECT r, 1 AS spot, coalesce(changed, leaf) AS d FROM placed
  UNION ALL SELECT r, spot + 1, sha256(path[spot].lo || d || path[spot].hi) FROM folds JOIN proofs USING (r) WHERE spot <= len(path))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.lo || x.hi), ''), '')) AS proof_sha256, last.d AS folded_root, last.d = root AS verified
FROM placed JOIN subs USING (s) LEFT JOIN proofs USING (r) JOIN (SELECT r, arg_max(d, spot) AS d FROM folds GROUP BY r) last USING (r), (SELECT d AS root FROM tops WHERE n = 1)
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM items) GROUP BY q, t),
size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
parts AS (SELECT tf.r, doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(docs.w) * n) // l)) AS part FROM tf JOIN docs USING (r), size),
scores AS (SELECT q, r, doc_id, CAST(sum(times * w * part) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN parts USING (t) GROUP BY q, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_cnn, op3_chunk_dedup, op4_kneser_ney, op5_decontaminate, op6_minhash, op7_line_rules, op8_warc, op9_packing, op10_sharding, op11_url_filter, op12_merkle, op13_ranked_search)} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op7_line_rules": OP7_SQL, "op8_warc": OP8_SQL, "op11_url_filter": OP11_SQL, "op12_merkle": OP12_SQL, "op13_ranked_search": OP13_SQL}
