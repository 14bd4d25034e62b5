"""URL filters with DataFrame functions only: rules by host and path, then a list of canonical URLs of any length.

The list becomes a blocked Bloom filter: a row of eight 32-bit words for each block, a key sets one bit in each word of its
block. URLs whose bits are all set go to an exact hash join with the list, which removes false positives; all others are
done without it. The filter is sixteen bits a key, so it is broadcast where the list itself would be too wide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, small, written

#: A block's words, the bits of one, and the bits that each key of the list gets.
WORDS, WORD_BITS, BITS_PER_KEY = 8, 32, 16
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, where the URL's path starts with this one."""

    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null and for URLs without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands between host and `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query of a URL: without scheme, `www.`, the ports 80 and 443, slashes at the path's end, tracking
    parameters and fragment. Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _bits(key: Column) -> list[Column]:
    """The key's bit in each word, from five bits of a second hash each."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftright(h, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """((_block, _w0 .. _w7), blocks) of n distinct keys."""
    blocks = max(1, -(-n * BITS_PER_KEY // (WORDS * WORD_BITS)))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1), bit)).alias(f"_w{i}") for i, bit in enumerate(_bits(F.col(key)))]
    return keys.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block")).agg(*words), blocks


def possible(rows: DataFrame, bloom: DataFrame, blocks: int, key: str) -> DataFrame:
    """rows with the column _possible: false only for keys (and nulls) that the filter doesn't hold."""
    joined = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).join(small(bloom), "_block", "left")
    held = reduce(lambda a, b: a & b, [F.call_function("shiftright", F.col(f"_w{i}"), bit).bitwiseAND(F.lit(1)) == 1 for i, bit in enumerate(_bits(F.col(key)))])
    return joined.withColumn("_possible", F.coalesce(held, F.lit(False)) & F.col(key).isNotNull()).drop("_block", *[f"_w{i}" for i in range(WORDS)])


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, else nulls. Of rules of one length the longer host wins,
    then a block. Rules are a policy that people write: they stand in the plan.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    pick = lambda of: reduce(lambda rest, r: F.when(fits(r), F.lit(of(r))).otherwise(rest), reversed(ranked), F.lit(None).cast("string"))
    return pick(lambda r: r.host + r.path), pick(lambda r: r.verdict)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url", page_id: str = "page_id", listed_url: str = "url") -> DataFrame:
    """A row for each row of pages: page_id, host, path, canonical, rule, listed (its canonical URL is), verdict: the rule's, else
    block for listed URLs and allow for others.

    Null URLs and those without a host have null canonical forms, are never listed and fit no rule. Repeated pages and ties get
    equal rows; repeated and null entries of the list count once and not at all. Very long URLs are read whole. Without a list no
    URL is listed; without pages there are no rows.
    """
    keys = written(listed.select(canonical_url(F.col(listed_url)).alias("_key")).filter("_key IS NOT NULL").distinct())
    bloom, blocks = bloom_filter(keys, "_key", keys.count())
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), canonical_url(u).alias("canonical"))
    judged = written(possible(rows, written(bloom), blocks, "canonical"))
    exact = small(keys)
    if exact is keys:
        exact = keys.hint("shuffle_hash")
    hits = judged.filter("_possible").join(exact.select(F.col("_key").alias("canonical"), F.lit(True).alias("listed")), "canonical", "left")
    columns = ["page_id", "host", "path", "canonical"]
    every = hits.select(*columns, F.coalesce("listed", F.lit(False)).alias("listed")).union(judged.filter("NOT _possible").select(*columns, F.lit(False)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return every.select(*columns, rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
