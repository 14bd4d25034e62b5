import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter
from tidemark.llm.queries import URL_RULES, op11_url_filter, symbol_pages

RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def plain_parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = re.match(r"[^?#]*\?([^#]*)", rest, re.S)
    kept = "&".join(sorted(p for p in (query[1] if query else "").split("&") if p and not re.search(url_filter.TRACKING, p)))
    short = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", lower))
    return lower, path, short + path.rstrip("/") + (f"?{kept}" if kept else "") if short else None


def plain(urls, listed, rules):
    keys = {plain_parts(u)[2] for u in listed} - {None}
    out = []
    for u in urls:
        host, path, canonical = plain_parts(u)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        out.append((host, path, canonical, best and best.host + best.path, canonical in keys, best.verdict if best else "block" if canonical in keys else "allow"))
    return out


ODD = [
    None, "", "no scheme/net/", "://", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net/En/1", "https://a.b.example.net", "https://net/", "http://notexample.net/en/",
    "http://xexample.com/de/", "http://example.com/de/x?utm_source=a", "https://www.example.com:443/q//?b=2&a=1&utm_x=3#top", "http://example.com/q?a=1&b=2", "http://example.com/q?a=1&b=2&ref=y",
    "http://a.org/fr/1", "http://org/fr", "http://É.org/x", "x://y?z://w/", "http://long.org/" + "a/" * 40_000, "http://" + "s." * 3_000 + "org/fr/", "http://example.com/q?a=1&b=2",
]


def test_odd_urls(spark):
    listed = ["http://example.com/q/?b=2&a=1", None, "bad", "https://É.org/x", "https://É.org/x/", "http://a.org/fr/1/"]
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "canonical", "rule", "listed", "verdict", "_key", "_block", "_possible", "_w0")})
    got = sorted(url_filter.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "url string"), RULES).collect())
    assert [tuple(r)[1:] for r in got] == plain(ODD, listed, RULES)
    assert URL_RULES == tuple(RULES)


@pytest.mark.parametrize("n", [0, 1, 3_000])
def test_filter_lets_no_listed_url_go(spark, n):
    keys = spark.range(n).select(F.concat(F.lit("h.org/"), "id").alias("k"))
    bloom, blocks = url_filter.bloom_filter(keys, "k", n)
    asked = spark.range(20_000).select(F.concat(F.lit("h.org/"), "id").alias("k"), (F.col("id") < n).alias("true"))
    counts = {r["true"]: (r["p"], r["n"]) for r in url_filter.possible(asked, bloom, blocks, "k").groupBy("true").agg(F.sum(F.col("_possible").cast("int")).alias("p"), F.count("*").alias("n")).collect()}
    assert counts.get(True, (0, 0)) == (n, n)
    assert counts[False][0] <= 0.01 * counts[False][1]


def test_false_positives_go_in_the_join(spark, monkeypatch):
    """A filter of one block lets nearly everything pass, and a list that may not be broadcast is joined by hash: same rows."""
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 0)
    monkeypatch.setattr(url_filter, "small", lambda df: df)
    urls = [f"http://h{i % 7}.org/{i % 50}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(url_filter.filter_urls(pages, spark.createDataFrame([(u,) for u in urls[:120]], "url string")).collect())
    assert [tuple(r)[1:] for r in got] == plain(urls, urls[:120], [])


def test_query_is_native_and_whole(spark, sf_dir):
    out = op11_url_filter(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = sorted(pages.select("page_id", "url").collect())
    listed = [r.url for r in symbol_pages(pages).collect()]
    expected = plain([r.url for r in rows], listed, RULES)
    assert listed and [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in sorted(out.collect())] == [(r.page_id, e[0], e[1], e[3], e[5]) for r, e in zip(rows, expected, strict=True)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, none, RULES).count() == 0
