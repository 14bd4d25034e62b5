import re

from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators import corpus, text
from tidemark.storage import shared_dir

SCHEMA = "doc_id long, text string, lang string"


def answers(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.status, r.held_by) for r in df.collect())


def test_each_text_is_taken_once(spark):
    c = corpus.Corpus(spark, shared_dir(spark), buckets=4, blocks=64)
    first = spark.createDataFrame([(5, "a", "x"), (3, "b", "x"), (4, "b", "x"), (7, None, "x"), (8, "", "x")], SCHEMA)
    assert c.documents() is None and answers(c.ingest(first)) == [(3, "ingested", None), (4, "repeated", 3), (5, "ingested", None), (7, "ingested", None), (8, "repeated", 7)]
    assert sorted(r.doc_id for r in c.documents().collect()) == [3, 5, 7]
    assert answers(c.ingest(first)) == [(3, "already_ingested", 3), (4, "already_ingested", 3), (5, "already_ingested", 5), (7, "already_ingested", 7), (8, "already_ingested", 7)]
    assert c.documents().count() == 3 and len(c.batches()) == 1  # a second ingestion adds nothing
    more = spark.createDataFrame([(1, "a", "y"), (9, "c", "y"), (9, "c", "y"), (2, "d", "y")], SCHEMA)
    assert answers(c.ingest(more)) == [(1, "already_ingested", 5), (2, "ingested", None), (9, "ingested", None), (9, "ingested", None)]
    assert sorted((r.doc_id, r.text) for r in c.documents().collect()) == [(2, "d"), (3, "b"), (5, "a"), (7, None), (9, "c")] and len(c.batches()) == 2
    assert c.ingest(more.filter("false")).count() == 0 and len(c.batches()) == 2


def test_many_texts_and_a_full_filter(spark):
    """A filter of one block lets everything pass: more is looked up, nothing is taken twice."""
    for blocks in (1, 4096):
        c = corpus.Corpus(spark, shared_dir(spark), buckets=8, blocks=blocks)
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"), F.lit("x").alias("lang"))
        c.ingest(docs.filter("doc_id < 1000"))
        got = {r["status"]: r["count"] for r in c.ingest(docs).groupBy("status").count().collect()}
        assert got == {"already_ingested": 2000, "ingested": 1000} and c.documents().count() == 2000


def test_the_index_is_not_exchanged(spark):
    c = corpus.Corpus(spark, shared_dir(spark))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("x").alias("lang"))
    c.ingest(docs)
    asked = spark.createDataFrame([(F"{i:032d}", i % 3) for i in range(9)], "content_hash string, bucket int")
    plan = c._known(asked)._jdf.queryExecution().executedPlan().toString()
    index_side = re.split("BroadcastExchange", plan)[0]  # what follows is the side that is broadcast
    assert "BroadcastHashJoin" in plan and "corpus_batch" in index_side and not re.search(r"Exchange|SortMergeJoin", index_side) and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_an_ingestion_that_broke_off_leaves_nothing(spark, monkeypatch):
    c = corpus.Corpus(spark, shared_dir(spark))
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], SCHEMA)
    whole = bloom.filter_of
    monkeypatch.setattr(bloom, "filter_of", lambda *a: 1 / 0)
    try:
        c.ingest(docs)
    except ZeroDivisionError:
        pass
    assert c.batches() == [] and c.documents() is None
    monkeypatch.setattr(bloom, "filter_of", whole)
    assert answers(c.ingest(docs)) == [(1, "ingested", None), (2, "ingested", None)] and c.documents().count() == 2


def test_filters_hold_their_keys(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    parts = bloom.filter_of(keys.filter("k < '5'"), "k", 200).union(bloom.filter_of(keys.filter("k >= '5'"), "k", 200))
    asked = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") < 2000).alias("held"))
    got = {r["held"]: r["p"] for r in bloom.may_hold(asked, bloom.together(parts), "k", 200).groupBy("held").agg(F.avg(F.col("possible").cast("int")).alias("p")).collect()}
    assert got[True] == 1.0 and got[False] < 0.01


def test_evidence_quotes_the_start_and_all_amounts(spark):
    long = "$1,000 " + "x" * 2000 + " $2,500,000.50 and $1,000"
    rows = spark.createDataFrame([(1, long), (2, None), (3, "none")], "doc_id long, text string")
    got = text.evidence(rows, r"\$\d{1,3}(?:,\d{3})+(?:\.\d+)?").orderBy("doc_id").collect()
    assert len(got[0].text) == 900 and got[0].numbers == ["$1,000", "$2,500,000.50"] and got[1].numbers is None and got[2].numbers == []
