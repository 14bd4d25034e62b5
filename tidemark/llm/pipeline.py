"""A training corpus from raw documents: rules, near-duplicates, contamination, personal data, packing.

Each stage gets what its predecessor kept, as a Parquet table written to the shared folder, and returns the columns of
documents; the last returns the packed pieces. A stage joins verdicts on few of its rows to all of them by id and hash of
the text; texts are exchanged only where such a table is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_rules, minhash, packing, pii
from tidemark.llm.shared import doc_key, small, text_of, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines above the limits of their host.

    Null and empty texts have under fifty words and go. Repeated rows share a verdict. Long texts are read whole. No rows give none.
    """
    found = line_rules.line_rules(docs).filter("NOT kept OR size(removed) > 0")
    found = written(found.select("_d", "_h", "_host", F.col("kept").alias("_kept"), F.col("removed").alias("_removed")).dropDuplicates(["_d", "_h", "_host"]))
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host")
    kept = docs.select(*COLUMNS, *doc_key(docs, text_of("text")), host).join(small(found), ["_d", "_h", "_host"], "left").filter("coalesce(_kept, true)")
    new = F.when(F.size("_removed") > 0, line_rules.without_lines(F.col("text"), F.col("_removed"))).otherwise(F.col("text"))
    return kept.withColumn("text", new).withColumn("n_chars", F.when(F.size("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with its least id. Rows of it stay unless they repeat id and text; rows with a
    null id all stay. Null and empty texts are linked with nothing and stay, as do ties: of equal texts the least id remains.
    """
    dropped = written(minhash.near_duplicates(docs).filter("NOT kept").select("doc_id").distinct())
    kept = docs.select(*COLUMNS).join(small(dropped), "doc_id", "left_anti").select(*COLUMNS)
    keyed = kept.select(*COLUMNS, *doc_key(kept, text_of("text")))
    repeated = written(keyed.filter("doc_id IS NOT NULL").groupBy("_d", "_h").agg(F.count("*").alias("n")).filter("n > 1").select("_d", "_h"))
    if repeated.isEmpty():
        return kept
    once = keyed.filter("doc_id IS NOT NULL").join(small(repeated), ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"])
    others = keyed.filter("doc_id IS NOT NULL").join(small(repeated), ["_d", "_h"], "left_anti")
    return once.select(*COLUMNS).union(others.select(*COLUMNS)).union(kept.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; repeated rows share a verdict; long texts are
    read whole. No documents give none, and without items all stay.
    """
    hit = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select("_d", "_h").distinct()
    return docs.select(*COLUMNS, *doc_key(docs, text_of("text"))).join(small(written(hit)), ["_d", "_h"], "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each span of personal data; spans that overlap get one. Null texts stay null, empty ones
    empty; repeated rows stay; the work grows with a text's length and spans, not with their product.
    """
    found = pii.find_pii(docs, [F.col(c) for c in COLUMNS])
    new = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", new).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. Null and empty texts are one token; repeated rows are packed each;
    only documents of more tokens are cut. No rows give none.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate components and packed places are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
