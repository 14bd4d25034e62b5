import pytest
from pyspark.sql import functions as F

#: Null ids and texts, empty and blank texts, repeated rows, ties, a long text, and columns that clash with results.
ODD = [
    (1, None, "en", "a", 0, "x"),
    (2, "", None, None, 0, "x"),
    (3, " \t\n ", "en", "a", None, None),
    (None, "one two three four five six seven", "en", "a", 1, "y"),
    (None, None, None, None, None, None),
    (5, "mail bob.x@mail.example.com now\nor +1 (415) 555-2671 or 10.0.0.255", "en", "b", 1, "y"),
    (6, "mail bob.x@mail.example.com now\nor +1 (415) 555-2671 or 10.0.0.255", "en", "b", 1, "y"),
    (6, "mail bob.x@mail.example.com now\nor +1 (415) 555-2671 or 10.0.0.255", "en", "b", 1, "y"),
    (7, "Ä É ñ ß 漢字 🙂 word", "de", "b", 2, "z"),
    (8, "long " * 30_000, "en", "c", 3, "z"),
    (9, "1" * 40_000, "en", "c", 3, "z"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return df.withColumns({c: F.lit("clash") for c in ("_d", "_h", "_t", "_k", "_w", "t", "rep", "spans", "n_words", "component_id", "size", "shard", "piece", "length", "score", "held_out", "hits", "_host", "_rows")})


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
