"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

A window is ten consecutive words of a benchmark item (all its words, if fewer). Documents are split over the executors;
their tokens become postings (term, document, position), kept for those terms that some window looks up. Of each window
the two rarest terms in the corpus are looked up: both lists, shifted by the terms' places in the item, meet where
document and shifted position agree. What meets is compared word for word with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, doc_key, small, text_of, words_between, written

WINDOW = 10
#: Two rare terms of a window that stand within so many words of their places count as a proximity match.
SLOP = 4
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def index_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text in which A-Z are lower-cased."""
    return words_between(ascii_lower(text), _NO_WORD)


def benchmark_windows(bench: DataFrame, text: str, item_id: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, places, windows): items(_item, item_id), a row (_item, _len, _q place, _term) for each of their words, and a
    row (_item, _s start, _n length, _w words) for each of their windows. All rows are narrow, however long an item is.
    """
    words = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), index_words(text_of(text)).alias("_b"))
    # Two rows that share an id and a text are one item, and so have one number.
    whole = written(words.filter(F.size("_b") > 0).distinct().select(F.xxhash64("item_id", "_b").alias("_item"), "item_id", "_b"))
    n = F.least(F.lit(window), F.size("_b"))
    slices = F.transform(F.sequence(F.lit(0), F.size("_b") - n), lambda s: F.slice("_b", s + 1, n))
    windows = whole.select("_item", n.alias("_n"), F.posexplode(slices).alias("_s", "_w"))
    return whole.select("_item", "item_id"), whole.select("_item", F.size("_b").alias("_len"), F.posexplode("_b").alias("_q", "_term")), windows


def _term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    tokens = docs.select(F.explode(index_words(text_of(text))).alias("_term"))
    return terms.join(tokens.join(small(terms), "_term").groupBy("_term").agg(F.count("*").alias("_cf")), "_term", "left").select("_term", F.coalesce("_cf", F.lit(0)).alias("_cf"))


def rarest_places(places: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(_item, _s, _q1, _q2): for each window of an item the places of its rarest two terms (of its only one, twice).

    Ties go to the leftmost place, so that neighbouring windows mostly look up the same two terms.
    """
    ranked = places.join(small(counts), "_term").withColumn("_r", F.struct("_cf", "_q"))
    # A window that starts at s holds the places s to s + n - 1: each place goes to all windows that hold it.
    n = F.least(F.lit(window), F.col("_len"))
    spread = ranked.select("_item", "_r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_q") - n + 1), F.least(F.col("_q"), F.col("_len") - n))).alias("_s"))
    two = spread.groupBy("_item", "_s").agg(F.slice(F.sort_array(F.collect_list("_r")), 1, 2).alias("_two"))
    return two.select("_item", "_s", F.col("_two")[0]["_q"].alias("_q1"), F.element_at("_two", -1)["_q"].alias("_q2"))


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Stored postings (_term, _d, _h, _p) of the given terms over all documents."""
    tokens = docs.select(*doc_key(docs, text_of(text)), F.posexplode(index_words(text_of(text))).alias("_p", "_term"))
    return written(tokens.join(small(terms), "_term").select("_term", "_d", "_h", "_p"))


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", item_id: str = "item_id", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items and items
    (sorted ids of the items that occur), n_near (items with a proximity match), hits (array of start, end), contaminated.

    Null texts have no words; an item without words has no window; a null item_id is the id ''. Repeated documents get
    equal rows. Without items or documents no document is contaminated.
    """
    items, places, words = benchmark_windows(bench, bench_text, item_id, window)
    counts = written(_term_counts(docs, text, places.select("_term").distinct()))
    windows = written(rarest_places(places, counts, window))
    looked_up = windows.select("_item", F.explode(F.array("_q1", "_q2")).alias("_q")).distinct()
    anchors = written(places.join(looked_up, ["_item", "_q"], "left_semi").select("_term", "_item", "_q"))
    postings = build_index(docs, anchors.select("_term").distinct(), text)

    # Lists shifted by the place in the item; a bucket is twice as wide as its step, so two shifts within SLOP share one.
    step = slop + 1
    shifted = postings.join(small(anchors), "_term").select("_d", "_h", "_item", "_q", (F.col("_p") - F.col("_q")).alias("_at"))
    bucket = F.floor(F.col("_at") / step)
    met = shifted.select("*", F.explode(F.array(bucket, bucket - 1)).alias("_bucket")).groupBy("_d", "_h", "_item", "_bucket").agg(F.collect_set(F.struct(F.col("_q").alias("q"), F.col("_at").alias("at"))).alias("_hits"))
    lone = windows.filter("_q1 = _q2").select("_item", F.lit(True).alias("_lone")).distinct()
    met = met.join(small(lone), "_item", "left").filter(F.coalesce("_lone", F.lit(False)) | (F.size(F.array_distinct(F.transform("_hits", lambda h: h["q"]))) > 1))
    hits = written(met.select("_d", "_h", "_item", "_bucket", F.explode("_hits").alias("x")).select("_d", "_h", "_item", "_bucket", F.col("x.q").alias("_q1"), F.col("x.at").alias("_at")))

    # A list meets its windows' other list by equal keys, so the steps are as many as hits, not hits times windows.
    pairs = written(windows.select("_item", "_q1", "_q2").distinct())
    other = hits.select("_d", "_h", "_item", "_bucket", F.col("_q1").alias("_q2"), F.col("_at").alias("_at2"))
    both = hits.join(small(pairs), ["_item", "_q1"]).join(other, ["_d", "_h", "_item", "_bucket", "_q2"]).filter(F.abs(F.col("_at") - F.col("_at2")) <= slop)
    found = written(both.select("_d", "_h", "_item", "_q1", "_q2", F.when(F.col("_at") == F.col("_at2"), F.col("_at")).alias("_at")).distinct())

    # The two rarest terms agree; now the whole window must. A document's candidates travel with its text once.
    near = found.groupBy("_d", "_h").agg(F.count_distinct("_item").alias("n_near"))
    of = written(windows.join(words, ["_item", "_s"]))
    exact = found.filter("_at IS NOT NULL").join(small(of), ["_item", "_q1", "_q2"])
    asked = exact.select("_d", "_h", F.struct("_item", (F.col("_at") + F.col("_s")).alias("p"), F.col("_w").alias("b")).alias("_a"))
    asked = written(asked.groupBy("_d", "_h").agg(F.collect_list("_a").alias("_asked")))
    t = text_of(text)
    read = docs.select(*doc_key(docs, t), t.alias("_t")).join(small(asked.select("_d", "_h")), ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"])
    read = read.join(asked, ["_d", "_h"]).select("_d", "_h", index_words(F.col("_t")).alias("_words"), "_asked")
    # Two uses of _words in one projection, and no filter on the outcome before it is written, keep the optimizer from
    # moving the split of the text into the comparison of each candidate.
    fits = lambda a: (a["p"] >= 0) & (a["p"] + F.size(a["b"]) <= F.size("_words"))
    true = read.select("_d", "_h", F.filter("_asked", lambda a: fits(a) & (F.slice(F.col("_words"), F.greatest(a["p"], F.lit(0)) + 1, F.size(a["b"])) == a["b"])).alias("_true"))
    true = written(true).filter(F.size("_true") > 0)
    spans = F.sort_array(F.array_distinct(F.transform("_true", lambda a: F.struct(a["p"].alias("start"), (a["p"] + F.size(a["b"])).alias("end")))))
    per_item = true.select("_d", "_h", F.explode(F.array_distinct(F.transform("_true", lambda a: a["_item"]))).alias("_item")).join(small(items.select("_item", "item_id")), "_item")
    per_item = per_item.groupBy("_d", "_h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    hit = true.select("_d", "_h", spans.alias("hits")).withColumn("n_hit", covered).join(per_item, ["_d", "_h"])

    out = docs.select("doc_id", *doc_key(docs, t), F.size(index_words(t)).cast("long").alias("n_words"))
    out = out.join(hit.join(near, ["_d", "_h"], "full"), ["_d", "_h"], "left")
    return out.select(
        "doc_id", "_d", "_h", "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
    ).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
