"""Quality rules over lines that many documents of a host share, with per-document text statistics.

Only DataFrame functions. Text never crosses a shuffle: what is exchanged are 64-bit hashes of hosts' lines and
a few numbers a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import doc_key, small, space_words, text_of, written

MIN_HOST_DOCS = 10
MAX_HOST_PERCENT = 5
MAX_REMOVED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
_A_WORD = r"[^\x20\x09-\x0D]"


def normal_line(line: Column) -> Column:
    """Lines that differ only in case, white space at the ends or between words, or digits count as one."""
    line = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")
    return F.regexp_replace(F.trim(line), "[0-9]", "0")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(_A_WORD))


def text_statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Row by row, without a shuffle: `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    n_repeat_words counts the words inside three-word windows that occur twice or more in the text: windows are hashed,
    sorted with their positions, and equal neighbours mark their positions, so that it takes n log n steps.
    """
    t = text_of(text)
    words = docs.select(*keep, t.alias("_t"), space_words(t).alias("_w"))
    hashed = words.select(
        "*",
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines(F.col("_t")).alias("_l"),
    ).drop("_w", "_t")
    n = F.size("_wh")
    windows = hashed.withColumns(
        {
            "_n3": F.when(
                n >= 3, F.transform(F.slice("_wh", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_wh", i + 1), F.get("_wh", i + 2)))
            ).otherwise(F.array().cast("array<long>")),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    ).drop("_wh", "_l")
    ordered = windows.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_n3")) < F.size("_n3"), F.sort_array(F.transform("_n3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    ).drop("_n3")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("_s", i)["h"] == x["h"], F.lit(False))

    starts = ordered.withColumn(
        "_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False)) | same(x, i + 1)), lambda x: x["i"]))
    ).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return starts.withColumn("n_repeat_words", covered).drop("_p")


def host_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """A row for each document and distinct normalised line: key, host, line hash, words of all its occurrences."""
    t = text_of(text)
    one = docs.select(*doc_key(docs, t), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.explode(_lines(t)).alias("_line"))
    return one.select("_d", "_h", "_host", F.xxhash64(normal_line(F.col("_line"))).alias("_lh"), F.size(space_words(F.col("_line"))).alias("_n"))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_HOST_DOCS, max_percent: int = MAX_HOST_PERCENT) -> DataFrame:
    """(host, line hash, documents) of lines in more than `min_docs` and more than `max_percent` % of a host's documents.

    Exact copies count as one document, so that a much copied text doesn't make its own lines look like boilerplate.
    """
    t = text_of(text)
    who = [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.xxhash64(t).alias("_h")]
    in_doc = docs.select(*who, F.explode(F.array_distinct(F.transform(_lines(t), lambda x: F.xxhash64(normal_line(x))))).alias("_lh"))
    # distinct() spreads a line that every document has over all partitions; the count after it is pre-aggregated.
    counts = in_doc.distinct().groupBy("_host", "_lh").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > min_docs)
    hosts = docs.select(*who).distinct().groupBy("_host").agg(F.count("*").alias("_of"))
    return counts.join(hosts, "_host").filter(100 * F.col("_docs") > max_percent * F.col("_of")).select("_host", "_lh", "_docs")


def line_rules(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_HOST_DOCS, max_percent: int = MAX_HOST_PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, _d, _h, the text statistics, base_failed, n_removed_lines, n_removed_words,
    removed (hashes of the lines to take out), kept.

    A document is rejected if base_failed (under 50 words, or over half of its words in repeated three-word windows), or
    depleted: over MAX_REMOVED_PERCENT of its words stand in lines above the limits of its host.
    Null texts are empty and fail; a null host is the host ''. Repeated rows are kept and get the same verdict. An empty
    table gives an empty one.
    """
    t = text_of(text)
    # Written, as a filter on the verdict would otherwise be pushed through the nested array expressions and copy them.
    stats = written(text_statistics(docs, [F.col("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), *doc_key(docs, t)], text))
    found = small(written(frequent_lines(docs, text, host, min_docs, max_percent)))
    # Repeated rows repeat their lines here, so a line counts once for each occurrence in one row.
    hits = host_lines(docs, text, host).join(found.select("_host", "_lh"), ["_host", "_lh"])
    copies = docs.select(*doc_key(docs, t), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    per_doc = hits.groupBy("_host", "_d", "_h").agg(F.count("*").alias("_nl"), F.sum("_n").alias("_nw"), F.collect_set("_lh").alias("removed"))
    repeats = copies.groupBy("_host", "_d", "_h").agg(F.count("*").alias("_rows")).filter("_rows > 1")
    per_doc = per_doc.join(repeats, ["_host", "_d", "_h"], "left").withColumn("_rows", F.coalesce("_rows", F.lit(1)))
    per_doc = per_doc.select("_host", "_d", "_h", (F.col("_nl") / F.col("_rows")).cast("long").alias("n_removed_lines"), (F.col("_nw") / F.col("_rows")).cast("long").alias("n_removed_words"), "removed")
    out = stats.join(per_doc, ["_host", "_d", "_h"], "left").withColumns(
        {
            "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)),
            "n_removed_words": F.coalesce("n_removed_words", F.lit(0)),
            "removed": F.coalesce("removed", F.array().cast("array<long>")),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed_words") <= MAX_REMOVED_PERCENT * F.col("n_words")))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in `removed`."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x)))), "\n")
