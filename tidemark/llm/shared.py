"""What the operators of this subpackage share: texts, keys of documents, word splitting, and the storage helpers.

Every operator keeps repeated rows, reads only the columns that it names (so other columns may have any name)
and treats a null text as an empty one unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import shared_dir, small, written  # noqa: F401  the operators take them from here

#: The white space that separates words: the space and the five ASCII controls \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def doc_key(docs: DataFrame, text: Column, doc_id: str = "doc_id") -> list[Column]:
    """Two columns that are equal only for equal texts, so that per-document results can be joined back.

    They stand for the document where ids are null or repeated: what is derived from the text alone is the same for both.
    """
    return [F.coalesce(F.col(doc_id), F.lit(-1)).cast("long").alias("_d"), F.xxhash64(text).alias("_h")]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII texts take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_between(text: Column, separators: str, strip: str | None = None) -> Column:
    """The non-empty pieces between matches of `separators`, as an array."""
    if strip is not None:
        text = F.btrim(text, F.lit(strip))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, separators))
    return F.array_remove(F.split(text, separators), "")


def space_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return words_between(text, SPACE, _SPACES)


#: Steps of a scan whose results are gathered before they join the others.
_BLOCK = 256


def let(x: Column, use) -> Column:
    """use(x), with x computed once: as an element of an array it isn't copied into each of its uses."""
    return F.transform(F.array(x), use)[0]


def scan(n: Column, state: Column, kind: str, step) -> Column:
    """The results of step(state, i) -> (new state, array of results) for i from 0 to n - 1, as one array<kind>.

    Appending to an array copies it, so results gather in blocks: n steps copy about n * (_BLOCK / 2 + n / _BLOCK ** 2 / 2)
    references, next to nothing against the work of a step for any text that fits in a row.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(a: Column, i: Column) -> Column:
        new, out = step(a["state"], i)
        return F.struct(new.alias("state"), F.concat(a["out"], out).alias("out"))

    def block(a: Column, b: Column) -> Column:
        own = F.sequence(b, F.least(b + _BLOCK, n) - 1)
        inner = F.aggregate(own, F.struct(a["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)), start, block, lambda a: F.flatten(a["out"]))).otherwise(none)
