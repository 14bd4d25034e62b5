"""Text analytics: HTML to text, sections, chunks, lexicon sentiment, event tags, tone, risk sentences, number grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lexicons, event and risk patterns, tone terms, section headings, the form of amounts.
POSITIVE = ("beat", "beats", "raises", "raised", "growth", "outperform", "buyback", "upgrade", "upgraded", "strong", "record", "expands", "expansion", "surges", "rally", "profit", "gains", "exceeds", "accelerating")
NEGATIVE = ("miss", "misses", "missed", "cuts", "cut", "pressure", "downgrade", "downgraded", "weak", "softens", "softer", "decline", "declines", "restructuring", "lawsuit", "probe", "investigation", "slump", "plunge", "loss", "losses", "warns", "warning", "delays", "recall")
EVENTS = {
    "earnings": r"\b(beat|miss|earnings|guidance|outlook|eps|revenue)\b",
    "capital_return": r"\b(buyback|dividend|repurchase)\b",
    "leverage_credit": r"\b(leverage|debt|downgrade|credit rating|refinanc)\w*\b",
    "management_change": r"\b(names? new|appoints?|steps? down|resign|ceo|cfo)\b",
    "m_and_a": r"\b(acqui\w+|merger|takeover|divest\w*|spin-?off)\b",
    "legal_regulatory": r"\b(lawsuit|litigation|probe|investigation|antitrust|fine[sd]?|settle\w*)\b",
    "guidance_change": r"\b(raises?|cuts?|lowers?|lifts?)\s+(its\s+)?(full-?year\s+)?(guidance|outlook|forecast)\b",
}
RISKS = {
    "supply_chain": r"(?i)\b(supply chain|supplier|shortage|logistics|inventory)\b",
    "regulatory": r"(?i)\b(regulat\w+|complian\w+|antitrust|gdpr|sanction)\b",
    "competition": r"(?i)\b(competit\w+|market share|pricing pressure)\b",
    "cybersecurity": r"(?i)\b(cyber\w*|data breach|ransomware|information security)\b",
    "macro": r"(?i)\b(inflation|recession|interest rate|foreign exchange|currency)\b",
    "concentration": r"(?i)\b(concentrat\w+|single (customer|supplier)|depend\w+ on a (limited|small))\b",
    "litigation": r"(?i)\b(litigation|lawsuit|legal proceeding|claim)\b",
    "talent": r"(?i)\b(key personnel|attract and retain|talent|labor shortage)\b",
}
HEDGES = r"\b(may|might|could|possibly|potentially|uncertain\w*|approximately|roughly|we believe|we think|we expect|somewhat|to some extent|difficult to predict|challenging|headwind)\b"
CONFIDENT = r"\b(will|confident|strong|record|clearly|definitely|committed|robust|significant\w*|momentum|accelerat\w+)\b"
SECTIONS = (
    ("Item 1A - Risk Factors", r"item\s+1a\.?\s*[-:.]?\s*risk\s+factors"),
    ("Item 7A - Market Risk", r"item\s+7a\.?\s*[-:.]?\s*quantitative\s+and\s+qualitative"),
    ("Item 7 - MD&A", r"item\s+7\.?\s*[-:.]?\s*management.s\s+discussion"),
    ("Item 8 - Financial Statements", r"item\s+8\.?\s*[-:.]?\s*financial\s+statements"),
    ("Item 3 - Legal Proceedings", r"item\s+3\.?\s*[-:.]?\s*legal\s+proceedings"),
    ("Item 1 - Business", r"item\s+1\.?\s*[-:.]?\s*business"),
)
AMOUNT = r"(?<![\w.])(?:\$\s?)?-?\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s?(?:million|billion|trillion|bn|mm|%|x))?(?![\w])"
UNITS = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "million": 1e6, "mm": 1e6}
_BLOCKS = "p|div|tr|h[1-6]|li"
_LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"


def tokens(text: Column, pattern: str = r"[a-z0-9$%.\-]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def html_to_text(html: Column, most: int | None = None) -> Column:
    """Without scripts, styles and tags; ends of blocks become line ends; five entities are decoded; blanks are squeezed, and
    of blank lines in a row one stays, so that paragraphs can still be told apart.
    """
    t = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, rf"(?i)</(?:{_BLOCKS})>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t\u00a0]+", " "), r"\n{3,}", "\n\n")
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, _LINE_ENDS, "\n"), " ?\n ?", "\n"), F.lit(" \n"))
    return t if most is None else F.substring(t, 1, most)


def lexicon_scores(words: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> tuple[Column, Column]:
    """(score, confidence) from the different words that either list holds."""
    distinct = F.array_distinct(words)
    p, n = (F.size(F.array_intersect(distinct, F.array(*map(F.lit, s)))) for s in (positive, negative))
    return F.coalesce((p - n) / F.nullif(p + n, F.lit(0)), F.lit(0.0)), F.least((p + n) / F.lit(4.0), F.lit(1.0))


def event_tags(title: Column, events: dict[str, str] | None = None) -> Column:
    """Sorted names of the events whose pattern the title matches."""
    events = events or EVENTS
    return F.array_sort(F.array_compact(F.array(*[F.when(F.lower(title).rlike(p), F.lit(k)) for k, p in events.items()])))


def tone(text: Column, hedge: str = HEDGES, confident: str = CONFIDENT) -> tuple[Column, Column, Column]:
    """(words, hedges, confident words) of the text; words are runs of letters and apostrophes."""
    low = F.lower(text)
    return F.regexp_count(text, F.lit("[A-Za-z']+")), F.regexp_count(low, F.lit(hedge)), F.regexp_count(low, F.lit(confident))


def tone_rates(counted: DataFrame, least: int = 100) -> DataFrame:
    """counted (words, hedges, confident) with rates per thousand words, their balance and a status; null in short texts."""
    per = lambda n: F.when(F.col("words") >= least, 1000.0 * n / F.col("words"))
    rates = {"hedge_rate": per(F.col("hedges")), "confidence_rate": per(F.col("confident")), "tone_balance": per(F.col("confident") - F.col("hedges"))}
    return counted.withColumns(rates).withColumn("status", F.when(F.col("words") < least, "too_short").otherwise("ok"))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")


def risk_factors(docs: DataFrame, categories: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, category, n, example): sentences of 31 to 499 characters by category, and the first of each."""
    categories = categories or RISKS
    s = docs.select("doc_id", F.posexplode(sentences(F.col(text))).alias("pos", "sentence")).filter(F.length("sentence").between(31, 499))
    hit = F.array_compact(F.array(*[F.when(F.col("sentence").rlike(p), F.lit(k)) for k, p in categories.items()]))
    return s.select("doc_id", "pos", "sentence", F.explode(hit).alias("category")).groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.min_by("sentence", "pos").alias("example"))


def detect_section(text: Column, sections: tuple = SECTIONS, current: Column | None = None) -> Column:
    """The first section whose heading stands within the first eight characters of a long text's head, or is in a short one;
    else `current`.
    """
    head = F.lower(F.when(F.length(text) > 200, F.substring(text, 1, 120)).otherwise(text))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in sections:
        out = out.when(head.rlike(rf"^[\s\S]{{0,8}}?{pattern}"), name)
    return out if current is None else out.otherwise(current)


def tone_change(scored: DataFrame, band: float = 0.5) -> DataFrame:
    """scored (ticker, filing, tone_balance) with the change from the company's filing before and its direction."""
    w = Window.partitionBy("ticker").orderBy("filing")
    out = scored.withColumn("change", F.col("tone_balance") - F.lag("tone_balance").over(w))
    return out.withColumn("direction", F.when(F.col("change") > band, "more_confident").when(F.col("change") < -band, "more_hedged").when(F.col("change").isNotNull(), "unchanged"))


_BLANKS = " \t\n\r\x0b\x0c"


def chunk_documents(docs: DataFrame, size: int = 1200, overlap: int = 200, text: str = "text", sections: tuple = SECTIONS) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, text, section, char_count): paragraphs, which blank lines part, packed up to `size`
    characters; a chunk begins with the tail of the one before.

    A chunk's section is that of the last heading up to the paragraph that ended it. A fold over the paragraph array, row
    by row; a paragraph of over `size` characters is a chunk of its own. A null text has none.
    """
    strip = lambda c: F.btrim(c, F.lit(_BLANKS))
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), strip), lambda p: p != "")
    empty = F.lit(None).cast("string")
    chunk = lambda held, section: F.array(F.struct(strip(held).alias("text"), section.alias("section")))
    start = F.struct(F.lit("").alias("held"), empty.alias("section"), F.array().cast("array<struct<text:string,section:string>>").alias("done"))

    def add(a: Column, p: Column) -> Column:
        section = detect_section(p, sections, a["section"])
        full = (a["held"] != "") & (F.length(a["held"]) + F.length(p) > size)
        tail = F.when(F.length(a["held"]) > overlap, F.right(a["held"], F.lit(overlap))).otherwise(a["held"]) if overlap else F.lit("")
        held = F.when(full, strip(F.concat(tail, F.lit(" "), p))).when(a["held"] == "", p).otherwise(strip(F.concat(a["held"], F.lit("\n\n"), p)))
        return F.struct(held.alias("held"), section.alias("section"), F.when(full, F.concat(a["done"], chunk(a["held"], section))).otherwise(a["done"]).alias("done"))

    folded = F.aggregate(paragraphs, start, add, lambda a: F.when(strip(a["held"]) != "", F.concat(a["done"], chunk(a["held"], a["section"]))).otherwise(a["done"]))
    one = docs.select("doc_id", F.posexplode(folded).alias("chunk_index", "c"))
    return one.select("doc_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "c.text", "c.section", F.length("c.text").alias("char_count"))


def ingested(filings: DataFrame, least: int = 2000) -> DataFrame:
    """(content_hash, filing columns, text): filings (doc_id, html and others) as plain text, without those under `least`
    characters; of equal texts that with the least doc_id stays, as a repeated ingestion adds nothing.
    """
    plain = filings.withColumn("text", html_to_text(F.col("html"))).drop("html").filter(F.length("text") >= least)
    keyed = plain.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 32))
    first = keyed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return keyed.join(first, ["content_hash", "doc_id"], "left_semi")


def _canonical(token: Column) -> Column:
    """The value of an amount times its unit, as text that is equal for equal amounts: whole ones as integers, others to six
    figures, with the mark of a percentage or a multiple.
    """
    value = F.regexp_replace(token, r"[^0-9.\-]", "").try_cast("double")
    value = value * F.coalesce(*[F.when(F.endswith(token, F.lit(k)), F.lit(v)) for k, v in UNITS.items()], F.lit(1.0))
    mark = F.when(token.rlike("%$"), "%").when(token.rlike("x$"), "x").otherwise("")
    return F.concat(F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(F.format_string("%.5e", value)), mark)


def numbers(text: Column) -> Column:
    """The amounts of a text as an array of (token, value), value being the canonical form."""
    found = F.regexp_extract_all(F.lower(text), F.lit(AMOUNT), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.trim(x).alias("token"), _canonical(F.trim(x)).alias("value")))


def grounding(answer: Column, evidence: Column) -> Column:
    """Sorted amounts of the answer that the evidence doesn't hold in any spelling.

    Whole numbers under 13, with or without a mark, are no claims: they mostly count, or name quarters.
    """
    held = F.transform(numbers(evidence), lambda x: x["value"])
    claim = lambda x: ~x["value"].rlike(r"^-?(?:[0-9]|1[0-2])[%x]?$")
    loose = F.filter(numbers(answer), lambda x: claim(x) & ~F.array_contains(held, x["value"]))
    return F.array_sort(F.array_distinct(F.transform(loose, lambda x: x["token"])))


def evidence(hits: DataFrame, amount: str = AMOUNT, characters: int = 900, most: int = 10, text: str = "text") -> DataFrame:
    """hits with what an answer may quote, where no model writes one: the start of the text and the first `most` of its sorted amounts, which
    come from the whole text.
    """
    found = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(amount), F.lit(0)), lambda x: F.trim(x))
    return hits.withColumns({"numbers": F.slice(F.array_sort(F.array_distinct(found)), 1, most), text: F.substring(text, 1, characters)})


def citations(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([A-Za-z0-9_\-]+::\d+)\]"), F.lit(1)))


def verdict(cited: Column, valid: Column, ungrounded: Column) -> Column:
    """Ordered rules: a made-up citation, an amount without evidence, no citation, verified."""
    return F.when(F.size(F.array_except(cited, valid)) > 0, "fabricated").when(F.size(ungrounded) > 0, "ungrounded").when(F.size(cited) == 0, "uncited").otherwise("verified")
