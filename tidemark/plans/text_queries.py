"""Queries of text analytics and retrieval. The supplied prose is invented, so terms are words that it holds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.operators import corpus, retrieval, text
from tidemark.plans.ctes import r6, rounded
from tidemark.plans.registry import query
from tidemark.sources import market
from tidemark.storage import shared_dir, written

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9$%.\\-]+')"
TERMS = ["license", "work", "under", "the", "the"]
POS, NEG = ("the", "and", "license", "of"), ("un", "der", "que", "la")
TAGS = {"clicked": "click", "bought": "purch", "joined": "sign", "seen": "view|click"}
HEDGE, SURE = r"\s(?:un|der|en)\s", r"\s(?:the|and|la)\s"


def _docs(spark, d):
    return market.table(spark, d, "documents")


_HTML = r"""ha AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g') AS t FROM pages),
hb AS (SELECT page_id, regexp_replace(t, '(?i)</(?:p|div|tr|h[1-6]|li)>', chr(10), 'g') AS t FROM ha),
hc AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM hb),
hd AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\x{00A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM hc),
plain AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]', chr(10), 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)) AS text FROM hd)"""


@query(f"WITH {_HTML} SELECT page_id, text FROM plain")
def html_to_text(spark, d):
    return market.table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT chunk_id, CAST(dl AS INTEGER) AS dl, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) GROUP BY ALL")
def tokenize_tf(spark, d):
    return retrieval.term_frequencies(market.chunks(spark, d))


def _bm25_sql(where: str = "TRUE") -> str:
    q = ", ".join(f"('{t}', {TERMS.count(t)})" for t in sorted(set(TERMS)))
    return f"""qt(term, times) AS (VALUES {q}), tk AS (SELECT doc_id AS chunk_id, {_TOKENS} AS w FROM documents WHERE {where}),
cs AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT chunk_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), cs GROUP BY chunk_id)"""


@query(f"WITH {_bm25_sql()} SELECT chunk_id, round(score, 6) + 0.0::DOUBLE AS score FROM bm")
def bm25(spark, d):
    return rounded(retrieval.bm25(market.chunks(spark, d), TERMS))


QUERY_VECTOR = [((i * 7) % 11 - 5) / 10 for i in range(64)]
_QV = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_COS = f"cs0 AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), co AS (SELECT chunk_id, list_dot_product(e, {_QV}) / nullif(sqrt(list_dot_product(e, e)) * {sum(x * x for x in QUERY_VECTOR) ** 0.5!r}::DOUBLE, 0) AS score FROM cs0)"


def _vectors(spark, d):
    return market.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query(f"WITH {_COS} SELECT chunk_id, round(score, 6) + 0.0::DOUBLE AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM co) WHERE place <= 50")
def dense_topk(spark, d):
    return rounded(retrieval.top(retrieval.cosine(_vectors(spark, d), QUERY_VECTOR), 50))


_FUSED = """d50 AS (SELECT chunk_id, place FROM (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM co{semi}) WHERE place <= 50),
l50 AS (SELECT chunk_id, place FROM (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM bm) WHERE place <= 50),
fu AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + place)) AS score FROM (SELECT * FROM d50 UNION ALL SELECT * FROM l50) GROUP BY chunk_id)"""


@query(f"WITH {_COS}, {_bm25_sql()}, {_FUSED.format(semi='')} SELECT chunk_id, round(score, 9) + 0.0::DOUBLE AS score FROM fu")
def rrf_fusion(spark, d):
    c = market.chunks(spark, d)
    return rounded(retrieval.fuse(retrieval.top(retrieval.cosine(_vectors(spark, d), QUERY_VECTOR), 50), retrieval.top(retrieval.bm25(c, TERMS), 50)), 9)


@query(f"WITH {_COS}, {_bm25_sql(chr(39).join(['lang = ', 'en', '']))}, {_FUSED.format(semi=' WHERE chunk_id IN (SELECT chunk_id FROM tk)')} SELECT chunk_id, round(score, 9) + 0.0::DOUBLE AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, chunk_id) AS place FROM fu) WHERE place <= 10")
def hybrid_search(spark, d):
    """A hard filter on the language, then both lists fused."""
    return rounded(retrieval.search(market.chunks(spark, d), _vectors(spark, d), TERMS, QUERY_VECTOR, F.col("doc_type") == "en", 10), 9)


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3' AND n_chars BETWEEN 500 AND 5000")
def doc_filter(spark, d):
    """Hard metadata filters, pushed to the scan."""
    return _docs(spark, d).filter(F.col("lang").isin("de", "fr") & (F.col("source") == "src3") & F.col("n_chars").between(500, 5000)).select("doc_id", "lang", "source")


@query("SELECT h, doc_id FROM (SELECT substring(sha256(text), 1, 32) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def dedupe_by_hash(spark, d):
    """The first document of each content hash."""
    return _docs(spark, d).groupBy(F.substring(F.sha2("text", 256), 1, 32).alias("h")).agg(F.min("doc_id").alias("doc_id"))


_EACH = f"""qs AS (SELECT item_id AS query, substring(text, 1, 60) AS expected FROM benchmark), qw AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({_TOKENS.replace('text', 'expected')}) AS term FROM qs) GROUP BY ALL),
tk AS (SELECT doc_id AS chunk_id, {_TOKENS} AS w FROM documents), cs AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tk) WHERE term IN (SELECT term FROM qw) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query, chunk_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score FROM tf JOIN df USING (term) JOIN qw USING (term), cs GROUP BY query, chunk_id),
rk AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk_id) AS place FROM sc),
hit AS (SELECT query, min(place) AS place FROM rk JOIN qs USING (query) JOIN documents d ON d.doc_id = chunk_id AND contains(lower(d.text), lower(expected)) WHERE place <= 6 GROUP BY query)"""


def _evaluated(spark, d, k, expected=None):
    expected = F.substring("text", 1, 60) if expected is None else expected
    wanted = market.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), expected.alias("expected"))
    chunks = market.chunks(spark, d)
    ranked = retrieval.best_each(chunks, wanted.select("query", F.col("expected").alias("text")), k)
    return rounded(retrieval.evaluate(ranked, chunks, wanted))


@query(f"WITH {_EACH} SELECT count(*) AS queries, round(avg(CASE WHEN place IS NULL THEN 0 ELSE 1 END), 6) + 0.0::DOUBLE AS hit_rate, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) + 0.0::DOUBLE AS mrr FROM qs LEFT JOIN hit USING (query)")
def retrieval_eval(spark, d):
    """Hit rate and mean reciprocal rank of the six best, for the starts of all benchmark items. There is no model that would
    embed an item, so the engine's search is lexical here, as it is wherever vectors are missing.
    """
    return _evaluated(spark, d, 6)


@query("WITH " + _EACH.replace("substring(text, 1, 60) AS expected", "text AS expected") + " SELECT count(*) AS queries, round(avg(CASE WHEN place IS NULL THEN 0 ELSE 1 END), 6) + 0.0::DOUBLE AS hit_rate, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) + 0.0::DOUBLE AS mrr FROM qs LEFT JOIN hit USING (query)")
def retrieval_eval_whole(spark, d):
    """The same for the whole texts of all benchmark items: is a document that holds the passage among the six best?"""
    return _evaluated(spark, d, 6, F.col("text"))


@query()
def retrieval_eval_all(spark, d):
    """The same of the ten best."""
    return _evaluated(spark, d, 10)


@query(f"""WITH w AS (SELECT doc_id, list_distinct({_TOKENS}) AS w FROM documents), c AS (SELECT doc_id, len(list_intersect(w, {list(POS)})) AS p, len(list_intersect(w, {list(NEG)})) AS n FROM w)
SELECT doc_id, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) + 0.0::DOUBLE AS score, round(least((p + n) / 4.0::DOUBLE, 1.0::DOUBLE), 6) + 0.0::DOUBLE AS confidence FROM c""")
def lexicon_sentiment(spark, d):
    score, confidence = text.lexicon_scores(text.tokens(F.col("text")), POS, NEG)
    return rounded(_docs(spark, d).select("doc_id", score.alias("score"), confidence.alias("confidence")))


@query("SELECT event_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(event_type, '{p}') THEN '{k}' END" for k, p in TAGS.items()) + "], lambda x: x IS NOT NULL)), ',') AS tags FROM events")
def event_tags(spark, d):
    return market.news(spark, d).select("event_id", F.array_join(text.event_tags(F.col("title"), TAGS), ",").alias("tags"))


_TONE = r"""tn AS (SELECT doc_id, source, len(regexp_extract_all(text, '[A-Za-z'']+')) AS words, len(regexp_extract_all(lower(text), '\s(?:un|der|en)\s')) AS hedges, len(regexp_extract_all(lower(text), '\s(?:the|and|la)\s')) AS confident FROM documents),
tr AS (SELECT *, CASE WHEN words >= 100 THEN 1000.0::DOUBLE * hedges / words END AS hedge_rate, CASE WHEN words >= 100 THEN 1000.0::DOUBLE * confident / words END AS confidence_rate,
  CASE WHEN words >= 100 THEN 1000.0::DOUBLE * (confident - hedges) / words END AS tone_balance, CASE WHEN words < 100 THEN 'too_short' ELSE 'ok' END AS status FROM tn)"""


def _tone(spark, d):
    counts = zip(("words", "hedges", "confident"), text.tone(F.col("text"), HEDGE, SURE), strict=True)
    return text.tone_rates(_docs(spark, d).select("doc_id", "source", *[c.cast("long").alias(n) for n, c in counts]))


@query(f"WITH {_TONE} SELECT doc_id, words, hedges, confident, {r6('hedge_rate, confidence_rate, tone_balance')}, status FROM tr")
def tone_rates(spark, d):
    """Hedges, confident words and their balance per thousand words."""
    return rounded(_tone(spark, d).drop("source"))


@query(f"""WITH {_TONE}, dl AS (SELECT source AS ticker, doc_id AS filing, tone_balance, tone_balance - lag(tone_balance) OVER (PARTITION BY source ORDER BY doc_id) AS change FROM tr WHERE status = 'ok')
SELECT ticker, filing, {r6('tone_balance, change')}, CASE WHEN change > 0.5 THEN 'more_confident' WHEN change < -0.5 THEN 'more_hedged' WHEN change IS NOT NULL THEN 'unchanged' END AS direction FROM dl""")
def tone_change(spark, d):
    """Against the filing before of the same source."""
    return rounded(text.tone_change(_tone(spark, d).filter("status = 'ok'").select(F.col("source").alias("ticker"), F.col("doc_id").alias("filing"), "tone_balance")))


RISKS = {"license": "(?i)licen[cs]e", "wide": "(?i)the .*the "}


@query(r"""WITH s AS (SELECT doc_id, generate_subscripts(ss, 1) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
k AS (SELECT doc_id, pos, sentence, 'license' AS category FROM s WHERE regexp_matches(sentence, '(?i)licen[cs]e') UNION ALL SELECT doc_id, pos, sentence, 'wide' FROM s WHERE regexp_matches(sentence, '(?i)the .*the '))
SELECT doc_id, category, count(*) AS n, min_by(sentence, pos) AS example FROM k WHERE length(sentence) BETWEEN 31 AND 499 GROUP BY ALL""")
def risk_factors(spark, d):
    return text.risk_factors(_docs(spark, d), RISKS)


@query(r"""WITH h AS (SELECT doc_id, lower(CASE WHEN length(text) > 200 THEN substring(text, 1, 120) ELSE text END) AS h FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(h, '^[\s\S]{0,8}?the\s') THEN 'first' WHEN regexp_matches(h, '^[\s\S]{0,8}?and\s') THEN 'second' WHEN regexp_matches(h, '^[\s\S]{0,8}?la\s') THEN 'third' END AS section FROM h""")
def detect_section(spark, d):
    return _docs(spark, d).select("doc_id", text.detect_section(F.col("text"), (("first", r"the\s"), ("second", r"and\s"), ("third", r"la\s"))).alias("section"))


def _chunks_sql(source: str) -> str:
    """Chunks of `source` (doc_id, text): a recursion over each text's paragraphs that carries buffer and section."""
    head = "lower(CASE WHEN length(p) > 200 THEN substring(p, 1, 120) ELSE p END)"
    found = " ".join(f"WHEN regexp_matches({head}, '^[\\s\\S]{{0,8}}?{pattern}') THEN '{name}'" for name, pattern in text.SECTIONS)
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, {blanks})), lambda x: x <> '') AS ps FROM {source} WHERE text IS NOT NULL),
st AS (SELECT doc_id, ps, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS section, 0 AS n, CAST(NULL AS VARCHAR) AS done FROM ps
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN p IS NULL THEN '' WHEN is_full THEN trim(right(held, 200) || ' ' || p, {blanks}) WHEN held = '' THEN p ELSE trim(held || chr(10) || chr(10) || p, {blanks}) END,
    sec, n + CASE WHEN is_full THEN 1 ELSE 0 END, CASE WHEN is_full THEN trim(held, {blanks}) END
  FROM (SELECT *, CASE {found} ELSE section END AS sec, held <> '' AND (p IS NULL OR length(held) + length(p) > 1200) AS is_full FROM (SELECT *, ps[i + 1] AS p FROM st WHERE i <= len(ps)))),
ch AS (SELECT doc_id, doc_id || '::' || (n - 1) AS chunk_id, n - 1 AS chunk_index, done AS text, section, CAST(length(done) AS INTEGER) AS char_count FROM st WHERE done IS NOT NULL AND done <> '')"""


@query(rf"""WITH RECURSIVE pg AS (SELECT doc_id, 'Item 1A. Risk Factors' || chr(10) || chr(10) || regexp_replace(text, '([.!?])\s+', '\1' || chr(10) || chr(10), 'g') || chr(10) || chr(10) || 'Item 7. Management''s Discussion' AS text FROM documents),
{_chunks_sql('pg')} SELECT * FROM ch""")
def chunk_documents(spark, d):
    """Paragraphs packed into chunks with overlap, an id and the section that they stand in. The texts have no blank lines,
    so each sentence is made a paragraph here, between two headings.
    """
    parted = F.regexp_replace("text", r"([.!?])\s+", "$1\n\n")
    return text.chunk_documents(_docs(spark, d).select("doc_id", F.concat(F.lit("Item 1A. Risk Factors\n\n"), parted, F.lit("\n\nItem 7. Management's Discussion")).alias("text")))


_FORMS = "CASE page_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END"


@query(f"""WITH RECURSIVE {_HTML}, filed AS (SELECT page_id AS doc_id, {_FORMS} AS form, text, substring(sha256(text), 1, 32) AS content_hash FROM plain WHERE length(text) >= 2000),
fd AS (SELECT * FROM filed WHERE form LIKE '10-%'), one AS (SELECT fd.* FROM fd JOIN (SELECT content_hash, min(doc_id) AS doc_id FROM fd GROUP BY 1) USING (content_hash, doc_id)), {_chunks_sql('one')}
SELECT ch.doc_id, form, content_hash, chunk_id, chunk_index, section, char_count FROM ch JOIN one ON one.doc_id = ch.doc_id""")
def ingest_filings(spark, d):
    """Listing, plain text, the least length, one of equal texts, chunks: pages stand for filings of three forms."""
    form = F.when(F.col("page_id") % 3 == 0, "10-K").when(F.col("page_id") % 3 == 1, "10-Q").otherwise("8-K")
    filings = market.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), form.alias("form"), "html").filter("form LIKE '10-%'")
    kept = written(text.ingested(filings))
    return text.chunk_documents(kept).drop("text").join(kept.select("doc_id", "form", "content_hash"), "doc_id")


@query("""WITH h AS (SELECT doc_id, substring(sha256(coalesce(text, '')), 1, 32) AS content_hash FROM documents), a AS (SELECT content_hash, min(doc_id) AS known FROM h WHERE doc_id % 2 = 0 GROUP BY 1), f AS (SELECT content_hash, min(doc_id) AS first_id FROM h GROUP BY 1)
SELECT doc_id, content_hash, CASE WHEN known IS NOT NULL THEN 'already_ingested' WHEN doc_id = first_id THEN 'ingested' ELSE 'repeated' END AS status, coalesce(known, CASE WHEN doc_id <> first_id THEN first_id END) AS held_by FROM h JOIN f USING (content_hash) LEFT JOIN a USING (content_hash)""")
def ingest_again(spark, d):
    """All documents ingested into a corpus that has taken those of even ids before: which were new, repeated or there."""
    stored = corpus.Corpus(spark, shared_dir(spark))
    docs = _docs(spark, d).select("doc_id", "text", "lang", "source")
    stored.ingest(docs.filter("doc_id % 2 = 0"))
    return stored.ingest(docs)


@query(r"""WITH e AS (SELECT doc_id, source, lang, substring(text, 1, 900) AS text, list_distinct(list_transform(regexp_extract_all(lower(text), '\$\d{1,3}(?:,\d{3})+(?:\.\d+)?'), lambda x: trim(x))) AS found FROM documents)
SELECT doc_id, source, lang, text, array_to_string(list_slice(list_sort(found), 1, 10), ';') AS numbers FROM e""")
def evidence_rows(spark, d):
    """Evidence in place of an answer: each document's start and the first ten of its sorted dollar amounts, from the whole text."""
    return text.evidence(_docs(spark, d).select("doc_id", "source", "lang", "text"), r"\$\d{1,3}(?:,\d{3})+(?:\.\d+)?").withColumn("numbers", F.array_join("numbers", ";"))


@query()
def numeric_grounding(spark, d):
    """Amounts of a turn that the turn before doesn't hold."""
    c = market.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("evidence"))
    return pairs.select("conv_id", "turn", F.array_join(text.grounding(F.col("text"), F.col("evidence")), ",").alias("ungrounded"))


_CITED = r"""ci AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all('See [' || source || '-10k::' || (doc_id % 7) || '] and [' || source || '-10k::' || (doc_id % 3) || '].', '\[([A-Za-z0-9_\-]+::\d+)\]', 1))) AS cited, list_sort([source || '-10k::0', source || '-10k::1', source || '-10k::2']) AS valid FROM documents)"""


def _cited(spark, d):
    docs = _docs(spark, d)
    key = lambda n: F.concat(F.col("source"), F.lit("-10k::"), (F.col("doc_id") % n).cast("string"))
    answer = F.concat(F.lit("See ["), key(7), F.lit("] and ["), key(3), F.lit("]."))
    valid = F.array(*[F.concat(F.col("source"), F.lit(f"-10k::{i}")) for i in range(3)])
    return docs.select("doc_id", F.array_sort(text.citations(answer)).alias("cited"), valid.alias("valid"))


@query(f"WITH {_CITED} SELECT doc_id, array_to_string(list_sort(list_intersect(cited, valid)), ',') AS valid_citations, array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(valid, x))), ',') AS made_up FROM ci")
def citation_check(spark, d):
    c = _cited(spark, d)
    return c.select("doc_id", F.array_join(F.array_sort(F.array_intersect("cited", "valid")), ",").alias("valid_citations"), F.array_join(F.array_sort(F.array_except("cited", "valid")), ",").alias("made_up"))


@query(f"WITH {_CITED} SELECT doc_id, CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(valid, x))) > 0 THEN 'fabricated' WHEN doc_id % 5 = 0 THEN 'ungrounded' WHEN len(cited) = 0 THEN 'uncited' ELSE 'verified' END AS verdict FROM ci")
def verdict_ladder(spark, d):
    loose = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("7.5"))).otherwise(F.array().cast("array<string>"))
    return _cited(spark, d).select("doc_id", text.verdict(F.col("cited"), F.col("valid"), loose).alias("verdict"))


@query("SELECT d.source, count(*) AS chunks, count(DISTINCT d.lang) AS types FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def chunk_doc_join(spark, d):
    """Embedded chunks with their documents."""
    j = _vectors(spark, d).join(market.chunks(spark, d), "chunk_id")
    return j.groupBy(F.col("ticker").alias("source")).agg(F.count("*").alias("chunks"), F.count_distinct("doc_type").alias("types"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct({_TOKENS}) AS w FROM documents), c AS (SELECT doc_id, len(list_intersect(w, {list(POS)})) AS p, len(list_intersect(w, {list(NEG)})) AS n, len(list_intersect(w, ['ing', 'ed'])) AS q FROM w),
s AS (SELECT coalesce((p - n) / nullif(p + n, 0), 0.0::DOUBLE) AS a, coalesce((p - q) / nullif(p + q, 0), 0.0::DOUBLE) AS b FROM c)
SELECT count(*) AS n, round(corr(a, b), 6) + 0.0::DOUBLE AS r, count(*) FILTER (abs(a - b) > 0.8) AS disagree, round(avg(CAST(a = 0 AS INT)), 6) + 0.0::DOUBLE AS neutral_a, round(avg(CAST(b = 0 AS INT)), 6) + 0.0::DOUBLE AS neutral_b FROM s""")
def compare_backends(spark, d):
    """Two sentiment engines: agreement and how often each is neutral."""
    w = text.tokens(F.col("text"))
    s = _docs(spark, d).select(text.lexicon_scores(w, POS, NEG)[0].alias("a"), text.lexicon_scores(w, POS, ("ing", "ed"))[0].alias("b"))
    return rounded(s.agg(F.count("*").alias("n"), moments.correlation("a", "b").alias("r"), F.count_if(F.abs(F.col("a") - F.col("b")) > 0.8).alias("disagree"), F.avg((F.col("a") == 0).cast("double")).alias("neutral_a"), F.avg((F.col("b") == 0).cast("double")).alias("neutral_b")))


#: Sentences that hold terms of the fixed lists, in turn with ones that don't.
PHRASES = (
    "Acme beats earnings estimates and raises its full-year guidance on record growth", "Antitrust probe and litigation over supply chain shortage", "Company names new CFO as CEO steps down", "Buyback and dividend growth",
    "Inflation and foreign exchange pressure may possibly lead to a decline", "We believe results could be challenging", "Strong momentum, clearly accelerating and robust", "Merger with a single supplier divested",
    "Nothing of note happened on that day", "Item 7. Management's Discussion", "Item 1A. Risk Factors", "Data breach at a key personnel agency cuts profit",
)
_PHRASE = f"tx AS (SELECT o_orderkey AS doc_id, p[1 + o_orderkey % {len(PHRASES)}] || '. ' || p[1 + o_custkey % {len(PHRASES)}] || '.' AS text FROM orders, (SELECT [{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in PHRASES)}] AS p))"
_FIXED = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in text.EVENTS.items())
_RISKY = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in text.RISKS.items())
_HEADED = " ".join(f"WHEN regexp_matches(lower(text), '^[\\s\\S]{{0,8}}?{p}') THEN '{k}'" for k, p in text.SECTIONS)


@query(f"""WITH {_PHRASE}, w AS (SELECT *, list_distinct({_TOKENS}) AS w FROM tx), c AS (SELECT *, len(list_intersect(w, {list(text.POSITIVE)})) AS p, len(list_intersect(w, {list(text.NEGATIVE)})) AS n FROM w)
SELECT doc_id, round(coalesce((p - n) / nullif(p + n, 0), 0), 6) + 0.0::DOUBLE AS score, array_to_string(list_sort(list_filter([{_FIXED}], lambda x: x IS NOT NULL)), ',') AS events, array_to_string(list_sort(list_filter([{_RISKY}], lambda x: x IS NOT NULL)), ',') AS risks,
  CASE {_HEADED} END AS section, CAST(len(regexp_extract_all(lower(text), '{text.HEDGES}')) AS INTEGER) AS hedges, CAST(len(regexp_extract_all(lower(text), '{text.CONFIDENT}')) AS INTEGER) AS confident FROM c""")
def fixed_terms(spark, d):
    """The fixed lexicons and patterns, all of them, over sentences that hold their terms."""
    o = market.table(spark, d, "orders")
    phrase = lambda c: F.element_at(F.array(*map(F.lit, PHRASES)), (F.col(c) % len(PHRASES) + 1).cast("int"))
    t = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(phrase("o_orderkey"), F.lit(". "), phrase("o_custkey"), F.lit(".")).alias("text"))
    x = F.col("text")
    _, hedges, confident = text.tone(x)
    risks = F.array_sort(F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(k)) for k, p in text.RISKS.items()])))
    return rounded(t.select("doc_id", text.lexicon_scores(text.tokens(x))[0].alias("score"), F.array_join(text.event_tags(x), ",").alias("events"), F.array_join(risks, ",").alias("risks"), text.detect_section(x).alias("section"), hedges.alias("hedges"), confident.alias("confident")))
