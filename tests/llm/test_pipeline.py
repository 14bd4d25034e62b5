"""The pipeline's stages against plain Python, and its guard."""

import importlib
import sys

from test_minhash import brute
from test_native import base_spans, leaks, statistics
from test_packing import check

from tidemark.llm import pipeline
from tidemark.llm.shared import written


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, documents, sf_dir):
    docs, tables = documents, []
    for name, stage in pipeline.STAGES:
        new = written(stage(spark, docs, sf_dir))
        tables.append((name, docs, new))
        if name != "best_fit_packing":
            assert new.columns == documents.columns and new.dtypes == documents.dtypes
        docs = new
    by = {name: (rows_of(a), b) for name, a, b in tables}

    before, after = by["quality_rules"]
    failed = {d for d, r in before.items() if (s := statistics(r.text))[0] < 50 or 100 * s[4] > 50 * s[0]}
    kept = rows_of(after)
    assert not failed & kept.keys() and len(kept) > 0.95 * (len(before) - len(failed))
    assert all(len(r.text) == r.n_chars for r in kept.values())

    before, after = by["near_duplicates"]
    want = {d for d, (_, c) in brute({d: r.text for d, r in before.items()}).items() if d == c}
    assert rows_of(after).keys() == want

    before, after = by["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in leaks([(d, r.text) for d, r in before.items()], items) if not hit}
    assert rows_of(after).keys() == clean

    before, after = by["personal_data"]
    after = rows_of(after)
    assert after.keys() == before.keys()
    for d, r in before.items():
        assert not base_spans(after[d].text) and (base_spans(r.text) or "[SECRET]" in after[d].text or after[d].text == r.text)

    before, after = by["best_fit_packing"]
    check(after.collect(), {d: r.text for d, r in before.items()})


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def test_odd_rows_in_each_stage_alone(spark, odd_docs, sf_dir):
    """The first stage rejects all odd rows, so the others get them here by themselves."""
    before = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    left = {name: [(r.doc_id, r.text) for r in stage(spark, odd_docs, sf_dir).select("doc_id", "text").collect()] for name, stage in pipeline.STAGES[:-1]}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert left["quality_rules"] == []
    # 6 and its repetition equal 5; the empty ones stand for themselves.
    assert sorted(left["near_duplicates"], key=key) == sorted((r for r in before if r[0] != 6), key=key)
    assert sorted(left["decontamination"], key=key) == sorted(before, key=key)
    marked = {d: t for d, t in left["personal_data"] if d in (5, 6)}
    assert len(left["personal_data"]) == len(before) and all("[EMAIL]" in t and "[PHONE]" in t and "[IP]" in t for t in marked.values())
    assert [r for r in sorted(left["personal_data"], key=key) if r[0] not in (5, 6)] == [r for r in sorted(before, key=key) if r[0] not in (5, 6)]
    pieces = pipeline.STAGES[-1][1](spark, odd_docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in before} and sum(r.piece == 0 for r in pieces) == len(before)


def test_rows_that_repeat_an_id_with_other_texts_stay(spark, sf_dir):
    word = lambda k: " ".join(f"{k}{j}" for j in range(60))
    rows = [(5, word("a")), (5, word("b")), (5, word("b")), (6, word("b") + " more"), (None, word("c")), (None, word("c"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id or 0, r.text[0]) for r in pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert left == [(0, "c"), (0, "c"), (5, "a"), (5, "b")]


def test_entry_lists_its_queries():
    sys.modules.pop("__spark_entry__", None)
    names = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
