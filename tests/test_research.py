import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import graph, reporting_queries, research
from tidemark.plans.graph import Node, Store, digest, execute, files_digest
from tidemark.sources import market
from tidemark.storage import shared_dir


class Plan:
    def __init__(self, a=1, b=1):
        self.a, self.b = a, b


def small_graph(spark, made, broken=()):
    def node(name, needs, fields=(), critical=False):
        def make(plan, tables):
            made.append(name)
            if name in broken:
                raise RuntimeError("no disk")
            return {name: spark.range(sum(t.count() for n, t in tables.items() if n in needs) + getattr(plan, fields[0]) if fields else 1)}

        return Node(name, needs, make, fields, critical)

    return [node("x", (), ("a",)), node("y", ("x",), ("b",)), node("z", ("x",)), node("end", ("y", "z"), critical=True)]


def statuses(out):
    return {s.node: s.status for s in out.steps}


def test_only_what_changed_is_made_again(spark):
    store, made = Store(spark, shared_dir(spark)), []
    first = execute(store, small_graph(spark, made), Plan(), "s", "one")
    assert made == ["x", "y", "z", "end"] and set(statuses(first).values()) == {"ok"} and first.tables["y"].count() == 2
    again = execute(store, small_graph(spark, made), Plan(), "s", "two")
    assert len(made) == 4 and set(statuses(again).values()) == {"reused"} and again.tables["y"].count() == 2
    changed = execute(store, small_graph(spark, made), Plan(b=3), "s", "three")
    assert made[4:] == ["y", "end"] and statuses(changed) == {"x": "reused", "y": "ok", "z": "reused", "end": "ok"} and changed.tables["y"].count() == 4
    execute(store, small_graph(spark, made), Plan(), "other files", "four")
    assert made[6:] == ["x", "y", "z", "end"]
    log = {(r.run, r.node): r.status for r in store.steps().collect()}
    assert log["two", "x"] == "reused" and log["three", "y"] == "ok" and len(log) == 16


def test_a_failed_node_resumes(spark):
    store, made = Store(spark, shared_dir(spark)), []
    out = execute(store, small_graph(spark, made, {"y"}), Plan(), "s", "one")
    assert statuses(out) == {"x": "ok", "y": "failed", "z": "ok", "end": "skipped"} and out.failed == ["y"] and "no disk" in out.steps[1].error
    out = execute(store, small_graph(spark, made), Plan(), "s", "two")
    assert made == ["x", "y", "z", "y", "end"] and statuses(out) == {"x": "reused", "y": "ok", "z": "reused", "end": "ok"}
    ends = execute(store, [Node("first", (), lambda p, t: 1 / 0, critical=True), *small_graph(spark, made)], Plan(), "s", "three")
    assert statuses(ends) == {"first": "failed"}


def test_half_written_tables_count_for_nothing(spark):
    """A node that breaks off between its tables is made again."""
    store = Store(spark, shared_dir(spark))
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    node = lambda second: Node("n", (), lambda p, t: {"one": spark.range(5), "two": second})
    assert statuses(execute(store, [node(bad)], Plan(), "s", "a")) == {"n": "failed"}
    out = execute(store, [node(spark.range(2))], Plan(), "s", "b")
    assert statuses(out) == {"n": "ok"} and out.tables["two"].count() == 2


def test_files_tell_versions_apart(spark):
    path = shared_dir(spark)
    spark.range(5).write.parquet(path)
    before = files_digest(spark.read.parquet(path))
    assert before == files_digest(spark.read.parquet(path)) != digest(0)
    spark.range(2).write.mode("append").parquet(path)
    assert files_digest(spark.read.parquet(path)) != before


@pytest.fixture(scope="module")
def run(spark):
    root = shared_dir(spark)
    return root, research.run(spark, "/root/testdata/sf0.01", "Does reversal and value of Brand#1 Brand#2 Brand#3 Brand#4 Brand#5 Brand#6 pay over a month?", root)


def test_a_rejected_plan_is_revised_and_reuses_what_it_can(spark, run):
    root, r = run
    assert r.verdict in ("reject", "material_issues", "see_flags", "no_objection") and not r.outcome.failed
    assert r.plan.revisions == 1 and r.plan.universe == () and r.plan.n_days == 1512 and len(r.applied) == 2
    got = {s.node: s.status for s in r.outcome.steps}
    assert {n: got[n] for n in ("macro", "fundamentals", "sentiment")} == dict.fromkeys(("macro", "fundamentals", "sentiment"), "reused") and got["factors"] == "ok" == got["backtest"]
    assert r.relations["bars"].select("date").distinct().count() == 1512 // 5
    text = research.report(r)
    assert all(f"## {s}" in text for s in ("plan", "findings", "steps", "coverage", "premiums", "models", "backtest", "risk", "portfolio"))
    assert {b.strategy for b in r.relations["backtest"].collect()} == {"logistic", "composite_baseline"} and {round(x.level, 2) for x in r.relations["risk"].collect()} == {0.95, 0.99}
    # Models and baseline are compared on the same dates.
    n = {b.strategy: b.n for b in r.relations["backtest"].collect()}
    assert len(set(n.values())) == 1 and {b.tried for b in r.relations["backtest"].collect()} == {2}


def test_the_same_plan_reads_everything(spark, run):
    root, r = run
    again = research.run(spark, "/root/testdata/sf0.01", r.plan.question, root, r.plan)
    assert {s.status for s in again.outcome.steps} == {"reused"} and again.findings == r.findings
    assert {x.status for x in research.steps(spark, root).collect()} == {"ok", "reused"}


def test_bars_are_added_up_once_for_all_revisions(spark, sf_dir):
    """One table of one node reads lineitem, for a plan and its longer revision; bars and findings are those of the whole relations."""
    reads = []

    def watched(node):
        def make(plan, tables):
            made = node.make(plan, tables)
            reads.extend((node.name, name) for name, df in made.items() if any("lineitem.parquet" in f for f in df.inputFiles()))
            return made

        return Node(node.name, node.needs, make, node.fields, node.critical)

    graph_ = research.nodes(spark, sf_dir)
    graph_ = [watched(n) for n in graph_[: [n.name for n in graph_].index("market_data") + 1]]
    store, short = Store(spark, shared_dir(spark)), research.Plan("q", ("Brand#1", "Brand#2"), n_days=504)
    first = execute(store, graph_, short, "s", "one")
    again = execute(store, graph_, research.Plan("q"), "s", "two")
    assert len(reads) == 1 and statuses(again) == {"weekly_bars": "reused", "market_data": "ok"} and set(statuses(first).values()) == {"ok"}
    for out, plan in ((first, short), (again, research.Plan("q"))):
        raw, walk = (df.filter(F.col("ticker").isin(*plan.universe)) if plan.universe else df for df in (market.bars_raw(spark, sf_dir), market.bars_walk(spark, sf_dir)))
        dates = sorted({r.date for r in walk.select("date").distinct().collect()})[-(plan.n_days // 5):]
        found = quality.findings(raw.filter(F.col("date").isin(dates)))
        bad = {r.ticker for r in found.collect() if r.severity == "error"}
        want = {(r.ticker, r.date): r.close for r in walk.filter(F.col("date").isin(dates)).collect() if r.ticker not in bad}
        assert {(r.ticker, r.date): r.close for r in out.tables["bars"].collect()} == pytest.approx(want) and len(want) > 100
        assert sorted(out.tables["quality"].collect()) == sorted(found.collect())


@pytest.mark.parametrize("critical", [True, False])
@pytest.mark.parametrize("broken", ["weekly_bars", "portfolio"])
def test_a_failure_is_no_result(spark, sf_dir, monkeypatch, broken, critical):
    """Neither findings nor a revision come of a run with a failed stage, be it one that the critic doesn't read; a later run goes on."""
    lost = spark.range(3).select(F.raise_error(F.lit("no disk")).alias("x"))
    graph_ = lambda broken: lambda *_: [
        Node(n, (), lambda p, t, n=n: {n: lost if n == broken else spark.range(1)}, ("n_days",), critical) for n in ("macro", "weekly_bars", "portfolio")
    ]
    monkeypatch.setattr(research, "nodes", graph_(broken))
    with pytest.raises(graph.NotWhole, match=f"^{broken} failed: .*no disk") as e:
        reporting_queries.research_findings(spark, sf_dir)
    assert e.value.__cause__ is not None
    root = shared_dir(spark)
    with pytest.raises(graph.NotWhole, match=root):
        research.run(spark, sf_dir, "q", root)
    assert research.steps(spark, root).select("run").distinct().count() == 1
    monkeypatch.setattr(research, "nodes", graph_(None))
    again = research.run(spark, sf_dir, "q", root, research.Plan("q", n_days=1008, revisions=1))
    assert {s.node: s.status for s in again.outcome.steps} == {"macro": "reused", "weekly_bars": "reused" if broken == "portfolio" else "ok", "portfolio": "ok" if broken == "portfolio" or critical else "reused"}


def test_no_verdict_on_a_run_with_a_failed_stage(spark):
    out = execute(Store(spark, shared_dir(spark)), small_graph(spark, [], {"y"}), Plan(), "s", "one")
    with pytest.raises(graph.NotWhole, match="^y failed: RuntimeError: no disk"):
        research.review(research.Research(research.Plan("q"), out))


def test_too_few_data_are_a_finding(spark, sf_dir, monkeypatch):
    """Where no factor is covered there is nothing to fit, which isn't a fault: the plan is rejected and the reason stands in the findings."""
    ml = next(n for n in research.nodes(spark, sf_dir) if n.name == "ml")
    uncovered = spark.sql("SELECT 'f' AS factor, 0L AS varied, false AS admitted")
    graph_ = [Node("diagnostics", (), lambda p, t: {"coverage": uncovered, "panel": spark.range(0)}), Node("ml", ("diagnostics",), ml.make), Node("risk", ("ml",), lambda p, t: {})]
    monkeypatch.setattr(research, "nodes", lambda *_: graph_)
    r = research.run(spark, sf_dir, "q")
    assert statuses(r.outcome) == {"diagnostics": "reused", "ml": "lacking", "risk": "skipped"} and r.verdict == "reject" and r.plan.revisions == 1
    assert "ml: no factor is covered; " in {c: what for c, _, what in r.findings}["sample_adequacy"]


def findings(spark, **rows):
    """The critic's findings on hand-made summaries."""
    good = {
        "coverage": "SELECT 'f' AS factor, 9L AS varied, true AS admitted", "leakage": "SELECT 'f' AS factor, 0.01 AS r, false AS suspect", "folds": "SELECT 0 AS fold, 10L AS train_end, 16L AS test_start, 20L AS test_end",
        "quality": "SELECT 'A' AS ticker, 'info' AS severity WHERE false", "sample": "SELECT 5000L AS rows, 20L AS names, 400d AS effective",
        "fold_metrics": "SELECT 'm' AS model, id AS fold, false AS degenerate FROM range(4)", "models": "SELECT 'm' AS model, 1 AS place, 'candidate_signal' AS verdict, 0.02d AS accuracy_dev",
        "backtest": "SELECT * FROM VALUES (1, 'm', 1.5d, 0.01d, 0.99d, true, 2, 1.0d, 1.2d, 1.7d, 0.8d, 200L), (2, 'composite_baseline', 0.5d, 0.2d, 0.4d, false, 2, 1.0d, 1.0d, 0.7d, 0.8d, 200L) AS t(place, strategy, sharpe, p_hac, dsr, dsr_significant, tried, first_half, second_half, gross_sharpe, turnover, n)",
    }
    r = research.Research(research.Plan("q"), graph.Outcome({k: spark.sql(v) for k, v in (good | rows).items() if v}))
    research.review(r)
    return r


@pytest.mark.parametrize(("change", "check", "severity", "revisions"), [
    ({}, None, None, ()),
    ({"coverage": "SELECT 'f' AS factor, 1L AS varied, false AS admitted"}, "lookahead", "error", ("drop_leaking_factors",)),
    ({"leakage": "SELECT 'f' AS factor, 0.5 AS r, true AS suspect"}, "lookahead", "error", ("drop_leaking_factors",)),
    ({"folds": "SELECT 0 AS fold, 10L AS train_end, 12L AS test_start, 20L AS test_end"}, "validation_scheme", "error", ()),
    ({"quality": "SELECT 'A' AS ticker, 'error' AS severity"}, "data_quality", "warning", ()),
    ({"sample": "SELECT 5000L AS rows, 9L AS names, 400d AS effective"}, "sample_adequacy", "error", ("lengthen_history", "widen_universe")),
    ({"sample": "SELECT 5000L AS rows, 20L AS names, 50d AS effective"}, "sample_adequacy", "error", ("lengthen_history", "widen_universe")),
    ({"fold_metrics": "SELECT 'm' AS model, id AS fold, false AS degenerate FROM range(2)"}, "sample_adequacy", "error", ("lengthen_history", "widen_universe")),
    ({"models": "SELECT 'm' AS model, 1 AS place, 'marginal_no_usable_edge' AS verdict, 0.02d AS accuracy_dev"}, "model_adds_value", "warning", ()),
    ({"models": "SELECT 'm' AS model, 1 AS place, 'candidate_signal' AS verdict, 0.2d AS accuracy_dev"}, "fold_stability", "warning", ()),
    ({"fold_metrics": "SELECT 'm' AS model, id AS fold, id = 1 AS degenerate FROM range(4)"}, "fold_stability", "warning", ()),
])
def test_each_check(spark, change, check, severity, revisions):
    r = findings(spark, **change)
    assert [(c, s) for c, s, _ in r.findings] == ([(check, severity)] if check else []) and r.revisions == revisions
    assert r.verdict == {None: "no_objection", "warning": "see_flags", "error": "reject"}[severity]


def test_checks_of_the_best_strategy(spark):
    row = lambda **k: "SELECT " + ", ".join(f"{v} AS {n}" for n, v in ({"place": 1, "strategy": "'m'", "sharpe": "-0.1d", "p_hac": "0.4d", "dsr": "0.2d", "dsr_significant": "false", "tried": 3, "first_half": "1d", "second_half": "-1d", "gross_sharpe": "0.3d", "turnover": "2.5d", "n": "200L"} | k).items())
    r = findings(spark, backtest=row())
    assert {c: s for c, s, _ in r.findings} == {"significance": "error", "multiple_testing": "error", "regime_dependence": "warning", "turnover_and_costs": "warning"} and r.revisions == ("reduce_strategy_count",)
    short = {c: s for c, s, _ in findings(spark, backtest=row(n="80L", p_hac="0.01d", dsr_significant="true", second_half="1d", sharpe="0.2d", turnover="1d")).findings}
    assert short == {"sample_adequacy": "error", "regime_dependence": "info"}
    none = {c: s for c, s, _ in findings(spark, backtest=None, models=None, fold_metrics=None, sample=None).findings}
    assert none["sample_adequacy"] == "error" and {none[c] for c in ("significance", "multiple_testing", "model_adds_value", "fold_stability", "regime_dependence", "turnover_and_costs")} == {"info"}
