"""From a question to a reviewed report: a bounded plan, a graph of stored stages, ten checks, one revision that acts on them, Markdown.

Only summaries of a few rows (factors, folds, models, strategies) reach the driver; panels, scores and positions stay tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.operators import backtest, factors, inference, ml, portfolio, quality, risk
from tidemark.plans.graph import Lacking, Node, Outcome, Store, Tables, digest, execute, files_digest
from tidemark.sources import market
from tidemark.storage import shared_dir

#: Fixed bounds of a plan and of the critic's checks.
MOST_NAMES, LEAST_DAYS, MOST_DAYS, FOLDS = 60, 252, 3024, (2, 8)
FAMILIES = {
    "momentum": ("momentum_12_1", "momentum_3m"), "volatility": ("volatility_20d", "volatility_60d", "downside_ratio"), "reversal": ("mean_reversion",), "liquidity": ("liquidity",),
    "value": ("earnings_yield", "book_to_price"), "quality": ("return_on_equity", "operating_margin", "leverage"), "growth": ("asset_growth", "earnings_surprise"),
    "sentiment": ("sentiment_score",), "macro": factors.MACRO_FACTORS,
}
PRICE_FAMILIES = ("momentum", "volatility", "reversal", "liquidity")
MODELS = ("logistic", "boosting", "lstm", "transformer")
TURNOVER_BAR, LEAST_FOLDS, LEAST_DATES, LEAST_NAMES, LEAST_EFFECTIVE, LEAK = 2.0, 3, 120, 15, 100, 0.30
SEVERE, MANY_WARNINGS, YEAR, DAYS_PER_BAR, MOST_REVISIONS = "error", 3, 52.0, 5, 1


@dataclass(frozen=True)
class Plan:
    question: str
    universe: tuple[str, ...] = ()
    families: tuple[str, ...] = PRICE_FAMILIES
    n_days: int = 1008
    folds: int = 4
    horizon: int = 4
    rebalance: int = 4
    signal_lag: int = 1
    models: tuple[str, ...] = ("logistic",)
    revisions: int = 0

    def __post_init__(self) -> None:
        if len(self.universe) > MOST_NAMES or not LEAST_DAYS <= self.n_days <= MOST_DAYS or not FOLDS[0] <= self.folds <= FOLDS[1]:
            raise ValueError("the plan is outside its bounds")
        if not self.families or not set(self.families) <= set(FAMILIES) or not 1 <= self.horizon <= 63 or self.rebalance < 1:
            raise ValueError("the plan names unknown factors or periods")
        if not self.models or not set(self.models) <= set(MODELS):
            raise ValueError("the plan names unknown models")

    @property
    def factor_names(self) -> tuple[str, ...]:
        return tuple(f for k in self.families for f in FAMILIES[k])


def plan_for(question: str) -> Plan:
    """Families whose word the question has (those of prices, if none), tickers written as Brand#n (over MOST_NAMES are refused), a
    horizon in weeks or months, history in years, and the models that it asks for beside the linear one.
    """
    low = question.lower()
    families = tuple(k for k in FAMILIES if k[:6] in low) or PRICE_FAMILIES
    names = tuple(dict.fromkeys(re.findall(r"Brand#\d+", question)))
    horizon = 13 if "quarter" in low else 4 if "month" in low else 1 if "week" in low else 4
    years = re.search(r"(\d+)[\s-]*year", low)
    n_days = min(MOST_DAYS, max(LEAST_DAYS, 252 * int(years[1]))) if years else 1008
    models = ("logistic", *(("boosting",) if re.search("boost|tree", low) else ()), *(("lstm", "transformer") if re.search("deep|neural|sequence", low) else ()))
    return Plan(question, names, families, n_days, horizon=horizon, models=models)


def revised(plan: Plan, revisions: tuple[str, ...]) -> tuple[Plan, list[str]]:
    """The plan after the critic's revisions, and what was changed; a revision that doesn't apply changes nothing."""
    applied = []
    for r in revisions:
        if r == "widen_universe" and plan.universe:
            plan = replace(plan, universe=())
            applied.append("all names instead of the few that were named")
        elif r == "lengthen_history" and plan.n_days < MOST_DAYS:
            plan = replace(plan, n_days=min(MOST_DAYS, int(plan.n_days * 1.5)))
            applied.append(f"history of {plan.n_days} days")
        elif r == "drop_leaking_factors" and "sentiment" in plan.families and len(plan.families) > 1:
            plan = replace(plan, families=tuple(f for f in plan.families if f != "sentiment"))
            applied.append("without the sentiment family")
        elif r == "reduce_strategy_count" and set(plan.models) & {"lstm", "transformer"}:
            plan = replace(plan, models=tuple(m for m in plan.models if m not in ("lstm", "transformer")))
            applied.append("without the sequence models")
    return replace(plan, revisions=plan.revisions + 1), applied


def _lookbacks(plan: Plan) -> factors.Lookbacks:
    return replace(factors.WEEKLY, horizon=plan.horizon)


def nodes(spark: SparkSession, sf_dir: str) -> list[Node]:
    """The graph over the tables of sf_dir. Names of tables are those of the report's sections."""

    def weekly_bars(plan: Plan, t: Tables) -> Tables:
        return {"weekly": market.bars_raw(spark, sf_dir)}

    def market_data(plan: Plan, t: Tables) -> Tables:
        """From the stored bars of all names and dates, which it needs several times: a revised plan doesn't add them up again either."""
        raw = t["weekly"].filter(F.col("ticker").isin(*plan.universe)) if plan.universe else t["weekly"]
        walk = market.walked(raw)
        dates = walk.select("date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))  # a row a date
        kept = F.broadcast(dates.filter(F.col("back") <= plan.n_days // DAYS_PER_BAR).select("date"))
        found = quality.findings(raw.join(kept, "date", "left_semi"))
        bars = walk.join(kept, "date", "left_semi")
        return {"bars": quality.usable(bars, found), "quality": found}

    def macro(plan: Plan, t: Tables) -> Tables:
        from tidemark.plans.panel_queries import macro_state

        return {"macro": macro_state(spark, sf_dir)}

    def fundamentals(plan: Plan, t: Tables) -> Tables:
        return {"filings": market.filings(spark, sf_dir)}

    def sentiment(plan: Plan, t: Tables) -> Tables:
        from tidemark.plans.panel_queries import moods

        return {"moods": moods(spark, sf_dir)}

    def factor_panel(plan: Plan, t: Tables) -> Tables:
        return {"panel": factors.full_panel(t["bars"], t["filings"], t["moods"], t["macro"], _lookbacks(plan))}

    def diagnostics(plan: Plan, t: Tables) -> Tables:
        panel, names = t["panel"], plan.factor_names
        used = tuple(r.factor for r in factors.coverage(panel, names).filter("admitted").collect()) or names[:1]
        long = factors.unpivoted(panel, names).filter("x IS NOT NULL AND fwd_return IS NOT NULL")
        leak = long.groupBy("factor").agg(F.count("*").alias("n"), moments.correlation("x", "fwd_return").alias("r"))
        return {
            "coverage": factors.coverage(panel, names), "ic": factors.ic_summary(factors.information_coefficients(factors.unpivoted(panel, names))),
            "premiums": factors.fama_macbeth(panel, used, max(0, plan.horizon - 1)), "leakage": leak.withColumn("suspect", (F.col("n") > 30) & (F.abs("r") > LEAK)),
        }

    def admitted(t: Tables) -> list[str]:
        return sorted(r.factor for r in t["coverage"].filter("admitted").collect())

    def models(plan: Plan, t: Tables) -> Tables:
        panel, names = t["panel"], admitted(t)
        if not names:
            raise Lacking("no factor is covered")
        whole = ml.prepared(panel, names)
        table = ml.folds(whole, plan.folds, plan.horizon)
        oos = None
        for model in plan.models:
            if model in ("lstm", "transformer"):
                part = ml.sequence_training(panel, table, names, (model,))[0]
            else:
                part = ml.out_of_sample(panel, table, names, model)
            oos = part if oos is None else oos.unionByName(part)
        return {"oos": oos, "folds": table}

    def model_metrics(plan: Plan, t: Tables) -> Tables:
        scored = t["oos"].withColumn("label", (F.col("fwd_return") > 0).cast("int"))
        per = ml.evaluation(scored, ["model", "fold"]).join(ml.signal_tests(scored, ["model", "fold"], max(0, plan.horizon - 1)), ["model", "fold"])
        whole = ml.prepared(t["panel"], admitted(t))
        rho = inference.average_correlation(t["bars"].select("ticker", "date", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).alias("ret")).filter("ret IS NOT NULL"))
        n = whole.agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("names")).join(F.broadcast(rho))  # a row each
        effective = n.select("rows", "names", inference.effective_sample(F.col("rows"), F.col("names"), float(plan.horizon), F.coalesce("avg_corr", F.lit(0.0))).alias("effective"))
        return {"fold_metrics": per, "models": ml.model_summary(per), "sample": effective}

    def strategies(plan: Plan, t: Tables) -> Tables:
        panel = t["panel"]
        dates = F.broadcast(t["oos"].select("date").distinct())  # a row a date
        base = factors.composite_score(panel, {f: w for f, w in factors.COMPOSITE.items() if f in admitted(t)} or {admitted(t)[0]: 1.0})
        baseline = base.filter("score IS NOT NULL").join(dates, "date", "left_semi").select(F.lit("composite_baseline").alias("strategy"), "ticker", "date", "score")
        signals = t["oos"].select(F.col("model").alias("strategy"), "ticker", "date", "score").union(baseline)
        returns = panel.select("ticker", "date", F.col("ret_1d").alias("ret")).filter("ret IS NOT NULL")
        liquidity = panel.select("ticker", "date", F.col("volatility_20d").alias("vol"), F.exp("liquidity").alias("adv"))
        pnl = backtest.run(signals, returns, liquidity, plan.rebalance, YEAR, plan.signal_lag)
        table = backtest.metrics(pnl, YEAR)
        tried = max(1, table.count())  # the plan's models and the baseline
        series = pnl.select(F.col("strategy").alias("series"), "date", F.col("net").alias("r"))
        tests = inference.newey_west(series).select("series", "t_hac", "p_hac", "t_naive", "inflation")
        dsr = inference.deflated(inference.sharpe_table(series, YEAR), YEAR, tried).select("series", "psr", "threshold", "dsr", F.col("significant").alias("dsr_significant"))
        place = F.ntile(2).over(Window.partitionBy("series").orderBy("date"))
        halves = series.withColumn("half", place).groupBy("series").agg(*[moments.sharpe(F.when(F.col("half") == h, F.col("r")), YEAR).alias(name) for h, name in ((1, "first_half"), (2, "second_half"))])
        joined = backtest.ranked(table).join(tests.join(dsr, "series").join(halves, "series").withColumnRenamed("series", "strategy"), "strategy", "left")
        return {"pnl": pnl, "backtest": joined.withColumn("tried", F.lit(tried))}

    def tails(plan: Plan, t: Tables) -> Tables:
        series = t["pnl"].select(F.col("strategy").alias("series"), "date", F.col("net").alias("r"))
        levels = [risk.tail_risk(series, p).withColumn("level", F.lit(1 - p)) for p in (0.05, 0.01)]
        return {"risk": levels[0].union(levels[1])}

    def books(plan: Plan, t: Tables) -> Tables:
        r = t["panel"].select("ticker", "date", F.col("ret_1d").alias("ret")).filter("ret IS NOT NULL")
        return {"portfolio": portfolio.walk_summary(portfolio.walk_forward(r, 52, 13), YEAR)}

    return [
        Node("weekly_bars", (), weekly_bars, critical=True), Node("market_data", ("weekly_bars",), market_data, ("universe", "n_days"), critical=True), Node("macro", (), macro), Node("fundamentals", (), fundamentals), Node("sentiment", (), sentiment),
        Node("factors", ("market_data", "macro", "fundamentals", "sentiment"), factor_panel, ("horizon",), critical=True), Node("diagnostics", ("factors",), diagnostics, ("families", "horizon")),
        Node("ml", ("factors", "diagnostics"), models, ("folds", "horizon", "models")), Node("evaluation", ("market_data", "factors", "diagnostics", "ml"), model_metrics, ("horizon",)),
        Node("backtest", ("factors", "diagnostics", "ml"), strategies, ("rebalance", "signal_lag")), Node("risk", ("backtest",), tails), Node("portfolio", ("factors",), books),
    ]


@dataclass
class Research:
    plan: Plan
    outcome: Outcome = field(default_factory=Outcome)
    findings: list[tuple[str, str, str]] = field(default_factory=list)
    revisions: tuple[str, ...] = ()
    applied: list[str] = field(default_factory=list)

    @property
    def relations(self) -> Tables:
        return self.outcome.tables

    @property
    def verdict(self) -> str:
        failed = [s for _, s, _ in self.findings if s in (SEVERE, "warning")]
        if SEVERE in failed:
            return "reject"
        return "material_issues" if len(failed) >= MANY_WARNINGS else "see_flags" if failed else "no_objection"


#: What a failed check asks the plan to change.
REVISIONS = {"sample_adequacy": ("widen_universe", "lengthen_history"), "lookahead": ("drop_leaking_factors",), "significance": ("reduce_strategy_count",), "multiple_testing": ("reduce_strategy_count",)}


def review(research: Research) -> None:
    """The critic: ten checks; each finding is (check, severity, what was seen): error and warning for failed ones, info for those that
    lack what they look at. What failed with an error names the revisions. A run with a failed stage gets no verdict: NotWhole.
    """
    t, plan = research.outcome.whole().tables, research.plan
    rows = {n: t[n].collect() for n in ("coverage", "leakage", "folds", "quality", "sample", "fold_metrics", "models", "backtest") if n in t}  # a row a factor, fold, model or strategy
    best = next((b for b in rows.get("backtest", []) if b.place == 1), None)

    def check(name: str, severity: str, seen: bool, problems: list[str]) -> None:
        if not seen:
            research.findings.append((name, "info", "nothing to look at"))
        elif problems:
            research.findings.append((name, severity, "; ".join(problems)))

    constant = [c.factor for c in rows.get("coverage", []) if c.varied is not None and c.varied <= 1]
    check("lookahead", SEVERE, "coverage" in rows, [f"constant within every name: {', '.join(constant)}"] * bool(constant) + [f"{r.factor} correlates by {r.r:.2f} with the later return" for r in rows.get("leakage", []) if r.suspect])
    folds = rows.get("folds", [])
    check("validation_scheme", SEVERE, bool(folds), ["training labels reach into the test dates"] if any(f.test_start - f.train_end < plan.horizon for f in folds) else [])
    dropped = sorted({q.ticker for q in rows.get("quality", []) if q.severity == SEVERE})
    noted = sum(q.severity == "warning" for q in rows.get("quality", []))
    check("data_quality", "warning", "quality" in rows, [f"left out for errors: {', '.join(dropped)}"] * bool(dropped) + [f"{noted} warnings"] * bool(noted))
    tested, sample = len({m.fold for m in rows.get("fold_metrics", [])}), rows.get("sample", [None])[0]
    few = [f"{s.node}: {s.error}" for s in research.outcome.lacking]
    few += [f"{tested} folds"] * ("fold_metrics" in rows and tested < LEAST_FOLDS) + [f"{best.n if best else 0} dates out of sample"] * ((best.n if best else 0) < LEAST_DATES)
    if sample is not None:
        few += [f"{sample.effective:.0f} independent observations of {sample.rows} rows"] * (sample.effective is not None and sample.effective < LEAST_EFFECTIVE) + [f"{sample.names} names"] * (sample.names < LEAST_NAMES)
    check("sample_adequacy", SEVERE, True, few)
    check("significance", SEVERE, best is not None and best.p_hac is not None, [f"the mean return of {best.strategy} isn't distinct from zero (p {best.p_hac:.3f})"] if best and best.p_hac is not None and best.p_hac >= 0.05 else [])
    check("multiple_testing", SEVERE, best is not None and best.dsr is not None, [f"{best.strategy} doesn't beat the best of {best.tried} trials"] if best and best.dsr is not None and not best.dsr_significant else [])
    base = next((b for b in rows.get("backtest", []) if b.strategy == "composite_baseline"), None)
    leader = next((m for m in rows.get("models", []) if m.place == 1), None)
    beaten = None if base is None or base.sharpe is None else best.strategy != "composite_baseline" and (best.sharpe or -99) > base.sharpe
    check("model_adds_value", "warning", leader is not None, [f"{leader.model}: {leader.verdict}, beats the baseline: {beaten}"] if leader and (leader.verdict != "candidate_signal" or beaten is False) else [])
    unstable = [f"{m.model}: accuracy varies by {m.accuracy_dev:.2f} over folds" for m in rows.get("models", []) if (m.accuracy_dev or 0) > 0.10]
    single = sorted({m.model for m in rows.get("fold_metrics", []) if m.degenerate})
    check("fold_stability", "warning", "models" in rows, unstable + [f"{m} predicts one class almost always in a fold" for m in single])
    flips = best is not None and best.first_half is not None and best.second_half is not None and best.first_half * best.second_half < 0
    check("regime_dependence", "warning", best is not None and best.n >= LEAST_DATES, [f"Sharpe {best.first_half:.2f} in the first half, {best.second_half:.2f} in the second"] if flips else [])
    if best is not None:
        eaten = (best.gross_sharpe or 0) > 0 >= (best.sharpe or 0)
        check("turnover_and_costs", "warning", True, [f"costs take the whole edge of {best.strategy}"] * eaten + [f"turnover {best.turnover:.2f} a rebalance"] * ((best.turnover or 0) > TURNOVER_BAR))
    else:
        check("turnover_and_costs", "warning", False, [])
    failed = [c for c, s, _ in research.findings if s == SEVERE]
    research.revisions = tuple(sorted({r for c in failed for r in REVISIONS.get(c, ())}))


def report(research: Research, most: int = 60) -> str:
    """Markdown: plan, verdict, findings, revisions, steps, then every summary (its first `most` rows)."""
    p = research.plan
    out = [f"# {p.question}", "", f"Verdict: {research.verdict}", "", "## plan", "", f"- names: {', '.join(p.universe) or 'all'}", f"- factors: {', '.join(p.factor_names)}", f"- models: {', '.join(p.models)}"]
    out += [f"- {p.n_days} days, {p.folds} folds, horizon {p.horizon}, rebalanced every {p.rebalance}, signals {p.signal_lag} later", "", "## findings", ""]
    out += [f"- {c} ({s}): {what}" for c, s, what in research.findings] + [f"- revised: {a}" for a in research.applied]
    out += ["", "## steps", "", "| node | status | seconds | rows |", "|-|-|-|-|", *[f"| {s.node} | {s.status} | {s.seconds:.1f} | {s.rows} |" for s in research.outcome.steps]]
    for name in ("quality", "coverage", "leakage", "ic", "premiums", "folds", "fold_metrics", "models", "sample", "backtest", "risk", "portfolio"):
        rows = research.relations[name].limit(most).collect() if name in research.relations else []
        if rows:
            head = list(rows[0].asDict())
            out += ["", f"## {name}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
            out += ["| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


SOURCES = ("lineitem", "part", "orders", "customer", "nation", "region", "events")


def run(spark: SparkSession, sf_dir: str, question: str, root: str | None = None, plan: Plan | None = None) -> Research:
    """Plan, stages, critic; a rejected plan that the critic can revise is revised once. `root` is the store of an earlier run, whose stages
    are read where nothing that they depend on has changed. A stage that fails ends it in NotWhole.
    """
    plan, store = plan or plan_for(question), Store(spark, root or shared_dir(spark))
    sources = digest(sf_dir, [files_digest(market.table(spark, sf_dir, t)) for t in SOURCES])
    graph, applied = nodes(spark, sf_dir), []
    while True:
        name = digest(plan.question, plan.revisions)
        research = Research(plan, execute(store, graph, plan, sources, name), applied=applied)
        review(research)
        if research.verdict != "reject" or not research.revisions or plan.revisions >= MOST_REVISIONS:
            return research
        plan, applied = revised(plan, research.revisions)


def steps(spark: SparkSession, root: str) -> DataFrame:
    return Store(spark, root).steps()
