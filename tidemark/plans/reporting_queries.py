"""Queries of reports, monitoring and drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import factors as fx
from tidemark.operators import lifecycle, reporting
from tidemark.plans import ctes, research
from tidemark.plans.ctes import WEEKLY, rounded
from tidemark.plans.registry import query
from tidemark.sources import market, parse
from tidemark.storage import small, written
from tidemark.streaming import bars as stream
from tidemark.streaming import stateful

_MODELS = "m AS (SELECT l_returnflag AS model, l_suppkey AS run_id, l_linenumber AS fold, l_discount AS accuracy, l_tax AS ic, l_orderkey AS ok FROM lineitem)"
_STEPS = """st AS (SELECT user_id % 50 AS run_id, event_id, event_type AS agent, value AS seconds, ts,
  CASE WHEN k < 5 THEN 'failed' WHEN k < 15 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
_RUNS = """rn AS (SELECT o_orderkey AS run_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderpriority AS verdict,
  CAST(o_orderdate AS DATE) AS created, o_totalprice AS seconds FROM orders)"""


@query(f"WITH {_MODELS}, g AS (SELECT model, count(*) AS folds, count(DISTINCT run_id) AS runs, avg(accuracy) AS a, avg(ic) AS i, min(ic) AS ic_min, max(ic) AS ic_max FROM m GROUP BY model) SELECT model, folds, runs, round(a, 6) + 0.0::DOUBLE AS accuracy, round(i, 6) + 0.0::DOUBLE AS ic, round(ic_min, 6) + 0.0::DOUBLE AS ic_min, round(ic_max, 6) + 0.0::DOUBLE AS ic_max, CAST(row_number() OVER (ORDER BY i DESC NULLS LAST, model) AS INTEGER) AS place FROM g")
def leaderboard(spark, d):
    return rounded(reporting.leaderboard(market.model_results(spark, d)))


@query(f"WITH {_STEPS} SELECT agent, count(*) AS steps, round(avg(seconds), 6) + 0.0::DOUBLE AS avg_seconds, max(seconds) + 0.0::DOUBLE AS max_seconds, round(sum(seconds), 4) + 0.0::DOUBLE AS total_seconds, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'degraded') AS degraded, round(count(*) FILTER (status = 'failed') / count(*), 6) + 0.0::DOUBLE AS failure_rate, round(count(*) FILTER (status <> 'ok') / count(*), 6) + 0.0::DOUBLE AS trouble_rate FROM st GROUP BY agent")
def agent_health(spark, d):
    return rounded(reporting.agent_health(market.run_steps(spark, d)).withColumn("total_seconds", F.round("total_seconds", 4)))


@query(f"WITH {_RUNS} SELECT 'status' AS dimension, status AS value, count(*) AS n FROM rn GROUP BY status UNION ALL SELECT 'verdict', verdict, count(*) FROM rn GROUP BY verdict")
def runs_summary(spark, d):
    """Counts by status and by verdict, from one pass over grouping sets."""
    return reporting.counts_by(market.runs(spark, d), ["status", "verdict"])


@query(f"WITH {_RUNS}, a AS (SELECT status, list_sort(list(seconds)) AS h, count(*) AS n FROM rn GROUP BY status) SELECT status, h[CAST(least(floor(n * 0.5::DOUBLE), n - 1) AS BIGINT) + 1] AS p50, h[CAST(least(floor(n * 0.95::DOUBLE), n - 1) AS BIGINT) + 1] AS p95 FROM a")
def run_duration_percentiles(spark, d):
    """Nearest-rank percentiles of durations."""
    return reporting.nearest_rank(market.runs(spark, d), "status", "seconds", {"p50": 0.5, "p95": 0.95})


@query("""WITH c AS (SELECT source AS ticker, count(*) AS n, count(DISTINCT lang) AS types, avg(CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 1 ELSE 0 END) AS embedded FROM documents GROUP BY source)
SELECT ticker, n, types, round(embedded, 6) + 0.0::DOUBLE AS embedded FROM c ORDER BY n DESC, ticker LIMIT 25""")
def corpus_stats(spark, d):
    """The 25 largest tickers of the corpus, their document types and how many documents have vectors."""
    v = market.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    c = market.chunks(spark, d).join(v, "doc_id", "left")
    g = c.groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("doc_type").alias("types"), F.avg(F.coalesce("has", F.lit(0))).alias("embedded"))
    return rounded(g.orderBy(F.desc("n"), "ticker").limit(25))


@query("SELECT c.conv_id AS doc_id, coalesce(n, 0) AS chunks FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a ON a.conv_id = c.conv_id")
def docs_with_chunks(spark, d):
    """Documents with the number of their chunks, zero where there are none; conversations and replies stand for them."""
    c = market.table(spark, d, "conversations")
    n = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id").distinct().join(n, "conv_id", "left").select(F.col("conv_id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("chunks"))


@query(f"WITH {_RUNS} SELECT status, count(*) AS n FROM rn GROUP BY status")
def queue_status(spark, d):
    return market.runs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_RUNS} SELECT run_id, status, created FROM rn WHERE status = 'completed' ORDER BY created DESC, run_id LIMIT 20 OFFSET 40")
def page_runs(spark, d):
    """The third page of twenty of the completed runs, latest first."""
    r = market.runs(spark, d).filter("status = 'completed'")
    return r.orderBy(F.desc("created"), "run_id").offset(40).limit(20).select("run_id", "status", "created")


@query("SELECT o_custkey AS run_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS approval FROM orders GROUP BY o_custkey")
def latest_approval(spark, d):
    r = market.table(spark, d, "orders").withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return reporting.latest(r, "o_custkey", "o", ["o_orderkey"]).select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("approval"))


@query(f"WITH {_RUNS} SELECT rn.run_id, c_name AS owner, verdict, created, count(*) OVER (PARTITION BY verdict) AS waiting FROM rn JOIN customer ON user_id = c_custkey WHERE status = 'queued' AND verdict = '1-URGENT'")
def approval_queue(spark, d):
    """Runs that wait for a decision, with their owners."""
    return _waiting(spark, d, "verdict = '1-URGENT'")


def _waiting(spark, d, which):
    """Queued runs with their owners and the number of those that share their verdict, which is counted apart: one verdict may hold most runs."""
    r = market.runs(spark, d).filter("status = 'queued'").filter(which)
    j = r.join(market.table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    n = small(j.groupBy("verdict").agg(F.count("*").alias("waiting")))
    return j.join(n, "verdict").select("run_id", F.col("c_name").alias("owner"), "verdict", "created", "waiting")


@query(f"WITH {_RUNS} SELECT rn.run_id, c_name AS owner, verdict, created, count(*) OVER (PARTITION BY verdict) AS waiting FROM rn JOIN customer ON user_id = c_custkey WHERE status = 'queued'")
def approval_queues(spark, d):
    """Runs of all verdicts that wait for a decision."""
    return _waiting(spark, d, "true")


@query(f"WITH {_STEPS} SELECT run_id, count(*) AS steps, round(sum(seconds), 4) + 0.0::DOUBLE AS seconds, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'degraded') AS degraded FROM st GROUP BY run_id")
def run_steps_summary(spark, d):
    s = market.run_steps(spark, d)
    by = lambda x: F.count_if(F.col("status") == x)
    return rounded(s.groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("seconds").alias("seconds"), by("failed").alias("failed"), by("degraded").alias("degraded")), 4)


@query(f"WITH {_MODELS} SELECT model, fold, ok, accuracy, ic FROM m WHERE run_id = 7")
def fold_rows(spark, d):
    return market.model_results(spark, d).filter("run_id = 7").orderBy("model", "fold").select("model", "fold", F.col("row").alias("ok"), "accuracy", "ic")


@query("SELECT l_orderkey AS book, count(*) AS names, round(sum(abs(l_discount - 0.05::DOUBLE)), 6) + 0.0::DOUBLE AS gross, round(sum(l_discount - 0.05::DOUBLE), 6) + 0.0::DOUBLE AS net FROM lineitem GROUP BY l_orderkey")
def book_exposure(spark, d):
    p = market.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_discount") - 0.05).alias("w"))
    return rounded(reporting.exposure(p))


@query(f"WITH {_RUNS}, ok AS (SELECT run_id FROM rn WHERE status = 'completed'), p AS (SELECT l_orderkey AS run_id, l_partkey AS ticker, l_shipdate AS dt, l_discount AS w FROM lineitem SEMI JOIN ok ON ok.run_id = l_orderkey) SELECT run_id, ticker, max_by(w, (dt, w)) AS w FROM p GROUP BY ALL")
def adopt_book(spark, d):
    """Latest weights, of finished runs alone."""
    ok = market.runs(spark, d).filter("status = 'completed'").select("run_id")
    p = market.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("ticker"), F.struct(F.col("l_shipdate").alias("at"), F.col("l_discount").alias("w")).alias("o"))
    return p.join(ok, "run_id", "left_semi").groupBy("run_id", "ticker").agg(F.max("o").alias("o")).select("run_id", "ticker", "o.w")


@query(f"WITH {_RUNS} SELECT run_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM rn")
def stale_runs(spark, d):
    return reporting.reap(market.runs(spark, d)).select("run_id", "status")


@query(f"WITH {_MODELS}, g AS (SELECT model, fold, avg(ic) AS importance FROM m GROUP BY ALL) SELECT model, fold, round(importance, 6) + 0.0::DOUBLE AS importance FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(importance, 9) DESC, fold) AS k FROM g) WHERE k <= 3")
def topk_importances(spark, d):
    g = market.model_results(spark, d).groupBy("model", "fold").agg(F.avg("ic").alias("importance"))
    k = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.round("importance", 9)), "fold"))
    return rounded(g.withColumn("k", k).filter("k <= 3").drop("k"))


_NUMBER = "list_reduce(list_transform(string_split(substr(md5({x}), 1, 12), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b)"
_PART = "coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _snapshot_sql(dataset: str, source: str, columns: list[str], kinds: str, date: str) -> str:
    text = " || ".join(_PART.format(c=c) for c in columns)
    return f"""SELECT run_id, '{dataset}' AS dataset, count(*) AS n_rows, CAST(min({date}) AS DATE) AS start_date, CAST(max({date}) AS DATE) AS end_date, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS row_sum, bit_xor(h) AS row_xor, md5('{kinds}') AS schema
  FROM (SELECT *, {_NUMBER.format(x=text)} AS h FROM {source}) GROUP BY run_id"""


@query("WITH " + "ev AS (SELECT user_id % 50 AS run_id, event_id, event_type, ts FROM events), bk AS (SELECT l_suppkey AS run_id, l_orderkey, l_partkey, l_linenumber, l_returnflag, l_shipdate FROM lineitem) "
       + _snapshot_sql("steps", "ev", ["event_id", "event_type"], "event_id:bigint,event_type:string", "ts") + " UNION ALL "
       + _snapshot_sql("positions", "bk", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"], "l_orderkey:bigint,l_partkey:bigint,l_linenumber:bigint,l_returnflag:string", "l_shipdate"))
def run_lineage(spark, d):
    """What each run read of steps and positions: rows, dates, and fingerprints that no order of rows changes."""
    steps = market.table(spark, d, "events").withColumn("run", F.col("user_id") % 50)
    of = market.table(spark, d, "lineitem")
    whole = [(c, "bigint") for c in ("l_orderkey", "l_partkey", "l_linenumber")]
    of = of.select(F.col("l_suppkey").alias("run"), *[F.col(c).cast(k).alias(c) for c, k in whole], "l_returnflag", "l_shipdate")
    return lifecycle.snapshots(steps, "steps", "run", ["event_id", "event_type"], "ts").union(lifecycle.snapshots(of, "positions", "run", [c for c, _ in whole] + ["l_returnflag"], "l_shipdate"))


_ACTIONS = "acts AS (SELECT user_id % 50 AS run_id, event_id, ts AS at_, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' ELSE 'fail' END AS action FROM events)"
_MOVE = "CASE " + " ".join(f"WHEN s = '{s}' AND a = '{a}' THEN '{to}'" for (s, a), to in lifecycle.TRANSITIONS.items()) + " ELSE s END"
_DECIDED = f"""{_ACTIONS}, so AS (SELECT *, coalesce(list(action) OVER (PARTITION BY run_id ORDER BY at_, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM acts),
met AS (SELECT *, list_reduce(list_prepend('queued', past), lambda s, a: {_MOVE}) AS state FROM so),
moved AS (SELECT run_id, event_id, at_, action, state, list_reduce([state, action], lambda s, a: {_MOVE}) AS new_state FROM met),
decided AS (SELECT *, (state, action) IN ({", ".join(f"('{s}', '{a}')" for s, a in lifecycle.TRANSITIONS)}) AS accepted FROM moved)"""


def _actions(spark, d):
    e = market.table(spark, d, "events")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "start").when(kind == "purchase", "finish").when(kind == "click", "approve").when(kind == "view", "reject").otherwise("fail")
    return e.select((F.col("user_id") % 50).cast("long").alias("run_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").alias("at"), action.alias("action"))


@query(f"WITH {_DECIDED} SELECT run_id, event_id, action, state, accepted, new_state FROM decided")
def approval_decisions(spark, d):
    """Every action on a run: the state that it met, and whether it was allowed."""
    return lifecycle.decisions(_actions(spark, d))


@query(f"WITH {_DECIDED} SELECT run_id, arg_max(new_state, (at_, event_id)) AS status, count(*) AS events, count(*) FILTER (NOT accepted) AS refused FROM decided GROUP BY run_id")
def approval_outcomes(spark, d):
    """Each run's state after all actions, and how many were refused."""
    events = _actions(spark, d)
    return lifecycle.outcome(lifecycle.decisions(events), events)


def _psi_sql(source: str) -> str:
    cuts = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
    return f"""{source}, eg AS (SELECT factor, list_sort(list_distinct(quantile_cont(x, {cuts}) FILTER (ref))) AS e, count(*) FILTER (ref) AS n_ref, count(*) FILTER (NOT ref) AS n_new FROM ob GROUP BY factor),
ed AS (SELECT factor, n_ref, n_new, e[2:len(e) - 1] AS e FROM eg WHERE n_ref >= 50 AND n_new >= 20 AND len(e) >= 3),
pl AS (SELECT ob.factor, ref, len(list_filter(e, lambda v: v <= x)) AS bin FROM ob JOIN ed USING (factor)), ct AS (SELECT factor, bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS a FROM pl GROUP BY ALL),
al AS (SELECT factor, n_ref, n_new, unnest(range(0, len(e) + 1)) AS bin FROM ed), sh AS (SELECT factor, n_ref, n_new, greatest(coalesce(r, 0) / n_ref, 1e-6) AS p, greatest(coalesce(a, 0) / n_new, 1e-6) AS q FROM al LEFT JOIN ct USING (factor, bin)),
ps AS (SELECT factor, n_ref, n_new, sum((q - p) * ln(q / p)) AS psi FROM sh GROUP BY ALL)
SELECT factor, n_ref, n_new, round(psi, 6) + 0.0::DOUBLE AS psi, CASE WHEN psi > 0.25 THEN 'material' WHEN psi > 0.10 THEN 'moderate' ELSE 'stable' END AS level FROM ps"""


@query("WITH " + _psi_sql("ob AS (SELECT 'price' AS factor, o_totalprice AS x, o_orderdate < TIMESTAMP '1998-06-01' AS ref FROM orders)"))
def psi(spark, d):
    o = market.table(spark, d, "orders").select(F.lit("price").alias("factor"), F.col("o_totalprice").alias("x"), "o_orderdate")
    return rounded(reporting.psi(o, F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")))


@query("WITH " + _psi_sql(f"{WEEKLY}, {ctes.LONG}, dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)), ob AS (SELECT factor, x, i < floor(n * 0.75::DOUBLE) AS ref FROM long JOIN dt USING (date) WHERE x IS NOT NULL AND n >= 120)"))
def feature_drift(spark, d):
    """The last quarter of dates against those before, for every factor at once."""
    long = fx.unpivoted(fx.price_factors(market.bars_walk(spark, d), fx.WEEKLY))
    dates = long.select("date").distinct()
    w = Window.orderBy("date")
    at = dates.select("date", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n")).filter("n >= 120")
    rows = long.join(F.broadcast(at.select("date", (F.col("i") < F.floor(F.col("n") * 0.75)).alias("early"))), "date")
    return rounded(reporting.psi(rows, F.col("early")))


@query("SELECT event_type AS agent, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS band, count(*) AS n FROM events GROUP BY ALL")
def json_bands(spark, d):
    """A field of a JSON column in bands."""
    k = F.from_json("props", "k int")["k"]
    return market.table(spark, d, "events").groupBy(F.col("event_type").alias("agent"), F.floor(k / 10).cast("int").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, count(*) FILTER (o_orderkey % 7 > 0) AS known, round(sum(CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END), 4) + 0.0::DOUBLE AS value FROM orders GROUP BY 1")
def csv_series(spark, d):
    """Lines `date,value` in which a dot stands for a missing value."""
    o = market.table(spark, d, "orders")
    line = F.concat_ws(",", F.col("o_orderdate").cast("date").cast("string"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("."))
    date, value = parse.series_line(line)
    return rounded(o.select(date.alias("date"), value.alias("value")).groupBy("date").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.sum("value").alias("value")), 4)


@query("SELECT event_id, epoch_us(CAST(date_trunc('second', ts) AS TIMESTAMP)) // 1000000 AS seconds FROM events")
def mixed_timestamps(spark, d):
    """Epoch seconds and ISO strings, one of each in turn."""
    e = market.table(spark, d, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    stamp = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp("at").cast("string")).otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_timestamp(parse.published(stamp)).alias("seconds"))


@query()
def research_findings(spark, d):
    """What the critic says to a question, as rows."""
    r = research.run(spark, d, "Does reversal pay over a month?")
    return spark.createDataFrame([("verdict", r.verdict, r.plan.question), *r.findings], "check string, severity string, detail string")


@query("SELECT CAST(ts AS DATE) AS date, event_type AS ticker, count(*) AS n, round(sum(value), 4) + 0.0::DOUBLE AS volume, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2")
def stream_daily_bars(spark, d):
    """An extension: daily bars by a stream with a watermark, run to its end."""
    return rounded(stream.run_to_end(stream.daily_bars(stream.events(spark, d)), "complete"), 4)


@query("SELECT event_type, CAST(ts AS DATE) AS date, min(ts) AS first FROM events GROUP BY 1, 2")
def stream_first_reported(spark, d):
    """An extension: the first report of each type and day, as a stream's aggregate."""
    return stream.run_to_end(stream.first_of_day(stream.events(spark, d)), "complete")


_CLOSED = "CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query(f"SELECT CAST(ts AS DATE) AS date, event_type AS ticker, count(*) AS n, round(sum(value), 4) + 0.0::DOUBLE AS volume, max(value) AS high, min(value) AS low FROM events WHERE {_CLOSED} GROUP BY 1, 2")
def stream_closed_bars(spark, d):
    """Daily bars in append mode: each day is written once, when the watermark has passed it, and leaves the state."""
    return rounded(stateful.appended(stateful.closed_bars(stream.events(spark, d)))[0], 4)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    """Users' first event of each type: repetitions within the delay are dropped as they come."""
    return stateful.appended(stateful.first_seen(stream.events(spark, d), ["user_id", "event_type"]))[0].select("user_id", "event_type")


@query(f"""WITH days AS (SELECT CAST(user_id % 20 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, avg(value / 100 - 1) AS s FROM events WHERE {_CLOSED} GROUP BY 1, 2), n AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY ticker), date) AS t FROM days)
SELECT ticker, date, round(sum(s * pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w / sum(pow(2.0::DOUBLE, t / 5.0::DOUBLE)) OVER w, 6) + 0.0::DOUBLE AS sentiment FROM n WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def stream_decayed_mean(spark, d):
    """The decayed mean of news as a stream with timers: closed days only."""
    e = stream.events(spark, d)
    news = e.select((F.col("user_id") % 20).cast("string").alias("ticker"), "at", (F.col("value") / 100 - 1).alias("score"))
    return rounded(stateful.appended(stateful.decayed_means(news))[0])
