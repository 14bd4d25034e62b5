"""Allocations of a book: means and shrunk covariances of all windows by Spark, penalised optima window after window.

Dates are never gathered. Sums of returns and of products of pairs are made once for each block of dates and added up to the
windows that hold the block. A method's windows depend on each other, as turnover against the book before costs: they stream
through one task in order, a row of a matrix at a time, so a task holds one matrix, whatever the number of windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import moments
from tidemark.storage import small, written

CAP, RISK_AVERSION, TURNOVER_PENALTY, STEPS = 0.40, 3.0, 0.001, 2000
#: Costs of a unit of turnover.
COST = 0.0003
#: Dates that a walk needs beyond its look-back and one period, and dates out of sample that it must give.
SPARE_DATES, LEAST_LIVE, LEAST_COMPLETE = 10, 40, 30
#: Names that a solver takes at most (plans ask for 2 to 60): a task holds one matrix of so many squared entries.
MOST_NAMES = 2_000


def covariances(returns: DataFrame) -> DataFrame:
    """(a, b, n, cov) of all pairs of tickers on common dates, both ways."""
    x = returns.select("date", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    y = returns.select("date", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    return x.join(y, "date").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"))


def shrunk(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf: the sample covariance drawn towards a multiple of the identity by the optimal share."""
    n, k = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / k
    d2 = ((s - mu * np.eye(k)) ** 2).sum() / k
    b2 = min(d2, (((x**2).T @ (x**2)) / n - s**2).sum() / (n * k))
    share = b2 / d2 if d2 > 0 else 0.0
    return share * mu * np.eye(k) + (1 - share) * s


def nearest_book(v: np.ndarray, cap: float, pull: float = 0.0, previous: np.ndarray | None = None) -> np.ndarray:
    """The weights w of sum 1 between 0 and the cap (at least 1/k) that minimise |w - v|^2 / 2 + pull * sum |w - previous|.

    For a shift u of v, each weight is v - u drawn towards its previous value by at most `pull` and cut off at both ends. The sum
    of these falls with u in straight lines between known places; the two around the sum 1 are found by halving.
    """
    cap = max(cap, 1 / len(v))
    base = v if previous is None else previous
    pull = 0.0 if previous is None else pull

    def at(u: float) -> np.ndarray:
        x = v - u
        if pull:
            x = np.where(x > base + pull, x - pull, np.where(x < base - pull, x + pull, base))
        return np.clip(x, 0, cap)

    places = np.sort(np.concatenate([v - e for e in ((base - pull, base + pull, -pull, cap - pull, cap + pull, pull) if pull else (0.0 * v, cap + 0.0 * v))]))
    low, high = 0, len(places) - 1
    if at(places[low]).sum() < 1:  # all at the cap, whose sum is 1 but for rounding
        return at(places[low]) / at(places[low]).sum()
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if at(places[mid]).sum() >= 1 else (low, mid)
    a, b = at(places[low]).sum(), at(places[high]).sum()
    w = at(places[low] + ((a - 1) / (a - b) * (places[high] - places[low]) if a > b else 0.0))
    return w / w.sum()


Objective = tuple[Callable[[np.ndarray], float], Callable[[np.ndarray], np.ndarray], float]


def _min_variance(mu: np.ndarray, c: np.ndarray, unit: float) -> Objective:
    return lambda w: w @ c @ w, lambda w: 2 * c @ w, unit


def _mean_variance(mu: np.ndarray, c: np.ndarray, unit: float) -> Objective:
    return lambda w: RISK_AVERSION / 2 * w @ c @ w - w @ mu / unit, lambda w: RISK_AVERSION * c @ w - mu / unit, unit


def _risk_parity(mu: np.ndarray, c: np.ndarray, unit: float) -> Objective:
    """Squared distances of the names' contributions to the variance from their mean, times 10,000."""

    def off(w: np.ndarray) -> np.ndarray:
        x = w * (c @ w)
        return x - x.mean()

    def gradient(w: np.ndarray) -> np.ndarray:
        r = off(w)
        return 2 * (r * (c @ w) + c @ (r * w))

    return lambda w: float((off(w) ** 2).sum()), gradient, 1e4 * unit * unit


def _max_diversification(mu: np.ndarray, c: np.ndarray, unit: float) -> Objective:
    sd = np.sqrt(np.diag(c))

    def gradient(w: np.ndarray) -> np.ndarray:
        v = max(w @ c @ w, 1e-12)
        return -(sd / np.sqrt(v) - (w @ sd) * (c @ w) / v**1.5)

    return lambda w: -(w @ sd) / np.sqrt(max(w @ c @ w, 1e-12)), gradient, 1.0


#: Objectives of covariances in units of their mean variance, with what one unit of the objective stands for.
METHODS: dict[str, Callable | None] = {"equal_weight": None, "min_variance": _min_variance, "mean_variance": _mean_variance, "risk_parity": _risk_parity, "max_diversification": _max_diversification}


def minimised(objective: Objective, w: np.ndarray, penalty: float, previous: np.ndarray | None, cap: float) -> np.ndarray:
    """Proximal descent: steps along the gradient to the nearest book, turnover included, each as long as the last two slopes
    suggest and halved until the objective lies below its model.
    """
    value, gradient, unit = objective
    pull = penalty / unit
    cost = lambda x: pull * np.abs(x - previous).sum() if previous is not None else 0.0
    slope, step, now = gradient(w), 1.0, value(w)
    for _ in range(STEPS):
        for _ in range(60):
            x = nearest_book(w - step * slope, cap, step * pull, previous)
            d = x - w
            after = value(x)
            if after <= now + slope @ d + d @ d / (2 * step) + 1e-15 * abs(now):
                break
            step /= 2
        if np.abs(d).max() < 1e-11 or now + cost(w) - after - cost(x) < 1e-16 * abs(now) and np.abs(d).max() < 1e-8:
            return x
        new = gradient(x)
        curve = d @ (new - slope)
        w, slope, now, step = x, new, after, d @ d / curve if curve > 1e-300 else step * 2
    return w


def solved(mu: np.ndarray, c: np.ndarray, method: str, previous: np.ndarray | None = None, penalty: float = 0.0, cap: float = CAP) -> np.ndarray:
    """Weights of a method from means and covariances; turnover against the previous book (if any) costs `penalty` a unit.

    Without any variance, and where the method has no objective, names are weighted equally.
    """
    w, unit = np.full(len(c), 1 / len(c)), float(np.trace(c)) / len(c)
    if METHODS[method] is None or not unit > 0:
        return w
    return minimised(METHODS[method](mu, c / unit, unit), w, penalty, previous, max(cap, 1 / len(c)))


def allocate(x: np.ndarray, method: str, previous: np.ndarray | None = None, penalty: float = 0.0, cap: float = CAP) -> np.ndarray:
    """Weights of a method from a window of returns (dates by names)."""
    return solved(x.mean(axis=0), shrunk(x), method, previous, penalty, cap)


def universe(returns: DataFrame) -> list[str]:
    """The names that returns has, in order: those of one solver's matrix."""
    names = sorted(r.ticker for r in returns.select("ticker").distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"a universe of over {MOST_NAMES} names")
    return names


def placed(returns: DataFrame) -> DataFrame:
    """(ticker, date, t, x): t numbers the dates, whose order is made from the few distinct ones."""
    dates = returns.select("date").distinct().withColumn("t", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
    return returns.select("ticker", "date", F.col("ret").alias("x")).join(F.broadcast(dates), "date")  # a row a date


def window_moments(rows: DataFrame, lookback: int, every: int, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(means, covariances, shares) as (j, ticker, m), (j, a, b, cov) and (j, share) of all names of rows, however many, for each
    of `count` windows: window j holds the `lookback` dates from t = j * every on. A missing return is 0.

    Covariances are shrunk as in shrunk(), by sums alone. With A a date's sum of squares, B its product with the means m, and P
    the mean products of pairs, the squared distances that give the share add up to
    sum A^2 + n mm^2 + 4 n m'Pm + 2 mm sum A - 4 sum AB - 4 n mm^2, with mm = m'm: sums by name and by pair are enough.
    """
    width = math.gcd(lookback, every)
    per_window, per_step = lookback // width, every // width
    names = written(rows.select("ticker").distinct())
    n, k = float(lookback), float(max(1, names.count()))
    block = F.expr(f"t div {width}").alias("block")
    b = F.col("block")
    first, last = F.greatest(F.ceil((b - per_window + 1) / F.lit(float(per_step))), F.lit(0)), F.least(F.floor(b / F.lit(per_step)), F.lit(count - 1))
    windows = lambda df: df.filter(first <= last).withColumn("j", F.explode(F.sequence(first, last)))

    squares = rows.withColumn("A", F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("t")))
    by_name = windows(squares.groupBy(block, "ticker").agg(F.sum("x").alias("x"), F.sum(F.col("A") * F.col("x")).alias("ax")))
    by_name = by_name.groupBy("j", "ticker").agg((F.sum("x") / n).alias("m"), F.sum("ax").alias("ax"))
    grid = names.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("j"), "ticker")
    zero = F.lit(0.0)
    by_name = written(grid.join(by_name, ["j", "ticker"], "left").select("j", "ticker", F.coalesce("m", zero).alias("m"), F.coalesce("ax", zero).alias("ax")))
    by_date = windows(squares.groupBy(block, "t").agg(F.first("A").alias("A")).groupBy("block").agg(F.sum("A").alias("A"), F.sum(F.col("A") * F.col("A")).alias("AA")))
    by_date = by_date.groupBy("j").agg(F.sum("A").alias("A"), F.sum("AA").alias("AA"))

    # Pairs one way; the sums of a block are made before its windows multiply them.
    x, y = rows.select("t", F.col("ticker").alias("a"), "x"), rows.select("t", F.col("ticker").alias("b"), F.col("x").alias("y"))
    products = x.join(y, "t").filter("a <= b").groupBy(block, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    products = windows(products).groupBy("j", "a", "b").agg((F.sum("xy") / n).alias("p"))
    side = lambda c: by_name.select("j", F.col("ticker").alias(c), F.col("m").alias(f"m{c}"))
    pairs = side("a").join(side("b"), "j").filter("a <= b").join(products, ["j", "a", "b"], "left").withColumn("p", F.coalesce("p", zero))
    pairs = written(pairs.select("j", "a", "b", (F.col("p") - F.col("ma") * F.col("mb")).alias("s"), (F.col("ma") * F.col("p") * F.col("mb")).alias("mpm")))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    sums = pairs.groupBy("j").agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))) / k).alias("mu"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * F.col("mpm")).alias("mpm"))
    of = sums.join(by_name.groupBy("j").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("ax")).alias("am")), "j").join(by_date, "j")
    mm = F.col("mm")
    spread = F.col("AA") - 3 * n * mm * mm + 4 * n * F.col("mpm") + 2 * mm * F.col("A") - 4 * F.col("am")
    d2 = (F.col("ss") - k * F.col("mu") * F.col("mu")) / k
    shares = written(of.select("j", "mu", F.coalesce(F.when(d2 > 0, F.least(d2, (spread / n - F.col("ss")) / (n * k)) / d2), zero).alias("share")))
    cov = (1 - F.col("share")) * F.col("s") + F.when(F.col("a") == F.col("b"), F.col("share") * F.col("mu")).otherwise(0.0)
    one_way = pairs.join(small(shares), "j").select("j", "a", "b", cov.alias("cov"))
    both = one_way.union(one_way.filter("a < b").select("j", F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    return by_name.drop("ax"), both, shares.select("j", "share")


def allocations(means: DataFrame, covariances_: DataFrame, names: list[str], methods: tuple[str, ...] = tuple(METHODS), penalty: float = 0.0, cap: float = CAP) -> DataFrame:
    """(method, j, ticker, w): a method's windows pass through one task in the order of j, each with the book of the one before."""
    at = F.array(*map(F.lit, names))
    place = lambda c: F.array_position(at, F.col(c))
    row = covariances_.groupBy("j", "a").agg(F.array_sort(F.collect_list(F.struct(place("b").alias("b"), "cov"))).alias("c"))
    rows = row.join(means.select("j", F.col("ticker").alias("a"), "m"), ["j", "a"]).select("j", place("a").cast("int").alias("i"), "m", F.transform("c", lambda v: v["cov"]).alias("c"))
    jobs = rows.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    k = len(names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, c, held, of = np.empty(k), np.empty((k, k)), None, None
        for batch in batches:
            matrix = batch.column("c").flatten().to_numpy().reshape(-1, k)
            out = []
            for r, (method, j, i, m) in enumerate(zip(*[batch.column(x).to_pylist() for x in ("method", "j", "i", "m")], strict=True)):
                mu[i - 1], c[i - 1] = m, matrix[r]
                if i < k:
                    continue
                if method != of:
                    held, of = None, method
                held = np.clip(solved(mu, c, method, held, penalty, cap), 0, None)
                held = held / held.sum()
                out += [(method, j, name, float(w)) for name, w in zip(names, held, strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["method", "j", "ticker", "w"])

    dealt = jobs.repartition(4 * len(methods), "method").sortWithinPartitions("method", "j", "i")
    return dealt.mapInArrow(solve, "method string, j long, ticker string, w double")


def in_sample(returns: DataFrame, cap: float = CAP) -> DataFrame:
    """(method, ticker, w, annual return and variance parts m, v): weights of each method fitted on all dates on which every name has
    a return, without regard to turnover. v is a name's part of the book's variance. No rows for 30 such dates or fewer.
    """
    names = universe(returns)
    whole = returns.groupBy("date").agg(F.count_distinct("ticker").alias("k")).filter(F.col("k") == len(names)).select("date")
    rows = written(placed(returns.join(small(whole), "date", "left_semi")))
    n = rows.agg(F.coalesce(F.max("t") + 1, F.lit(0))).first()[0]
    if n <= LEAST_COMPLETE:
        return rows.select(F.lit("").alias("method"), "ticker", F.col("x").alias("w"), F.col("x").alias("m"), F.col("x").alias("v")).limit(0)
    means, cov, _ = window_moments(rows, n, n, 1)
    held = written(allocations(means, cov, names, cap=cap).drop("j"))
    risk = cov.join(held.select("method", F.col("ticker").alias("b"), "w"), "b").groupBy("method", F.col("a").alias("ticker")).agg(F.sum(F.col("cov") * F.col("w")).alias("cw"))
    return held.join(means.select("ticker", "m"), "ticker").join(risk, ["method", "ticker"]).select("method", "ticker", "w", (F.col("w") * F.col("m")).alias("m"), (F.col("w") * F.col("cw")).alias("v"))


def walk_forward(returns: DataFrame, lookback: int = 252, every: int = 21, penalty: float = TURNOVER_PENALTY, cap: float = CAP) -> DataFrame:
    """(method, date, ret, turnover, share): each method is refitted every `every` dates on the `lookback` before, and held.

    Missing returns are 0. ret is before costs; turnover is the change of the book where it was refitted, null elsewhere and
    at the first purchase; share is what its covariances were shrunk by. Without SPARE_DATES more dates than look-back and period,
    or with fewer than LEAST_LIVE out of sample, there are no rows.
    """
    rows, names = written(placed(returns)), universe(returns)
    n = rows.agg(F.coalesce(F.max("t") + 1, F.lit(0))).first()[0]
    if n < lookback + every + SPARE_DATES or n - lookback < LEAST_LIVE:
        return rows.select(F.lit("").alias("method"), "date", F.col("x").alias("ret"), F.col("x").alias("turnover"), F.col("x").alias("share")).limit(0)
    means, cov, shares = window_moments(rows, lookback, every, -(-(n - lookback) // every))
    held = written(allocations(means, cov, names, penalty=penalty, cap=cap))
    before = F.lag("w").over(Window.partitionBy("method", "ticker").orderBy("j"))
    turn = held.select("method", "j", F.abs(F.col("w") - before).alias("change")).groupBy("method", "j").agg(F.sum("change").alias("turn"))
    live = rows.filter(F.col("t") >= lookback).withColumn("j", F.expr(f"(t - {lookback}) div {every}"))
    day = live.join(held, ["j", "ticker"]).groupBy("method", "j", "date", "t").agg(F.sum(F.col("w") * F.col("x")).alias("ret"))
    day = day.join(small(turn.join(shares, "j")), ["method", "j"])
    refitted = (F.col("t") - lookback) % every == 0
    return day.select("method", "date", "ret", F.when(refitted, F.col("turn")).alias("turnover"), F.when(refitted, F.col("share")).alias("share"))


def walk_summary(walk: DataFrame, year: float) -> DataFrame:
    """(method, n, annual_return, annual_volatility, sharpe, max_drawdown, total_return, avg_turnover, avg_shrinkage, place) of a walk."""
    r = F.col("ret")
    m = walk.groupBy("method").agg(
        F.count("*").alias("n"), (F.avg(r) * year).alias("annual_return"), (F.stddev_samp(r) * year**0.5).alias("annual_volatility"), moments.sharpe(r, year).alias("sharpe"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"), F.avg("share").alias("avg_shrinkage"),
    )
    by = Window.partitionBy("method").orderBy("date")
    level = walk.select("method", "date", F.exp(F.sum(F.log1p(r)).over(by)).alias("level"))
    fall = level.withColumn("high", F.max("level").over(by)).groupBy("method").agg(F.min(F.col("level") / F.col("high") - 1).alias("max_drawdown"), (F.max_by("level", "date") - 1).alias("total_return"))
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce("sharpe", F.lit(-99.0))), "method"))  # a row a method
    return m.join(fall, "method").withColumn("place", place)


def equal_weight(returns: DataFrame, lookback: int, cost: float = COST) -> DataFrame:
    """(date, ret, net, turnover): the equal-weight walk in windows alone, of any number of names: all at 1/n from the date after the
    look-back on. ret is before costs; turnover is 1 at the first purchase and 0 later, and net is ret less its costs.
    """
    n = F.broadcast(returns.agg(F.count_distinct("ticker").alias("n")))
    day = returns.groupBy("date").agg(F.sum("ret").alias("s")).join(n)
    t = day.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("t") >= lookback)
    turn, ret = F.when(F.col("t") == lookback, 1.0).otherwise(0.0), F.col("s") / F.col("n")
    return t.select("date", ret.alias("ret"), (ret - cost * turn).alias("net"), turn.alias("turnover"))


def turnover(old: DataFrame, new: DataFrame) -> DataFrame:
    """(turnover,): sum of absolute changes between two books of (ticker, w)."""
    j = old.select("ticker", F.col("w").alias("a")).join(new.select("ticker", F.col("w").alias("b")), "ticker", "full")
    return j.agg(F.sum(F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))).alias("turnover"))
