"""Walk-forward folds, scaling, fits and evaluation of cross-sectional models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import counted, mid_rank
from tidemark.operators import boosting, factors, sequence_models
from tidemark.operators.inference import newey_west
from tidemark.storage import written

LEAST_DATES, LEAST_TRAIN, TRAIN_SHARE, EMBARGO = 60, 20, 0.4, 5
TREES = 200
#: Complete rows of a panel, and rows of a fold to learn from and to test on, that a model asks for.
LEAST_ROWS, LEAST_TRAIN_ROWS, LEAST_TEST_ROWS = 250, 100, 20


def folds(dates: DataFrame, k: int = 4, horizon: int = 21, embargo: int = EMBARGO) -> DataFrame:
    """(fold, train_end, test_start, test_end) as places in the ordered dates, ends exclusive.

    Training ends `horizon` dates before the fold, so that no label reaches into it; testing starts an embargo later. Folds
    are of equal size, so a remainder of fewer dates than folds is left out at the end.
    """
    n = dates.select("date").distinct().agg(F.count("*").cast("long").alias("n")).filter(F.col("n") >= LEAST_DATES)
    least = F.floor(F.col("n") * TRAIN_SHARE).cast("long")
    size = F.greatest(F.floor((F.col("n") - least) / k), F.lit(1)).cast("long")
    f = n.select("n", least.alias("m"), size.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    at = F.col("m") + F.col("fold") * F.col("s")
    out = f.select("fold", (at - horizon).alias("train_end"), (at + embargo).alias("test_start"), (at + F.col("s")).alias("test_end"))
    return out.filter((F.col("train_end") > LEAST_TRAIN) & (F.col("test_start") < F.col("test_end"))).select(F.col("fold").cast("int"), *[F.col(c).cast("long") for c in ("train_end", "test_start", "test_end")])


def placed(panel: DataFrame) -> DataFrame:
    """panel with `at`, the place of its date; the dates' order is made from the few distinct dates, not from the rows."""
    dates = panel.select("date").distinct()
    at = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("at"))
    return panel.join(at, "date")


def scaled_by_training(panel: DataFrame, table: DataFrame, features: list[str]) -> DataFrame:
    """Test rows of each fold with their features in units of the fold's training rows (population deviation)."""
    rows = placed(panel)
    fold = F.broadcast(table)
    train = rows.join(fold, F.col("at") < F.col("train_end")).groupBy("fold").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    test = rows.join(fold, (F.col("at") >= F.col("test_start")) & (F.col("at") < F.col("test_end"))).join(F.broadcast(train), "fold")
    z = [((F.col(f) - F.col(f"m_{f}")) / F.nullif(F.col(f"s_{f}"), F.lit(0.0))).alias(f) for f in features]
    return test.select("fold", "ticker", "date", *z, "fwd_return")


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): the share of positive-negative pairs that the score orders rightly, from rank sums; ties count half.

    Ranks belong to distinct scores, which are counted and sorted over range partitions: a fold may hold all rows.
    """
    r = counted(scored, by, "score", {"pos": F.sum(F.col("label").cast("long"))})
    pos, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    ranks = F.sum(F.col("pos") * mid_rank())
    return r.groupBy(*by).agg(F.when((pos > 0) & (pos < n), (ranks - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def spread(scored: DataFrame, by: list[str], top: float = 0.67, bottom: float = 0.33) -> DataFrame:
    """(by, date, spread): mean later return of the top names less that of the bottom ones, ties included; three names at least."""
    w = Window.partitionBy(*by, "date")
    q = scored.select(*by, "date", "score", "fwd_return", F.percentile("score", F.lit(top)).over(w).alias("hi"), F.percentile("score", F.lit(bottom)).over(w).alias("lo"), F.count("*").over(w).alias("n"))
    legs = q.filter("n >= 3").groupBy(*by, "date").agg((F.avg(F.when(F.col("score") >= F.col("hi"), F.col("fwd_return"))) - F.avg(F.when(F.col("score") <= F.col("lo"), F.col("fwd_return")))).alias("spread"))
    return legs.filter("spread IS NOT NULL")


def evaluation(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy, base_rate, lift, positive_rate, degenerate, auc); a score above one half predicts a rise."""
    y, p = F.col("label").cast("double"), (F.col("score") > 0.5).cast("double")
    base = F.greatest(F.avg(y), 1 - F.avg(y))
    m = scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg((p == y).cast("double")).alias("accuracy"), base.alias("base_rate"), F.avg(p).alias("positive_rate"))
    m = m.withColumns({"lift": F.col("accuracy") - F.col("base_rate"), "degenerate": (F.col("positive_rate") > 0.95) | (F.col("positive_rate") < 0.05)})
    return m.join(auc(scored, by), by)


def signal_tests(scored: DataFrame, by: list[str], lags: int) -> DataFrame:
    """(by, ic, ic_dates, signal, periods, t_hac, p_hac, t_naive, inflation): the mean over dates of the rank correlation of score and later
    return (four names at least), and of the spread between top and bottom names, tested with allowance for the returns' overlap.
    """
    long = scored.select(F.concat_ws("|", *by).alias("factor"), "date", F.col("score").alias("x"), "fwd_return")
    ic = factors.information_coefficients(long).groupBy("factor").agg(F.avg("ic").alias("ic"), F.count("*").alias("ic_dates"))
    legs = spread(scored, by).select(F.concat_ws("|", *by).alias("factor"), "date", F.col("spread").alias("r"))
    t = newey_west(legs, lags, by="factor").withColumnRenamed("n", "periods")
    mean = legs.groupBy("factor").agg(F.avg("r").alias("signal"))
    keys = scored.select(*by, F.concat_ws("|", *by).alias("factor")).distinct()
    out = keys.join(ic, "factor", "left").join(mean, "factor", "left").join(t, "factor", "left")
    return out.select(*by, "ic", F.coalesce("ic_dates", F.lit(0)).alias("ic_dates"), "signal", F.coalesce("periods", F.lit(0)).alias("periods"), "t_hac", "p_hac", "t_naive", "inflation")


def model_summary(per_fold: DataFrame, baseline: str = "logistic") -> DataFrame:
    """(model, folds, accuracy, accuracy_dev, auc, ic, lift, beats_linear, verdict, place) with population deviations.

    A model is a candidate if it ranks better than chance, lifts the accuracy over the base rate and has a greater ic than
    the linear `baseline` (where that has one). Places go by ic, then auc; missing ones come last.
    """
    mean = {c: F.avg(c).alias(c) for c in ("accuracy", "auc", "ic", "lift")}
    s = per_fold.groupBy("model").agg(F.count("*").alias("folds"), mean["accuracy"], F.stddev_pop("accuracy").alias("accuracy_dev"), mean["auc"], mean["ic"], mean["lift"])
    # One row a model: the few models' means meet the baseline's.
    linear = s.agg(F.max(F.when(F.col("model") == baseline, F.col("ic"))).alias("_linear"))
    s = s.join(F.broadcast(linear)).withColumn("beats_linear", F.col("_linear").isNull() | F.coalesce(F.col("ic") > F.col("_linear"), F.lit(False))).drop("_linear")
    ranks, lifts = F.coalesce(F.col("ic") > 0.02, F.lit(False)), F.coalesce(F.col("lift") > 0.01, F.lit(False))
    verdict = F.when(ranks & lifts & F.col("beats_linear"), "candidate_signal").when(ranks | lifts, "marginal_no_usable_edge").otherwise("no_edge_detected")
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce("ic", F.lit(-9.0))), F.desc(F.coalesce("auc", F.lit(0.0))), "model"))
    return s.select("*", verdict.alias("verdict"), place.alias("place"))


def sequences(panel: DataFrame, features: list[str], length: int = 20) -> DataFrame:
    """(ticker, date, sequence): the last `length` complete rows' features, none spanning tickers or holding a null."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(length - 1), 0)
    whole = F.when(F.greatest(*[F.col(f).isNull().cast("int") for f in features], F.lit(0)) == 0, F.array(*[F.col(f).cast("float") for f in features]))
    held = panel.select("ticker", "date", F.collect_list(whole).over(w).alias("sequence"), F.count("*").over(w).alias("n"))
    return held.filter((F.size("sequence") == length) & (F.col("n") == length)).select("ticker", "date", "sequence")


def prepared(panel: DataFrame, features: list[str]) -> DataFrame:
    """The rows of panel with all features and a label: folds and places of a model count their dates."""
    return panel.na.drop(subset=[*features, "fwd_return"])


def in_folds(panel: DataFrame, table: DataFrame, features: list[str]) -> DataFrame:
    """(fold, train, ticker, date, label, fwd_return, features): the prepared rows of each fold, once for training or for testing.

    A panel of fewer than LEAST_ROWS complete rows has no folds. Folds of fewer than LEAST_TRAIN_ROWS rows to learn from, fewer
    than LEAST_TEST_ROWS to test on, or with one class only, are left out. `table` holds the folds of prepared(panel).
    """
    rows = written(placed(prepared(panel, features)))
    train = F.col("at") < F.col("train_end")
    test = (F.col("at") >= F.col("test_start")) & (F.col("at") < F.col("test_end"))
    dealt = rows.join(F.broadcast(table), train | test)  # a handful of folds
    dealt = written(dealt.select("fold", train.alias("train"), "ticker", "date", (F.col("fwd_return") > 0).cast("double").alias("label"), "fwd_return", *features))
    total = rows.agg(F.count("*").alias("all"))
    n = dealt.groupBy("fold").agg(F.count_if("train").alias("n"), F.count_if(~F.col("train")).alias("m"), F.sum(F.when(F.col("train"), F.col("label"))).alias("pos")).join(F.broadcast(total))
    good = n.filter(f"all >= {LEAST_ROWS} AND n >= {LEAST_TRAIN_ROWS} AND m >= {LEAST_TEST_ROWS} AND pos > 0 AND pos < n").select("fold")
    return dealt.join(F.broadcast(good), "fold", "left_semi")


def scaled_in_folds(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows of in_folds with features in units of their fold's training rows; features that don't vary there stay 0."""
    stats = rows.filter("train").groupBy("fold").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    z = {f: (F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0) for f in features}
    return rows.join(F.broadcast(stats), "fold").withColumns(z).select(*rows.columns)  # a row a fold


def _coefficients(spark, of: dict[int, np.ndarray], n: int) -> DataFrame:
    names = [f"b_{i}" for i in range(n + 1)]
    return F.broadcast(spark.createDataFrame([(f, *map(float, b)) for f, b in of.items()], "fold int, " + ", ".join(f"{c} double" for c in names)))


def _margin(features: list[str]) -> Column:
    return sum((F.col(f"b_{i + 1}") * F.col(f) for i, f in enumerate(features)), F.col("b_0"))


def newton_logistic(train: DataFrame, features: list[str], ridge: float = 1.0, steps: int = 100) -> dict[int, np.ndarray]:
    """Intercept and coefficients of each fold's logistic regression with balanced class weights and an L2 penalty on the coefficients.

    Reweighted least squares for all folds at once: each step sums loss, slopes and weighted cross products of all folds in one
    aggregation. A step that raises a fold's loss is halved.
    """
    spark, k = train.sparkSession, len(features)
    y, x = F.col("label"), [F.lit(1.0), *map(F.col, features)]
    counts = train.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    weight = F.when(y == 1, F.col("n") / (2 * F.col("pos"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("pos"))))
    rows = written(train.join(F.broadcast(counts), "fold").select("fold", "label", weight.alias("weight"), *features))
    folds = [r["fold"] for r in counts.select("fold").collect()]
    now = {f: np.zeros(k + 1) for f in folds}
    held: dict[int, tuple[np.ndarray, float]] = {}
    last = {f: np.inf for f in folds}
    penalty = np.diag([0.0] + [ridge] * k)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    for _ in range(steps if folds else 0):
        m = rows.join(_coefficients(spark, now, k), "fold").withColumn("_z", _margin(features)).withColumn("_p", 1 / (1 + F.exp(-F.col("_z"))))
        loss = F.sum(F.col("weight") * (F.greatest(F.col("_z"), F.lit(0.0)) - y * F.col("_z") + F.log1p(F.exp(-F.abs("_z")))))
        slope = F.array(*[F.sum(F.col("weight") * (F.col("_p") - y) * v) for v in x])
        curve = F.array(*[F.sum(F.col("weight") * F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i, j in pairs])
        for r in m.groupBy("fold").agg(loss.alias("loss"), slope.alias("slope"), curve.alias("curve")).collect():
            f, b = r["fold"], now[r["fold"]]
            total = r["loss"] + b @ penalty @ b / 2
            if f in held and total > held[f][1] + 1e-12 * abs(held[f][1]):
                now[f], last[f] = (b + held[f][0]) / 2, np.abs(b - held[f][0]).max() / 2
                continue
            h = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, r["curve"], strict=True):
                h[i, j] = h[j, i] = v
            step = np.linalg.solve(h + penalty + 1e-12 * np.eye(k + 1), np.array(r["slope"]) + penalty @ b)
            held[f], now[f], last[f] = (b, total), b - step, np.abs(step).max()
        if max(last.values()) < 1e-9:
            break
    return now


SCORED = ("fold", "ticker", "date", "model", "score", "fwd_return")


def out_of_sample(panel: DataFrame, table: DataFrame, features: list[str], model: str) -> DataFrame:
    """(fold, ticker, date, model, score, fwd_return): fits on each fold's training rows before its purge, all folds in one job a step.

    `logistic` is L2-regularised with balanced class weights; `boosting` is second-order on histograms (operators/boosting.py).
    `table` holds the folds of prepared(panel); folds that in_folds leaves out have no rows.
    """
    rows = written(in_folds(panel, table, features))
    if model == "logistic":
        scaled = scaled_in_folds(rows, features)
        fitted = newton_logistic(scaled.filter("train"), features)
        score = (1 / (1 + F.exp(-_margin(features)))).alias("score")
        return scaled.filter("NOT train").join(_coefficients(panel.sparkSession, fitted, len(features)), "fold").select("fold", "ticker", "date", F.lit(model).alias("model"), score, "fwd_return")
    trees, edges = boosted(rows, features)
    scored = boosting.predict(rows.filter("NOT train"), features, edges, trees, ["fold", "ticker", "date", "fwd_return"])
    return scored.withColumn("model", F.lit(model)).select(*SCORED)


def boosted(rows: DataFrame, features: list[str]) -> tuple[dict, dict]:
    """(trees, bin edges) of each fold, from the training rows of in_folds."""
    train = rows.filter("train").withColumn("key", F.xxhash64("ticker", "date"))
    edges = boosting.bin_edges(train, features, boosting.Settings().bins)
    return boosting.fit(train, features, edges, boosting.Settings(trees=TREES)), edges


def top_importances(panel: DataFrame, table: DataFrame, features: list[str], top: int = 8) -> DataFrame:
    """(fold, place, feature, importance, splits): the features with the greatest mean gain in each fold's boosted trees."""
    rows = written(in_folds(panel, table, features))
    found = boosting.importances(boosted(rows, features)[0], features)  # a row a fold and feature
    out = panel.sparkSession.createDataFrame(found, "fold int, feature string, importance double, splits long")
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("importance"), "feature"))
    return out.select("fold", place.alias("place"), "feature", "importance", "splits").filter(F.col("place") <= top)


def sequence_training(panel: DataFrame, table: DataFrame, features: list[str], kinds: tuple[str, ...] = sequence_models.KINDS, settings: sequence_models.Settings | None = None) -> tuple[DataFrame, list[dict]]:
    """(out-of-sample scores as of out_of_sample, history of losses) of the sequence networks; see operators/sequence_models.py.

    A panel of fewer than LEAST_ROWS complete rows, and folds with too few sequences, have no rows.
    """
    whole = prepared(panel, features)
    rows = written(placed(whole))
    history = sequences(whole, features, sequence_models.LENGTH)
    enough = rows.filter("false") if rows.limit(LEAST_ROWS).count() < LEAST_ROWS else rows
    samples = written(sequence_models.standardised(sequence_models.samples_in_folds(enough, table, history), len(features)))
    params, losses = sequence_models.fit(samples, len(features), kinds, settings or sequence_models.Settings())
    return sequence_models.scores(samples.filter("NOT train"), params), losses
