"""Reported quantities as they were known, against rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors as fx

D = dt.date
FACTS = "ticker string, metric string, period_end date, filed_date date, accession long, value double, form string"


def facts(spark, rows):
    return spark.createDataFrame([("A", m, e, f, i, v, form) for i, (m, e, f, v, form) in enumerate(rows)], FACTS)


def test_first_reports_of_annual_and_quarterly_forms(spark):
    rows = [
        ("revenue", D(2020, 3, 31), D(2020, 5, 1), 10.0, "10-Q"), ("revenue", D(2020, 3, 31), D(2020, 6, 1), 11.0, "10-Q/A"), ("revenue", D(2020, 3, 31), D(2020, 4, 1), 9.0, "8-K"),
        ("revenue", D(2020, 6, 30), D(2020, 8, 1), 12.0, "10-K405"),
    ]
    assert sorted((r.period_end, r.value, r.form) for r in fx.reported(facts(spark, rows)).collect()) == [(D(2020, 3, 31), 10.0, "10-Q"), (D(2020, 6, 30), 12.0, "10-K405")]


def test_flows_add_up_four_quarters_and_fall_back_to_annual(spark):
    quarter = [("net_income", D(2020, 3 * q, 28), D(2020, 3 * q, 28) + dt.timedelta(days=30), float(q), "10-Q") for q in (1, 2, 3, 4)]
    annual = ("net_income", D(2020, 12, 31), D(2021, 2, 1), 100.0, "10-K")  # no part of the quarters' sums
    fifth = ("net_income", D(2021, 3, 28), D(2021, 4, 27), 7.0, "10-Q")
    few = [("revenue", D(2020, 3, 31), D(2020, 5, 1), 5.0, "10-Q"), ("revenue", D(2020, 12, 31), D(2021, 2, 1), 40.0, "10-K")]
    same_day = [("total_assets", D(2020, 6, 30), D(2020, 9, 1), 3.0, "10-Q"), ("total_assets", D(2020, 3, 31), D(2020, 9, 1), 2.0, "10-Q")]
    known = {r.filed_date: r for r in fx.known_quantities(facts(spark, [*quarter, annual, fifth, *few, *same_day])).collect()}
    assert known[quarter[2][2]].net_income is None and known[quarter[3][2]].net_income == 10.0 and known[fifth[2]].net_income == 16.0
    assert known[D(2021, 2, 1)].net_income == 10.0 and known[D(2021, 2, 1)].revenue == 40.0 and known[D(2020, 9, 1)].revenue == 5.0
    assert known[D(2020, 9, 1)].total_assets == 3.0 and known[fifth[2]].total_assets == 3.0 and known[fifth[2]].eps_diluted is None


def test_ratios_know_nothing_before_it_is_filed(spark):
    filed = D(2020, 1, 10)
    rows = [(m, D(2019, 12, 31), filed, v, "10-K") for m, v in (("eps_diluted", 2.0), ("net_income", 30.0), ("revenue", 200.0), ("operating_income", 50.0), ("stockholders_equity", 60.0), ("total_assets", 100.0), ("total_liabilities", 40.0), ("shares_diluted", 3.0))]
    rows += [("total_assets", D(2020, 1, 5), D(2020, 1, 12), 150.0, "10-Q"), ("eps_diluted", D(2020, 1, 5), D(2020, 1, 13), 5.0, "10-K")]
    bars = spark.createDataFrame([("A", D(2020, 1, 1) + dt.timedelta(days=i), 10.0 if i < 14 else 0.0) for i in range(16)] + [("B", D(2020, 1, 12), 10.0)], "ticker string, date date, close double")
    b = fx.Lookbacks(year=3, two_years=6, least_surprise=3)
    got = {(r.ticker, r.date.day): r for r in fx.with_fundamentals(bars, facts(spark, rows), b).collect()}
    assert len(got) == 17 and all(got["A", d][f] is None for d in range(1, 10) for f in fx.FUNDAMENTAL_FACTORS) and all(got["B", 12][f] is None for f in fx.FUNDAMENTAL_FACTORS)
    r = got["A", 10]
    assert [r[f] for f in fx.FUNDAMENTAL_FACTORS] == [pytest.approx(x) if x is not None else None for x in (0.2, 2.0, 0.5, 0.25, 0.4, None, None)]
    assert got["A", 12].leverage == pytest.approx(40 / 150) and got["A", 13].asset_growth == pytest.approx(0.5) and got["A", 12].asset_growth is None
    # On the 13th eps is 5, was 2 on the 10th; the deviation is that of 2, 2, 2, 5.
    assert got["A", 13].earnings_surprise == pytest.approx(3 / 1.5) and got["A", 12].earnings_surprise is None
    assert got["A", 15].earnings_yield is None and got["A", 15].book_to_price is None
    assert fx.with_fundamentals(bars, facts(spark, rows).filter("false"), b).filter("leverage IS NOT NULL").count() == 0


def test_later_filings_change_no_earlier_row(spark):
    """Cutting off what was filed after a date leaves the panel up to it as it was."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(m, D(2020, 1, 1) + dt.timedelta(days=int(e)), D(2020, 1, 1) + dt.timedelta(days=int(e + rng.integers(1, 90))), float(rng.integers(1, 100)), ("10-Q", "10-K", "10-Q", "8-K")[i % 4]) for i, (m, e) in enumerate((m, e) for m in (*fx.FLOWS, *fx.LEVELS) for e in rng.integers(0, 300, 12))]
    table = facts(spark, rows)
    bars = spark.createDataFrame([("A", D(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i % 7) for i in range(0, 400, 3)], "ticker string, date date, close double")
    b, cut = fx.Lookbacks(year=5, two_years=10, least_surprise=4), D(2020, 10, 1)
    levels = ["date", "book_to_price", "leverage", "asset_growth"]
    whole = fx.with_fundamentals(bars, table, b).filter(F.col("date") <= cut).select(levels).orderBy("date").collect()
    early = fx.with_fundamentals(bars, table.filter(F.col("filed_date") <= cut), b).filter(F.col("date") <= cut).select(levels).orderBy("date").collect()
    assert whole == early and any(r.leverage is not None for r in whole)


def test_one_by_one_where_names_are_few(spark):
    dates = spark.range(20).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("i"))
    panel = dates.crossJoin(spark.range(5).select(F.concat(F.lit("T"), "id").alias("ticker"), F.col("id").alias("n"))).withColumns({"a": F.sin(F.col("i") + F.col("n") * 2), "b": F.cos(F.col("i") * F.col("n")), "c": F.lit(1.0)})
    panel = panel.withColumn("fwd_return", F.when(F.col("i") < 15, F.col("a") * 2 + F.sin(F.col("i") * 7 + F.col("n"))))
    got = {r.factor: r for r in fx.fama_macbeth(panel, ("a", "b", "c"), 3).collect()}
    assert {r.mode for r in got.values()} == {"univariate"} and got["a"].periods == 15 and got["a"].cross_sections == 15 and got["a"].significant
    assert got["c"].periods == 0 and got["c"].status == "insufficient_periods" and got["c"].p_hac is None
    assert {r["mode"] for r in fx.fama_macbeth(panel, ("a", "b"), 3).collect()} == {"multivariate"}
