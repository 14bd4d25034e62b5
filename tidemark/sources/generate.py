"""Generated price paths: regimes of drift and volatility, autocorrelated within a regime, with gaps and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (daily drift, daily volatility, autocorrelation) of the regimes: fixed values.
REGIMES = {"trend_up": (0.00035, 0.011, 0.0), "trend_down": (-0.00030, 0.013, 0.0), "mean_revert": (0.0, 0.009, -0.18), "high_vol": (0.0001, 0.028, 0.05)}
SEGMENT = 90
END_DATE = "2025-06-30"


def universe(spark: SparkSession, tickers: int, days: int, seed: int, end: str = END_DATE) -> DataFrame:
    """ticker, date, open, high, low, close, volume; every ticker is generated by one task from its own seed."""
    import numpy as np
    import pandas as pd

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["i"].iloc[0])
        rng = np.random.default_rng(seed + 97 * i)
        noise, r, last = rng.standard_normal(days), np.empty(days), 0.0
        picks = rng.integers(0, len(REGIMES), days // SEGMENT + 1)
        for t in range(days):
            drift, vol, rho = list(REGIMES.values())[picks[t // SEGMENT]]
            last = drift + rho * (last if t % SEGMENT else 0.0) + vol * noise[t]
            r[t] = last
        close = (50 + 10 * i) * np.exp(np.cumsum(r))
        spread = 1 + np.abs(rng.normal(0, 0.004, days))
        out = pd.DataFrame({"ticker": f"SYN{i:02d}", "date": pd.bdate_range(end=end, periods=days).date, "close": close})
        out["open"] = out["close"].shift(1).fillna(50.0 + 10 * i)
        out["high"] = np.maximum(out["open"], close) * spread
        out["low"] = np.minimum(out["open"], close) / spread
        out["volume"] = rng.integers(1_000_000, 5_000_000, days).astype(float)
        out.loc[rng.choice(days, days // 200, replace=False), "close"] = np.nan
        return out[["ticker", "date", "open", "high", "low", "close", "volume"]]

    ids = spark.range(tickers).select(F.col("id").alias("i"))
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    return ids.groupBy("i").applyInPandas(path, schema).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
