"""Where results go: append-only Parquet tables, one row layout for metrics, Markdown files of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds rows to a table, split into folders by the given columns."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def metrics(df: DataFrame, run_id: str) -> DataFrame:
    """(run_id, row, metric, value): the numeric columns of a small result as a long table."""
    names = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    row = F.to_json(F.struct(*[c for c in df.columns if c not in names])).alias("row") if len(names) < len(df.columns) else F.lit("{}").alias("row")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return df.select(F.lit(run_id).alias("run_id"), row, each.alias("m")).select("run_id", "row", "m.*")
