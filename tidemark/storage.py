"""Cut points on storage that all executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows and about so many bytes may be broadcast; larger sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows of df, counted up to rows + 1, and about the bytes that these have.

    Texts and bytes are measured; arrays and structs count as their JSON.
    """
    width = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("x")))), F.lit(0))
    return tuple(df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first())


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast only if it has at most `rows` rows of about `size` bytes together. Give it a table that is cheap to count."""
    n, total = packed_size(df, rows)
    return F.broadcast(df) if n <= rows and total <= size else df
