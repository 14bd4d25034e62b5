"""Session settings shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, *, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the engine's settings. On a cluster, set the same SQL options on your own session."""
    n = os.cpu_count() or 4 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
