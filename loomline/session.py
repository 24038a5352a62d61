"""Sessions for local runs: tests, the bench and small jobs. A cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "loomline", cpus: int | None = None) -> SparkSession:
    """A local session with adaptive execution and UTC days."""
    cores = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
