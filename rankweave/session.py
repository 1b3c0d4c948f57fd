"""One place that builds a SparkSession with the settings the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "rankweave", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators.

    AQE stays on so that small shuffles coalesce and skewed joins split; the session time zone is UTC so
    that timestamps compare as the Parquet files hold them.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RANKWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
