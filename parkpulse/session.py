"""The session of tests and benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parkpulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Stack traces of every column expression; they take longer than planning itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

