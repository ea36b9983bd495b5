"""Session helpers shared by tests, the bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, driver_memory: str = "6g", app: str = "lexstrata") -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE, Arrow).

    On a cluster the session is the caller's; nothing in the library sets
    cluster-wide options itself.
    """
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
