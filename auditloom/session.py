"""Session factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "auditloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; ``conf`` adds or overrides settings."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or "local[*]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | conf).getOrCreate()
