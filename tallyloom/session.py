"""Session factory and the conventions that every job of the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; what the cluster already sets is kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
