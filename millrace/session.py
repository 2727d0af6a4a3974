"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """Get or create a session; ``settings`` have underscores for dots."""
    builder = SparkSession.builder.appName("millrace")
    if master:
        builder = builder.master(master)
    named = {k.replace("_", "."): v for k, v in settings.items()}
    return builder.config(map=SETTINGS | named).getOrCreate()
