"""A session with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; everything else as the cluster sets it."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
