"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution and UTC; further settings by name, dots written as __."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
