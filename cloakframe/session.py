"""A session with the settings that this package is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """An existing session, or a new one; cluster settings given to spark-submit win where none is passed here."""
    b = SparkSession.builder.appName("cloakframe")
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=defaults | conf).getOrCreate()
