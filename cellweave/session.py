"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: object) -> SparkSession:
    """The running session, or a new one; further settings are named with _ for dots."""
    builder = SparkSession.builder.appName("cellweave")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
