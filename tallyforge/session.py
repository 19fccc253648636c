"""A session with the settings the analytics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
