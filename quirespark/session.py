"""A session set up as the plans expect: UTC, adaptive execution, skewed joins split."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName("quirespark")
    if master:
        builder = builder.master(master)
    for k, v in (conf | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
