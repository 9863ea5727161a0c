"""A session with the settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandline", **conf: str) -> SparkSession:
    """Adaptive execution, UTC and zstd Parquet; ``conf`` overrides.

    Shuffle partitions are left to the cluster: adaptive execution coalesces
    them, and a fixed number would be wrong at another size.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
