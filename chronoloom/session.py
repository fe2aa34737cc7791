"""Session defaults that suit every plan of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the plans rely on (time zone) or profit from (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for local work; a cluster brings its own and needs only ``DEFAULTS``."""
    builder = SparkSession.builder.master(master).appName("chronoloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
