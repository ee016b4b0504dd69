"""The session settings that the dialect counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def engine_session(spark: SparkSession) -> SparkSession:
    """A session of its own over the same executors, so that settings and views stay apart."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in SETTINGS.items():
        own.conf.set(key, value)
    return own


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("skarn")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false"}
    return builder.config(map=settings).getOrCreate()
