"""The session the engine runs in, and its settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC instants, Arrow transfer (NaN from Python becomes null) and adaptive plans.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def session(master: str = "local[8]", app: str = "marlstone", partitions: int = 8, **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` overrides them (dots as ``__``)."""
    b = SparkSession.builder.master(master).appName(app).config("spark.sql.shuffle.partitions", partitions)
    b = b.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that results depend on."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
