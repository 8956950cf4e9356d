"""Sessions with the settings that plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "millrace", shuffle_partitions: int | None = None, ansi: bool = True, **more: str) -> SparkSession:
    """UTC, adaptive execution, and ANSI rules (integer overflow and division by zero are errors) unless told otherwise.

    Sizes of partitions are Spark's own at scale: adaptive execution joins small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": str(ansi).lower(),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
