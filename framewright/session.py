"""Session construction with the settings the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "framewright", cores: int | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session; on a cluster pass no `cores` and let spark-submit choose the master."""
    cores = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
