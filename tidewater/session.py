"""Session construction used by the bench, the tests and stand-alone runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidewater", cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster, submit with the cluster's own master and settings instead."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
