"""A local session with the settings that tests and the bench share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str | None = None) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory or os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).appName("quillstone").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
