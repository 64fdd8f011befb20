"""Append-only logs: metrics by epoch, and results by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_until(rows: DataFrame, epoch: int | None) -> DataFrame:
    """Rows up to an epoch, for a resumed run; none without one."""
    return rows.where(F.col("epoch") <= epoch) if epoch else rows.limit(0)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones skipped; an empty table where nothing is written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
