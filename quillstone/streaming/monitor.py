"""Watching logs as streams of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import shared_dir


def stream_files(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    """Files of a folder as a stream: a single file's path can't be one."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def latest_by_name(spark: SparkSession, folder: str, glob: str, schema: StructType, name: str, value: str) -> DataFrame:
    """Counts and extremes by name over everything that has arrived, as a table."""
    view = f"metrics_{uuid.uuid4().hex}"
    stream = stream_files(spark, folder, glob, schema).groupBy(name).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName(view).trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(spark)}/quillstone/{view}").start()
    run.awaitTermination()
    return spark.table(view)
