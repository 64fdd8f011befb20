"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_paths: dict[str, SparkSession] = {}
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or where that is
    unset, on a single machine only, a fresh temporary folder."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def _remove(path: str) -> None:
    spark = _paths.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the cluster's folder outlives it
        return


@atexit.register
def _remove_all() -> None:
    for path in list(_paths):
        _remove(path)


def materialize(df: DataFrame, tag: str, drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage
    with files that outlive any executor. drop_shuffles: those of the write go as it
    ends, not only when the driver happens to collect what refers to them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP)
    try:
        if drop_shuffles:
            spark.conf.set(_DROP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP, before)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table. createDataFrame would turn a list of rows
    into one by Python workers of another kind than SQL's, and these, idle, stay on the
    executors beside the others; an Arrow table needs none."""
    fields = StructType.fromDDL(schema).fields
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]))


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing will read again."""
    for df in frames:
        if getattr(df, "_scratch", None):
            _remove(df._scratch)
