"""Shared-folder tables: how the operators cut lineage without machine-local state."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_OURS: list[tuple[SparkSession, str]] = []


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`table` wrote; a missing one is fine."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Let executors give back the heap that finished work has grown, which no collection would shrink while they run Python.

    A collection at every core: some executors do it more than once, as tasks can't be sent to each of them.
    """
    release(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


def _cleanup() -> None:
    for spark, path in _OURS:
        try:
            drop_table(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


atexit.register(_cleanup)


def table(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and return the table read back, with its path.

    A lost executor costs nothing already written, and later plans start from the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _OURS.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
