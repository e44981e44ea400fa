"""Sessions, the shared folder, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OURS: list[tuple[SparkSession, str]] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; other settings by keyword (dots as __)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where unset and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return str(jdir.get()).rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application; it needn't be installed there."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":  # the default; whole texts come in batches, so fewer of them at once
        spark.conf.set(_BATCH, "1000")
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(here)))
    to = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace-{sc.applicationId}.zip")
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
    out.write(raw.getvalue())
    out.close()
    sc.addPyFile(to.toString())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; a few bytes a value, where a checkpoint has whole rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _OURS.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _cleanup() -> None:
    for spark, path in _OURS:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


atexit.register(_cleanup)
