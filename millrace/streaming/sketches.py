"""Structured Streaming twins of the batch sketches.

A file of ids is a micro-batch (``maxFilesPerTrigger`` = 1). State that must outlive a batch is a small table in
the shared folder (bits, items seen), one partition a batch, which a batch that is run again replaces; a reservoir's
slots are a bounded dictionary in the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import linear_hash
from ..operators import sketches
from ..session import shared_dir


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n) by event-time windows with a watermark."""
    t = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return t.groupBy(F.window("_ts", width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("w.start", "key", "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``each(batch, number)`` over all that is there, then stops."""
    stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


class BloomStream:
    """Bloom filter over a stream of ids; ``rows`` has (batch, n, positives, false_positives, fpr).

    Bits are a table of at most ``size`` rows for each batch that set them; a batch is tested before it is added.
    """

    def __init__(self, spark: SparkSession, size: int, coefficients=None, name: str = "bloom"):
        self.spark, self.size, self.cs = spark, size, coefficients or sketches.COEFFICIENTS
        self.bits = f"{shared_dir(spark)}/{name}-bits"
        self.seen = f"{shared_dir(spark)}/{name}-seen"
        self.rows: list[tuple] = []

    def _bits_of(self, items: DataFrame) -> DataFrame:
        return items.select("item", F.explode(F.array(*[linear_hash(F.col("item"), a, b, sketches.PRIME, self.size) for a, b in self.cs])).alias("bit"))

    def _table(self, path: str, schema: str) -> DataFrame:
        t = self.spark.read.schema(schema).parquet(path) if self.rows else self.spark.createDataFrame([], schema)
        return t.where(F.col("batch") < len(self.rows))

    def add(self, batch: DataFrame, number: int) -> None:
        """``number`` is the stream's batch; a batch that is run again after a failure replaces its own rows."""
        number = len(self.rows)
        items = batch.select(F.col("user_id").cast("long").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
        items.persist()
        bits, seen = self._table(self.bits, "bit long, batch int").select("bit").distinct(), self._table(self.seen, "item long, batch int").select("item")
        hit = self._bits_of(items).join(bits.withColumn("on", F.lit(1)), "bit", "left").groupBy("item").agg(F.min(F.coalesce("on", F.lit(0))).alias("positive"))
        t = items.join(hit, "item").join(seen.withColumn("was", F.lit(1)), "item", "left")
        n, p, fp = t.agg(F.sum("n"), F.sum(F.col("n") * F.col("positive")), F.sum(F.when(F.col("was").isNull(), F.col("n") * F.col("positive")).otherwise(0))).first()
        new = items.join(seen, "item", "left_anti")
        self._bits_of(new).select("bit").distinct().join(bits, "bit", "left_anti").write.mode("overwrite").parquet(f"{self.bits}/batch={number}")
        new.select("item").write.mode("overwrite").parquet(f"{self.seen}/batch={number}")
        items.unpersist()
        den = n - p + fp
        self.rows.append((number, n, p, fp, round(fp / den, 6) if den else None))

    def result(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "batch long, n long, positives long, false_positives long, fpr double")


class FmStream:
    """Flajolet-Martin estimate of each micro-batch beside its exact distinct count."""

    def __init__(self, spark: SparkSession, size: int, coefficients=None):
        self.spark, self.size, self.cs, self.rows = spark, size, coefficients, []

    def add(self, batch: DataFrame, number: int) -> None:
        b = batch.select(F.lit(len(self.rows)).cast("long").alias("batch"), F.col("user_id").cast("long").alias("item"))
        self.rows += [tuple(r) for r in sketches.flajolet_martin(b, self.size, self.cs).collect()]

    def result(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "batch long, truth long, estimate long")


class ReservoirStream:
    """Fixed-size sample over (seq, item) micro-batches: the state is ``size`` rows."""

    def __init__(self, spark: SparkSession, size: int):
        self.spark, self.size, self.slots, self.trace = spark, size, {}, []

    def add(self, batch: DataFrame, number: int) -> None:
        for r in sketches.reservoir(batch, "seq", "item", self.size).collect():  # at most `size` rows
            self.slots[r["slot"]] = (r["item"], r["n"])
        self.trace.append(dict(self.slots))

    def result(self) -> DataFrame:
        return self.spark.createDataFrame([(int(k), v[0], int(v[1])) for k, v in self.slots.items()], "slot long, item long, n long")
