"""Scans and sinks: Parquet tables, CSV, JSON lines, report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING_SCHEMA = "user_id string, business_id string, stars double"
REVIEW_SCHEMA = "user_id string, business_id string, stars double, date string"
BUSINESS_SCHEMA = "business_id string, city string, state string, stars double, review_count int, latitude double, longitude double, categories string, hours map<string,string>"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; fields that aren't in the schema are never parsed into columns, bad lines are null rows."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, quote='"', escape='"')


def read_points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """id, label and a vector from headerless rows ``id, label, d1 .. dn``."""
    cols = ", ".join(f"d{k} double" for k in range(dims))
    raw = spark.read.schema(f"id long, label int, {cols}").csv(path)
    return raw.select("id", "label", F.array(*[f"d{k}" for k in range(dims)]).alias("point"))


def read_text_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A file-source stream of one user id a line."""
    return spark.readStream.schema("user_id string").option("maxFilesPerTrigger", files_per_batch).csv(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header; ``one_file`` only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json_document(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, line: Column, path: str, order: list[Column] | None = None) -> None:
    """A text report of one expression a row, ordered."""
    out = df.orderBy(*order) if order else df
    out.select(line.cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def to_json_report(**parts: DataFrame) -> DataFrame:
    """One row with a column for each part: arrays of its rows. For top-k lists and other small results."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
