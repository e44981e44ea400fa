"""A training corpus from raw documents: quality, line and near-duplicate filters, decontamination, token ids.

Defined results, for every stage: null and empty texts fail the quality rules; no
other stage removes them. Of rows that are equal in id and text, all stay or all
go, as they are one document to each stage. Near-duplicates are told apart by id:
rows of one id go together, whatever their texts; a row without an id is
compared with nothing and stays. Extra columns pass through the filters (n_chars
is set anew where lines go). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._sieve import anti_join
from millrace.llm._store import settle, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.line_dedup import line_dedup
from millrace.llm.near_dedup import near_dedup
from millrace.llm.piece_bpe import piece_bpe
from millrace.llm.quality_rules import quality_rules


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The verdict depends on text and language only, so these are the key."""
    key = F.struct(F.xxhash64("text", "lang").alias("h"), F.length("text").alias("n"))
    bad = quality_rules(docs.select(key.alias("key"), "text", "lang"), doc_id="key").where(~F.col("kept")).select("doc_id.h", "doc_id.n").distinct()
    bad, _ = table(bad.withColumnsRenamed({"h": "__mr_bh", "n": "__mr_bn"}), "rejected")
    h = F.xxhash64("text", "lang")
    return anti_join(docs, bad, h, F.col("__mr_bh"), (h == F.col("__mr_bh")) & F.length("text").eqNullSafe(F.col("__mr_bn")))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that lose all their words."""
    return line_dedup(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group."""
    bad, _ = table(near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__mr_bad")).distinct(), "copies")
    return anti_join(docs, bad, F.xxhash64("doc_id"), F.xxhash64("__mr_bad"), F.col("doc_id") == F.col("__mr_bad"))


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an exact or edited item of ``benchmark`` go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document that is left."""
    import public_tokenizers

    return piece_bpe(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True)


def _settled(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Begins with the memory that the stage before has left: else heaps stay as large as the largest stage made them, beside the Python of all others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _settled(f)) for name, f in (("quality rules", _quality), ("line dedup", _lines), ("near-duplicates", _near), ("decontamination", _benchmark), ("encoding", _encode))]

#: Perplexity, likelihoods and alignments have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
