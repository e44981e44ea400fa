"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(_read(spark, sf_dir, "pages"), RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_repeats import suffix_repeats

    return suffix_repeats(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, match (best alignment as a share of an exact copy's score), contaminated, kept."""
    from .decontaminate import decontaminate

    out = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), keep_all=True)
    return out.select("doc_id", "match", "contaminated", (~F.col("contaminated")).alias("kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars and n_lines before, n_kept_chars and n_kept_lines after, kept_sha256 of the text that stays."""
    from .line_dedup import line_dedup

    lines = lambda: F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_before"), lines().cast("long").alias("n_lines"))
    out = line_dedup(docs, drop_empty=False)
    return out.select("doc_id", F.col("n_before").alias("n_chars"), "n_lines", F.length("text").cast("long").alias("n_kept_chars"), lines().cast("long").alias("n_kept_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_bpe import piece_bpe

    return piece_bpe(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import class_lm

    return class_lm(_read(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_url_filter takes from the rules alone: page_id, host, path, rule."""
    return op2_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of op3_quality_rules."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def class_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of op10_class_lm; the base score is rounded."""
    return op10_class_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_near_dedup, op2_url_filter, op3_quality_rules, op4_suffix_repeats, op5_decontaminate, op6_line_dedup, op7_language_id, op8_piece_bpe, op9_toxicity, op10_class_lm, url_rules, quality_base, class_lm_base)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from . import oracles as O

    return {"op1_near_dedup": O.NEAR_DEDUP, "op4_suffix_repeats": O.SUFFIX_REPEATS, "op6_line_dedup": O.LINE_DEDUP, "url_rules": O.url_rules(RULES), "quality_base": O.QUALITY_BASE, "class_lm_base": O.CLASS_LM_BASE}
