"""Query op7_quality_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.quality_rules import judge


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
