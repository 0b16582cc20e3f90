"""Query op5_language_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm.langid import fit, identify, remainder


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = fit(docs.where(remainder("doc_id", 4) != 2))
    scored = identify(docs.select("doc_id", "text"), fitted)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
