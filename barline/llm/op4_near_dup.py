"""Query op4_near_dup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.near_dup import classes


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its near-duplicates) and its number of exact copies."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
