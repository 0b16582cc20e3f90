"""Query op6_decontaminate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.decontaminate import matches


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds; documents without an item have no row."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
