"""Query op13_embedding_whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.whitening import whiten


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
