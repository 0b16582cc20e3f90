"""Query op2_secret_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.secrets import scan


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
