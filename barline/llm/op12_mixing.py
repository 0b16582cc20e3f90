"""Query op12_source_mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.mixing import mix


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
