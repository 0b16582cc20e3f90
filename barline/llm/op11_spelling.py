"""Query op11_spelling_variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.lineage import checkpointed
from barline.llm.spelling import variants, word_counts


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(checkpointed(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
