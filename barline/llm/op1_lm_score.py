"""Query op1_lm_score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.langid import remainder
from barline.llm.lm_score import score


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainder 2 of crc32(doc_id as text) mod 7 is held out; remainder 6 is the fold that the weights are learned on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, remainder("doc_id", 7) == 2, remainder("doc_id", 7) == 6)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
