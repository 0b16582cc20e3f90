"""Query op3_line_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm.line_dedup import decisions, repeated_lines


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class as lists (line numbers dropped, doc_id of the first line of each one's class) and its number of links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(decisions(repeated_lines(docs)), "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"), F.coalesce("repeats_of", none).alias("repeats_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
