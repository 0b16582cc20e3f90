"""Query op8_toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm.labelled import fitted, sample
from barline.llm.langid import remainder
from barline.llm.toxicity import fit, score


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    model = fitted(sample(docs, labels, "toxic"), fit)
    return score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
