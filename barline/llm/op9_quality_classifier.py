"""Query op9_quality_classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm.labelled import fitted, sample
from barline.llm.langid import remainder
from barline.llm.quality_classifier import fit, grade


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 low quality, 1 good but toxic, 2 good and clean; good with unknown toxicity, or of unknown quality, has none."""
    good = F.col("quality") == 1
    return labels.withColumn("grade", F.when(F.col("quality") == 0, 0).when(good & (F.col("toxic") == 1), 1).when(good & (F.col("toxic") == 0), 2))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on labelled documents with crc32(doc_id as text) mod 4 other than 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = ratings(spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2))
    model = fitted(sample(docs, labels, "grade"), fit)
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return grade(docs, model).select("doc_id", held_out, "quality_score", "expected_grade", "p_good", "kept")
