"""Query op10_packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm.packing import pack, tokenize

TOKENIZER = "word_bpe_49k.json"


def packed_digests(docs: DataFrame) -> DataFrame:
    pieces = tokenize(docs, public_tokenizers.path(TOKENIZER))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
