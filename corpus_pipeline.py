"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's documents. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barline.llm import decontaminate, langid, line_dedup, near_dup, packing
from barline.llm.components import components
from barline.llm.lineage import checkpointed
from barline.llm.op10_packing import TOKENIZER

#: SQL does not express models, edit joins and signatures; the stages are tested against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language identification rejects go."""
    models = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2))
    # The row travels as one column, so that no column of the documents clashes with a result.
    known = langid.identify(docs.select(F.col("text"), F.struct(*docs.columns).alias("row")), models)
    return known.where("accepted").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; a document of repeated lines only goes."""
    return line_dedup.deduplicate(docs)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key (the one column of ``keys``) is not in ``keys``; these are broadcast up to a checked number and shuffled beyond."""
    keys = checkpointed(keys)
    few = keys.count() <= near_dup.BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, keys.columns, "left_anti").select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number ``__row`` of their own, in the order of doc_id (null last); of equal rows with a doc_id one stays."""
    known = docs.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    rows = known.unionByName(docs.where(F.col("doc_id").isNull())).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return checkpointed(rows.withColumn("__row", F.monotonically_increasing_id()))


def as_before_line_dedup(spark: SparkSession, rows: DataFrame, key: str, sf_dir: str) -> DataFrame:
    """(key, text) with the text of ``documents`` for all rows that have lost lines since.

    Only ids that one row has on both sides are taken. Lengths are compared first, so
    no text moves but those that are asked for.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = rows.select("doc_id", F.col(key).alias("key"), F.length("text").alias("left"), F.lit(None).cast("int").alias("whole"))
    first = documents.select("doc_id", F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("left"), F.length("text").alias("whole"))
    both = own.unionByName(first).where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("n", F.count), ("of", F.max)) for c in ("left", "whole")], F.min(F.when(F.col("left").isNotNull(), F.col("key"))).alias("key"))
    shortened = checkpointed(both.where((F.col("n_left") == 1) & (F.col("n_whole") == 1) & (F.col("of_left") < F.col("of_whole"))).select("doc_id", "key"))
    few = shortened.count() <= near_dup.BROADCAST_IDS
    return documents.join(F.broadcast(shortened) if few else shortened, "doc_id").select(F.col("key").alias(key), "text")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near-duplicates (one row of it, if its row is repeated).

    A document is compared by its text and, where line deduplication has taken lines
    from it, by its text in ``documents`` too: of a near copy, only the lines that
    differ are left by then, which resemble nothing. Different texts of one doc_id are
    documents of their own. Documents without a doc_id come after all others.
    """
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    beyond = ends["high"] is not None and 2 * ends["high"] - ends["low"] + 1 >= 1 << 62
    unclear = beyond or not checkpointed(counted.where("n > 1 OR doc_id IS NULL").select("doc_id")).isEmpty()
    key = "__row" if unclear else "doc_id"
    rows = numbered(docs) if unclear else docs
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    high = ends["high"] if ends["high"] is not None else 0
    offset = high - (ends["low"] or 0) + 1  # keys above ``high`` are of texts before line deduplication
    before = as_before_line_dedup(spark, rows, key, sf_dir).select((F.col(key) + offset).alias(key), "text")
    classes = checkpointed(near_dup.classes(rows.select(key, "text").unionByName(before), id_col=key))
    doc = F.when(F.col("doc_id") > high, F.col("doc_id") - offset).otherwise(F.col("doc_id"))
    found = classes.select(doc.alias("key"), "class_id").distinct()
    # The classes of the two texts of one document are one class.
    joined = checkpointed(found.groupBy("key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")))
    merged = components(joined.where("a != b").select("a", "b"))
    whole = joined.join(merged, F.col("a") == F.col("node"), "left").select("key", F.coalesce("component", "a").alias("class"))
    least = whole.groupBy("class").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dropped = whole.join(least, "class").where("key != least").select(F.col("key").alias(key))
    return without(rows, dropped).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by their text alone: rows without a doc_id or with a shared one are judged like all others."""
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    found = decontaminate.matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__text")
    return without(keyed, found.select(F.col("doc_id").alias("__text")).distinct()).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (little-endian uint32) with their place in sequences of 2048."""
    pieces = packing.tokenize(docs, public_tokenizers.path(TOKENIZER)).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each cut off from the one before by a checkpoint."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
