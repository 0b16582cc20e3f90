"""Bounded samples of labelled documents, and running a fit on them in one task."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.lineage import checkpointed

#: Labelled rows of each class that a classifier is fitted on, about.
SAMPLE_ROWS = 1500
#: Characters of labelled text of each class that a fit takes, about. Only where the sampled documents are longer in all are
#: fewer rows taken; documents are never left out by their length.
SAMPLE_CHARS = 12_000_000
LEAST_ROWS = 100


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, weight, key) of about ``rows`` documents per label, taken by a hash of the id.

    ``weight`` is one over the share taken. ``labels`` has ``id_col`` and ``label``;
    several labels of one document count as the highest. The sampled ids are bounded
    by ``rows`` per class, so they are broadcast to the scan of the texts. Where the
    sampled texts of a class have more than SAMPLE_CHARS characters in all, they are
    thinned by the same hash, short and long ones alike, to LEAST_ROWS rows at least.
    """
    graded = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    shares = {r["label"]: min(1.0, rows / r["n"]) for r in graded.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return graded.select(F.lit("").alias("text"), "label", F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("key"))
    share = F.create_map(*[F.lit(v) for k in sorted(shares) for v in (k, shares[k])])
    picked = (
        graded.withColumn("key", F.xxhash64(F.lit(9), id_col))
        .withColumn("share", F.element_at(share, F.col("label")))
        .where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    )
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    taken = checkpointed(texts.join(F.broadcast(picked), id_col).select("text", "label", "share", "key"))
    sizes = taken.groupBy("label").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).collect()
    thinned = {r["label"]: min(1.0, max(SAMPLE_CHARS / max(r["chars"] or 0, 1), LEAST_ROWS / r["n"])) for r in sizes}
    if any(v < 1 for v in thinned.values()):
        left = F.create_map(*[F.lit(v) for k in sorted(thinned) for v in (k, thinned[k])])
        taken = taken.withColumn("left", F.element_at(left, F.col("label"))).where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.col("left") * float(1 << 30))
        taken = taken.withColumn("share", F.col("share") * F.col("left"))
    return taken.select("text", "label", (1 / F.col("share")).alias("weight"), "key")


def fitted(rows: DataFrame, fit: Callable[[list[str], list[int], list[float]], bytes]) -> bytes:
    """``fit`` of a bounded sample, run in one Spark task; empty bytes without rows."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "text"])
        return pd.DataFrame({"model": [fit(part["text"].tolist(), part["label"].tolist(), part["weight"].tolist())]})

    found = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(arrays.lean_group(learn), "model binary").collect()
    return bytes(found[0]["model"]) if found else b""
