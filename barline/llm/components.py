"""Connected components of links: of up to FEW_LINKS in one task, of more by alternating large-star and small-star steps.

Each step is a grouped minimum, pre-aggregated before the shuffle, and a join with
it. Up to BROADCAST_EDGES edges that join is a broadcast; beyond, a node with very
many links is split by the skew join. The links never leave the cluster. Edges
shrink to stars whose centre is the least node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.lineage import checkpointed, release


#: Links (two numbers each) that one task joins; the rounds of steps and shuffles that more of them need cost far more.
FEW_LINKS = 1 << 19
#: Edges (two numbers each) up to which the least neighbours of all nodes are broadcast.
BROADCAST_EDGES = 1_000_000


def _toward_least(edges: DataFrame, larger_only: bool, few: bool) -> DataFrame:
    """Links every neighbour (or those above the node itself) with the least node of the neighbourhood."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = edges.join(F.broadcast(least) if few else least, "a")
    if larger_only:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a centre, or a leaf of one centre alone; edges lead from leaf (a) to centre (b)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 OR leaf + centre > 1").isEmpty()


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the links (a, b), and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(a):
        # The least node so far of each end is linked with that of the other end, then chains are cut short.
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(least, shorter := least[least]):
            least = shorter
        a, b = least[a], least[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[least]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[column.to_numpy() for column in batch.columns] for batch in batches]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(*map(np.concatenate, zip(*ends)))], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the least node.

    Null ends and links of a node with itself are left out. No links: an empty table.
    Stars whose centre is the least node are what the steps end with, so links that
    are such stars already need none. Links are read twice, so they should come from
    a checkpoint.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if known.count() <= FEW_LINKS:
        return checkpointed(known.coalesce(1).mapInArrow(arrays.lean(_in_one_task), "node long, component long"))
    edges = checkpointed(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = edges.count() <= BROADCAST_EDGES
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both, True, few).where(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = checkpointed(_toward_least(down, False, few).where(F.col("a") != F.col("b")).distinct())
        few = edges.count() <= BROADCAST_EDGES
        release(links.sparkSession)
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
