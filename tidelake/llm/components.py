"""Connected components of an edge table: contracted within tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready_for_checkpoints

#: Edges that a task contracts by itself.
LOCAL = 500_000


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the edges of one task: every node with the smallest node that they connect it to."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    both = np.concatenate(parts, axis=1)
    nodes, ends = np.unique(both, return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:  # minima over edges, then shortened paths
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        while (new != (shorter := new[new])).any():
            new = shorter
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[root[at]])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: columns a, b (long, not null). Returns node, root for every node but the roots; a root is its component's smallest node.

    Each task first replaces its LOCAL edges by stars of what they connect, so few rounds are left. A hub's edges are aggregated
    before they are shuffled and joined with its minimum by a join that Spark can split. No edge is collected; every round is a checkpoint.
    """
    ready_for_checkpoints(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = _state(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tasks = -(-before[0] // LOCAL)
    e = e.coalesce(tasks).mapInArrow(_contracted, "a long, b long").checkpoint()
    if tasks == 1:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        e = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        inner = e.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = inner.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        now = _state(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
