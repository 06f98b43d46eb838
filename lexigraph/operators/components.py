"""Connected components of edge tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Edges that a task contracts at a time: 16 bytes each.
CHUNK = 1_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the smallest node that each reaches, by pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        before, low = root, np.minimum(root[a], root[b])
        root = root.copy()
        for end in (before[a], before[b]):  # hook roots, not only ends, so that chains close fast
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _contracted(chunk: int):
    """A task's edges, chunk by chunk, as stars: every node but the roots, with the smallest node that the chunk's edges lead to."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars():
            node, root = labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            leaf = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(root[leaf])], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= chunk:
                yield stars()
        if held:
            yield stars()

    return run


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", chunk: int = CHUNK) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Every task contracts the edges that it reads to stars, in bounded chunks and
    without a shuffle; large-star and small-star steps (Kiveris et al., 2014) join
    what different tasks left apart, until every node has one root. A step is a
    minimum by key, combined before its shuffle, and one join, so a hub is never
    gathered in a task. Every round is written to the shared folder; what the
    next round reads as one split, it contracts at once. Edges with a null end,
    self loops and repeated edges are ignored; no edges give no rows.
    """
    contract = _contracted(chunk)
    as_edges = lambda df: df.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b").mapInArrow(contract, "a bigint, b bigint")
    now, k = scratch.save(as_edges(edges), f"{name}-0", small=True), 0
    while True:
        placed = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")))
        placed = placed.groupBy("node").agg(F.min("root").alias("component"), F.max("root").alias("other"))
        if not placed.where("component <> other").count():
            return placed.select("node", "component")
        k += 1
        stars = as_edges(now)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = scratch.save(as_edges(small), f"{name}-{k}", small=True)
        scratch.drop(f"{name}-{k - 1}")
