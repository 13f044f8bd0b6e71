"""Connected components of a link table: stars inside batches, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard, frozen

#: Links that a task joins to stars at once.
BATCH = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links but the smallest one of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[left], root[right]), np.minimum(root[left], root[right])
        apart = high != low
        if not apart.any():
            below = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[below], nodes[root[below]]
        left, right = left[apart], right[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars, a bounded number of links at a time."""

    def contracted() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield contracted()
            held, rows = [], 0
    if rows:
        yield contracted()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of the bigint columns ``a``, ``b``.

    Tasks first join the links they read to stars.  Each round then hangs
    neighbours on the smallest node they know, from larger nodes first and then
    from smaller ones, until all links are stars: no node below another one has
    a second neighbour.  A round works on a written table; links with a null
    end and loops are left out.
    """
    given = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    links = frozen(given.mapInArrow(_joined, "u bigint, v bigint").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # What is joined back is a written table: a join fed by a shuffle alone can split a node with many links.
        near = frozen(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        if near.where("m < u AND n > 1").isEmpty():
            discard(near)
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        nearest = near.select("u", F.least("m", "u").alias("m"))
        large = frozen(both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = frozen(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, links = links, frozen(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old, near, large, least)
