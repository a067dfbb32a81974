"""Connected components of an edge list, with DataFrame joins only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy


EDGES_A_TASK = 500_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least of its component under the edges (a, b): roots of edges between trees are hooked to the smaller one, and trees flattened, until
    no edge joins two."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least node of each of its components."""
    held = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, 1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = roots(a, b, len(nodes))
    low = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(low), 50_000):
        part = low[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], ["c", "p"])


def _labels(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    return stars.select(F.col("c").alias("node"), F.col("p").alias("component")).unionByName(roots)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): for every node with an edge the least node of its component.

    Edges are first dealt to tasks of about EDGES_A_TASK, which turn theirs into stars; with one such task these are the answer. Then each
    round sends all parents of a node to the least of them and lets every node skip to its parent's parent; rounds
    grow with the logarithm of the longest path. Every round is written out, so lineage stays short.
    """
    rows = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    parts = rows.count() // EDGES_A_TASK + 1
    e = materialise(rows.repartition(parts).mapInArrow(tidy(local_stars), "c long, p long"))
    if parts == 1:
        return _labels(e)
    while True:
        least = e.groupBy("c").agg(F.min("p").alias("m"))
        e1 = e.join(least, "c").select(F.when(F.col("p") == F.col("m"), F.col("c")).otherwise(F.col("p")).alias("c"), F.col("m").alias("p")).filter("c <> p").distinct()
        up = e1.groupBy(F.col("c").alias("x")).agg(F.min("p").alias("m"))
        before = e
        e = materialise(e1.join(up, F.col("p") == F.col("x"), "left").select("c", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved")).distinct())
        discard(before)
        state = e.agg(F.bool_or("moved"), F.count("*")).first()
        if not state[1] or (not state[0] and e.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()):
            return _labels(e)
