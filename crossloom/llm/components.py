"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Edges that a task contracts at a time, about.
EDGES = 500_000


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Ties each node's neighbours to the least of the node and its neighbours.

    edges: u, v in the directions to look along. The least neighbour is summed before the shuffle; a hub's
    edges then meet one row, and adaptive execution may split a hub's partition."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = edges.join(least, "u")
    if larger_only:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition's edges, EDGES at a time, a forest that connects the same nodes: node to least node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            nodes, place = np.unique(np.concatenate([x for pair in zip(*held) for x in pair]), return_inverse=True)
            i, j = place[: len(place) // 2], place[len(place) // 2 :]
            label = np.arange(len(nodes))
            while len(i):
                np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
                while not np.array_equal(up := label[label], label):
                    label = up
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
            leaf = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], ["u", "v"])
            held.clear()

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) > EDGES:
            yield from flush()
    yield from flush()


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge between two nodes; component is the least node reachable.

    Tasks first contract what edges they have to forests, which loses no connection and shortens chains. Every
    round then ends in a written table, so lineage stays short and a lost executor costs one round at most; the
    rounds end when the edges are stars. Null ends, self-edges and repeated edges change nothing; no edges
    give no rows."""
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = cut(ends.mapInArrow(_forests, "u long, v long").distinct(), "components", files)
    while True:
        roles = now.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("center")).union(now.select("v", F.lit(0), F.lit(1)))
        loose = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("center").alias("center")).where("leaf > 1 OR leaf = 1 AND center = 1")
        if loose.limit(1).count() == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, True).where("u <> v").distinct()
        now = cut(_toward_least(large, False).where("u <> v").distinct(), "components", files)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
