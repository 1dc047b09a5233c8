"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.skew import lookup_join
from ridgeline.scratch import materialise, release

#: Edges that one task holds (48 MB of them and their nodes).
ONE_TASK = 2_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a graph in order, and of each the least node reachable."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[parent]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (above := parent[parent]).tobytes() != parent.tobytes():
            parent = above


def integer_components(edges: DataFrame) -> DataFrame:
    """``connected_components`` of edges between long identifiers; a graph of up to ``ONE_TASK`` edges is a single task's, so no rounds are needed.

    ``edges`` should be a written table: it is read more than once.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    if edges.count() > ONE_TASK:
        return connected_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]:
            nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def _star(edges: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours and the node itself are tied to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # v < u: the pair as seen from its smaller end
    moved = lookup_join(larger, least, "u", "inner", rows=rows).select(F.col("w").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Least node reachable from every node that has an edge: columns ``node`` and ``component``.

    ``edges`` has two columns of one ordered type.  Direction, repeated edges and loops don't matter; rows with a
    NULL end are left out.  Rounds alternate a min-star over larger neighbours with one over smaller ones, so paths
    shorten geometrically; each round is written to the shared folder, and the one before it deleted.  An edge-free input gives no rows.
    """
    a, b = edges.columns[:2]
    tidy = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a) != F.col(b))).distinct()
    tidy = materialise(tidy, "edges")
    rows = tidy.count()
    before = None
    for _ in range(max_rounds):
        if not rows:
            break
        starred = materialise(_star(tidy, rows), "edges")
        release(tidy)
        # small star: every node's smaller neighbours and itself are tied to the least of them
        least = starred.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        forked = starred.join(least.filter("n > 1"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tidy = forked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        tidy = materialise(tidy, "edges")
        release(starred)
        state = tidy.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = state[0]
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node but the least has one edge, to the least
    ends = tidy.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(tidy.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
