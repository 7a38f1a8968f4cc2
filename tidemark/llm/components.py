"""Connected components of an edge table by alternating large and small stars; every step is a grouped minimum and a join.

A graph of at most SMALL edges (counted first) is one task's work: rounds of joins would cost more than it does."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


#: Edges of a graph that one task takes, 16 bytes each.
SMALL = 50_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of the edges of a small graph, by linking roots to the lesser root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the least of u and all its v; the minimum is combined map-side, so a hub isn't one group in a task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (the least node id reachable) for every node that has an edge; edges: u and v, long.

    The number of edges never grows; rounds follow the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= SMALL:
        named = settle(edges.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
        discard(edges)
        return named
    before = None
    for _ in range(most):
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _with_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, edges = edges, settle(small, "edges")
        discard(last)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            # A fixed point of both stars: every node points at the least of its component.
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            named = settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own), "components")
            discard(edges)
            return named
        before = after
    raise RuntimeError("components did not settle")
