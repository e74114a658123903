"""Connected components of an edge table, without ever holding the graph in one place.

Each round contracts edges inside partitions of bounded size by union-find, assigns every node that has a
smaller neighbour there to its smallest root, and keeps only the edges between roots that this leaves open.
Only local minima survive a round, so the table shrinks geometrically. Labels are then resolved backwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import truncate_lineage

#: Edges that one task contracts together.
TASK_EDGES = 500_000
STARS = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.fromiter((root(i) for i in range(len(nodes))), np.int64, len(nodes))
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _stars(batches):
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
    node, root = union_find(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that isn't its own; edges has two long columns.

    Self-loops, repeated and null edges are harmless; no edges give no rows.
    """
    a, b = edges.columns[:2]
    left = truncate_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")))
    rounds: list[DataFrame] = []
    while n := left.count():
        stars = truncate_lineage(left.repartition(max(1, -(-n // TASK_EDGES))).mapInArrow(_stars, STARS))
        if n <= TASK_EDGES:
            rounds.append(stars.select("node", F.col("root").alias("component")))
            break
        assigned = stars.groupBy("node").agg(F.min("root").alias("component"))
        assigned = _jumped(truncate_lineage(assigned))
        rounds.append(assigned)
        open_ = stars.join(assigned, "node").filter(F.col("root") != F.col("component")).select("root", F.col("component").alias("b"))
        to = assigned.select(F.col("node").alias("root"), F.col("component").alias("__to"))  # a root may be assigned itself, elsewhere
        open_ = open_.join(to, "root", "left").select(F.coalesce("__to", "root").alias("a"), "b")
        left = truncate_lineage(open_.filter("a != b").distinct())
    if not rounds:
        return stars_schema(edges)
    out = rounds[-1]
    for earlier in rounds[-2::-1]:
        later = out.select(F.col("node").alias("component"), F.col("component").alias("__to"))
        moved = earlier.join(later, "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
        out = truncate_lineage(moved.unionByName(out.join(earlier.select("node"), "node", "left_anti")))
    return out


def stars_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType([STARS.fields[0], T.StructField("component", T.LongType())]))


def _jumped(assigned: DataFrame) -> DataFrame:
    """Chains node -> m -> m' shortened until every component is no node of the same table."""
    while True:
        up = assigned.select(F.col("node").alias("component"), F.col("component").alias("__up"))
        if not assigned.join(up, "component", "left_semi").take(1):
            return assigned
        assigned = truncate_lineage(assigned.join(up, "component", "left").select("node", F.coalesce("__up", "component").alias("component")))
