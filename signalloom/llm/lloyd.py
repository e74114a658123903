"""Lloyd's k-means in exact whole numbers, by two trees.

A vector's component x becomes the whole number floor(SCALE * x). Vectors are gathered into blocks of BLOCK; each block gets a
cover tree once, which is stored with it in the shared folder: a node has a centre and a radius that holds all below. Its
children's centres are chosen greedily, over half the radius apart, and each point lies below the nearest of them.

Each round makes a tree over the centroids in the same way and walks both together, a level at a time: the distance of two
centres, less and plus both radii, bounds every distance between what lies below; a centroid node whose lower
bound is over another's upper bound is left out. Where one centroid remains, the whole vector node goes to it. Leaves that still have several are compared exactly. Bounds are in floating point with slack, so
they only ever leave too much in; ties are decided in whole numbers, by the smaller centroid.

Tasks return sums by centroid and component, as limbs of 40 bits, so that sums of any size stay exact; the driver holds k
centroids. Nothing is shuffled but those sums and the final (id, cluster, distance) rows' own storage.

Edge cases: vectors that are null, have another number of components, or hold a null or non-finite one are left out;
fewer vectors than k are a centroid each; a null id has no hash and comes last among starting centroids, equal hashes (repeated
ids) go by components; repeated rows are vectors of their own; an empty table gives no rows. Components of any
finite size stay exact; distances and inertia beyond 63 bits are given as 2^63 - 1. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, release_memory, table, truncate_lineage

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block and of a leaf.
BLOCK, LEAF = 1024, 24
#: Up to this size of components a squared distance fits 63 bits.
NARROW = 1 << 26
LIMB = 40
MOST = (1 << 63) - 1
#: Slack of bounds, as a share of the distances compared.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes of a cover tree in breadth-first order; children and points of a node are consecutive."""

    order: np.ndarray  # positions of the vectors, so that each node's are consecutive
    centre: np.ndarray  # of each node, the position of a vector
    radius: np.ndarray
    child: np.ndarray  # first child and number of children; none: a leaf
    children: np.ndarray
    first: np.ndarray  # within order
    size: np.ndarray


def cover_tree(x: np.ndarray, leaf: int) -> Tree:
    """x: n x d, n at least 1; leaves hold up to `leaf` vectors, or any number of equal ones."""
    order = np.arange(len(x))
    nodes: list[list] = []
    queue = [(0, len(x), 0.0)]
    at = 0
    while at < len(queue):
        a, z, reach = queue[at]
        at += 1
        own = order[a:z]
        p = x[own]
        d = _distances(p, p[0])
        radius = float(d.max())
        nodes.append([own[0], radius, len(queue), 0, a, z - a])
        if z - a <= leaf or radius == 0 or not np.isfinite(radius):
            continue
        reach = radius / 2
        near, which = d.copy(), np.zeros(len(own), np.int64)  # the first vector is its own child's centre again
        centres = 1
        while near.max() > reach:
            far = int(near.argmax())
            d = _distances(p, p[far])
            closer = d < near
            near[closer], which[closer] = d[closer], centres
            centres += 1
        by = np.argsort(which, kind="stable")
        order[a:z] = own[by]
        edge = a + np.concatenate([[0], np.cumsum(np.bincount(which, minlength=centres))])
        # a child's centre comes first in its range
        for c in range(centres):
            lo, hi = int(edge[c]), int(edge[c + 1])
            inner = near[by[lo - a : hi - a]]
            k = lo + int(inner.argmin())
            order[[lo, k]] = order[[k, lo]]
            queue.append((lo, hi, reach))
        nodes[-1][3] = centres
    centre, radius, child, children, first, size = (np.array(c) for c in zip(*nodes))
    return Tree(order, centre.astype(np.int64), radius.astype(float), child, children, first, size)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt((d * d).sum(1))


def whole(x: np.ndarray, narrow: bool) -> np.ndarray:
    """Whole-valued doubles as integers: of 64 bits, or Python's."""
    return x.astype(np.int64) if narrow else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def is_narrow(x: np.ndarray) -> bool:
    return not x.size or float(np.abs(x).max()) <= NARROW


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of centroids (the first of equals) and the squared distance; both in integers."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def walk(x: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Both trees downwards: nodes that go to one centroid as a whole, that centroid, and the leaves to compare, each with
    its candidate centroids in ascending order."""
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, in the order of v
    done_v, done_c, leaves = [], [], []
    while len(v):
        with np.errstate(invalid="ignore", over="ignore"):
            diff = x[tree.centre[v]] - centroids[over.centre[c]]
            d = np.sqrt((diff * diff).sum(1))
            spread = tree.radius[v] + over.radius[c]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            group = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
            least = np.minimum.reduceat(d + spread, start)[group]
            kept = ~(d - spread > least * (1 + SLACK) + SLACK)
        v, c = v[kept], c[kept]
        edge = np.concatenate([[True], v[1:] != v[:-1]])
        start, group = np.flatnonzero(edge), np.cumsum(edge) - 1
        n = np.diff(np.append(start, len(v)))
        inner = over.children[c] > 0  # centroid nodes that can be opened
        some = np.maximum.reduceat(inner, start)
        reach = np.maximum.reduceat(np.where(inner, over.radius[c], -1.0), start)
        node = v[start]
        is_leaf = tree.children[node] == 0
        single = ~some & (n == 1)
        done_v.append(node[single])
        done_c.append(c[start[single]])
        for i in np.flatnonzero(~some & ~single & is_leaf):
            leaves.append((node[i], c[start[i] : start[i] + n[i]]))
        open_c = some & (is_leaf | (reach >= tree.radius[node]))
        open_v = ~open_c & ~single & ~is_leaf
        # centroid nodes opened: those with children give way to them, the others stay
        p = np.flatnonzero(open_c[group])
        times = np.where(inner[p], over.children[c[p]], 1)
        v1 = np.repeat(v[p], times)
        c1 = np.repeat(np.where(inner[p], over.child[c[p]], c[p]), times) + _counted(times)
        # vector nodes opened: each child meets all that its parent met
        g = np.flatnonzero(open_v)
        kids = tree.children[node[g]]
        parent, which = np.repeat(g, kids), _counted(kids)
        v2 = np.repeat(tree.child[node[parent]] + which, n[parent])
        c2 = c[np.repeat(start[parent], n[parent]) + _counted(n[parent])]
        v, c = np.concatenate([v1, v2]), np.concatenate([c1, c2])
    number = np.array([over.order[a : a + n].min() for a, n in zip(over.first, over.size)])  # of equal centroids the smallest
    return np.concatenate(done_v), number[np.concatenate(done_c)], [(i, np.sort(number[candidates])) for i, candidates in leaves]


def _counted(times: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of times, one behind the other."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


# --- blocks

BLOCKS = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("x", T.BinaryType()), T.StructField("nodes", T.BinaryType())])


def blocks_of(vectors: DataFrame, id_col: str, vector: str, dim: int, scale: int) -> DataFrame:
    """Rows of up to BLOCK sound vectors: ids, whole components as doubles, and the cover tree with the sums of its nodes."""
    values = F.col(f"`{vector}`").cast("array<double>")
    sound = F.size(values) == dim
    limit = F.lit(float("inf"))
    sound &= ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == limit))
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("i"), values.alias("v")).filter(sound)
    bound_batches(vectors.sparkSession)
    most = BLOCK

    def made(ids: list, x: np.ndarray) -> pa.RecordBatch:
        x = np.floor(scale * x)
        t = cover_tree(x, LEAF)
        x, t.centre = x[t.order], np.argsort(t.order)[t.centre]
        i = pa.concat_arrays(ids).take(pa.array(t.order))
        nodes = np.stack([t.centre, t.child, t.children, t.first, t.size]).astype(np.int32).tobytes() + t.radius.tobytes()
        row = [pa.ListArray.from_arrays([0, len(i)], i), pa.array([x.tobytes()], pa.binary()), pa.array([nodes], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=BLOCKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for b in batches:
            for a in range(0, b.num_rows, most):
                part = b.slice(a, most)
                if n + part.num_rows > most:
                    yield made(ids, np.concatenate(parts))
                    ids, parts, n = [], [], 0
                ids.append(part.column(0))
                parts.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                n += part.num_rows
        if n:
            yield made(ids, np.concatenate(parts))
        release_memory()

    return src.mapInArrow(run, BLOCKS)


def block_of(x: bytes, nodes: bytes, dim: int) -> tuple[np.ndarray, Tree]:
    x = np.frombuffer(x, float).reshape(-1, dim)
    k = len(nodes) // 28
    centre, child, children, first, size = np.frombuffer(nodes, np.int32, 5 * k).reshape(5, k)
    return x, Tree(np.arange(len(x)), centre, np.frombuffer(nodes, float, k, 20 * k), child, children, first, size)


def assign(x: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> np.ndarray:
    """The number of the nearest centroid of each row of x."""
    out = np.empty(len(x), np.int64)
    nodes, to, leaves = walk(x, tree, centroids, over)
    out[np.repeat(tree.first[nodes], tree.size[nodes]) + _counted(tree.size[nodes])] = np.repeat(to, tree.size[nodes])
    narrow = is_narrow(x) and is_narrow(centroids)
    whole_centroids = whole(centroids, narrow)
    for node, own in leaves:
        a = tree.first[node]
        z = a + tree.size[node]
        out[a:z] = own[nearest(whole(x[a:z], narrow), whole_centroids[own])[0]]
    return out


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors and exact component sums by cluster; x in integers."""
    count, total = np.bincount(cluster, minlength=k), np.zeros((k, x.shape[1]), x.dtype)
    by, some = np.argsort(cluster, kind="stable"), np.flatnonzero(count)
    total[some] = np.add.reduceat(x[by], (np.cumsum(count) - count)[some])
    return count, total


def limbs(v: int) -> Iterator[int]:
    """v in limbs of LIMB bits, the lowest first, the last with the sign."""
    while not -(1 << LIMB) <= v < 1 << LIMB:
        yield v & ((1 << LIMB) - 1)
        v >>= LIMB
    yield v


SUMS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("cluster", "dim", "limb")] + [T.StructField("v", T.LongType())])


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of each centroid's vectors; those without any are missing."""
    k, dim = centroids.shape
    over = cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            for x, nodes in zip(b.column(0), b.column(1)):
                x, tree = block_of(x.as_py(), nodes.as_py(), dim)
                n, s = sums(whole(x, is_narrow(x)), assign(x, tree, centroids, over), k)
                count, total = count + n, total + s
        rows = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        rows += [(c, d, i, v) for c in range(k) if count[c] for d in range(dim) for i, v in enumerate(limbs(int(total[c, d])))]
        yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=SUMS.names)
        release_memory()

    found: dict[int, tuple[int, list[int]]] = {}
    # at most k x (dim + 1) sums of few limbs come to the driver
    got = blocks.select("x", "nodes").mapInArrow(run, SUMS).groupBy("cluster", "dim", "limb").agg(F.sum("v").alias("v")).orderBy("cluster", "dim").collect()
    for c, d, i, v in got:
        n, s = found.setdefault(c, (0, [0] * dim))
        if d < 0:
            found[c] = (v, s)
        else:
            s[d] += v << (LIMB * i)
    return found


def starting(blocks: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), 256)
    order = [F.col("h").asc_nulls_last(), F.col("v").asc()]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0), b.column(1)):
                v = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(x.as_py(), float)), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.values, v], names=["i", "v"])

    rows = blocks.select("ids", "x").mapInArrow(unpacked, "i long, v array<double>").select(name.alias("h"), "v").orderBy(*order).limit(k).collect()
    return np.array([r["v"] for r in rows]).reshape(-1, dim)


ASSIGNED = T.StructType([T.StructField("i", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(i, cluster, distance) of every vector."""
    dim, over = centroids.shape[1], cover_tree(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, nodes in zip(*b.columns):
                x, tree = block_of(x.as_py(), nodes.as_py(), dim)
                to = assign(x, tree, centroids, over)
                narrow = is_narrow(x) and is_narrow(centroids)
                d = ((whole(x, narrow) - whole(centroids, narrow)[to]) ** 2).sum(1)
                far = pa.array(d if narrow else [min(int(v), MOST) for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(to, pa.int32()), far], names=ASSIGNED.names)
        release_memory()

    return blocks.mapInArrow(run, ASSIGNED)


def lloyd(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = vectors.sparkSession
    blocks = truncate_lineage(blocks_of(vectors, id_col, vector, dim, scale))
    centroids = starting(blocks, k, seed, dim)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for c, (n, s) in cluster_sums(blocks, centroids).items():
            centroids[c] = [float(v // n) for v in s]
    rows = truncate_lineage(assigned(blocks, centroids))
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    names = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids]
    everything = min(sum(int(r["d"]) for r in total), MOST)
    facts = spark.createDataFrame([(r["cluster"], min(int(r["d"]), MOST), names[r["cluster"]]) for r in total] or [(-1, 0, "")], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(facts), "cluster")  # k rows
    return out.select(F.col("i").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(everything).cast("long").alias("inertia"), "centroid_sha256")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"))
