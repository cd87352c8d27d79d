"""Centroid clustering on integers: each round a vantage-point tree over the centroids goes to all tasks.

A task searches the tree for a batch of vectors at a time; every vector follows its own best-first order: of the nodes it
may still have to see, it takes the one with the least lower bound, and is done when that bound exceeds its best distance.
Bounds come from floating-point roots and are widened by more than their error; the comparison is inclusive, so centroids at
equal distance are all seen and the least number wins. Distances themselves are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import staged
from schemaloom.shipping import ship

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Centroids in a leaf; vectors searched at a time.
LEAF, TOGETHER = 3, 2048
#: Components are below this in size, so that a squared distance over 64 of them fits into a long.
LARGEST = 1 << 27
_FAR = np.iinfo(np.int64).max
#: More than the relative error of roots and their differences.
_SLACK = 1e-12


@dataclass
class Node:
    """A leaf has `members`; an inner node a vantage point and two children with the range of their distances from it."""
    members: list[int]
    point: int = -1
    children: list[tuple[int, float, float]] = field(default_factory=list)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = vectors - centroid
    return np.einsum("ij,ij->i", off, off)


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes, the root first. The vantage point is the member with the widest range of distances to the others."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members))
        if len(members) <= leaf:
            return at
        spans = [np.ptp(squared(centroids[members], centroids[m])) for m in members[:64]]
        point = members[int(np.argmax(spans))]
        rest = [m for m in members if m != point]
        distance = squared(centroids[rest], centroids[point])
        order = np.argsort(distance, kind="stable")
        half = len(order) // 2
        children = []
        for part in (order[:half], order[half:]):
            if len(part):
                low, high = np.sqrt(float(distance[part[0]])), np.sqrt(float(distance[part[-1]]))
                children.append((grow([rest[i] for i in part]), low, high))
        nodes[at] = Node([], point, children)
        return at

    if len(centroids):
        grow(list(range(len(centroids))))
    return nodes


def nearest(vectors: np.ndarray, centroids: np.ndarray, nodes: list[Node], seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) per row; ties go to the smaller number. seen: counts distances, for tests."""
    rows = np.arange(len(vectors))
    best, who = np.full(len(vectors), _FAR), np.full(len(vectors), len(centroids))
    waiting = np.full((len(vectors), len(nodes)), np.inf)
    waiting[:, 0] = 0.0

    def met(at: np.ndarray, c: int) -> np.ndarray:
        d = squared(vectors[at], centroids[c])
        better = (d < best[at]) | ((d == best[at]) & (c < who[at]))
        best[at[better]], who[at[better]] = d[better], c
        if seen is not None:
            seen.append(len(at))
        return d

    open_ = rows
    while len(open_):
        node = waiting[open_].argmin(axis=1)
        bound = waiting[open_, node]
        going = np.isfinite(bound) & (bound <= np.sqrt(best[open_].astype(float)) * (1 + _SLACK))
        open_, node = open_[going], node[going]
        waiting[open_, node] = np.inf
        for k in np.unique(node):
            at, here = open_[node == k], nodes[k]
            for c in here.members:
                met(at, c)
            if here.point >= 0:
                d = np.sqrt(met(at, here.point).astype(float))
                for child, low, high in here.children:
                    waiting[at, child] = np.maximum(0.0, np.maximum(d - high, low - d) - _SLACK * (d + high))
    return who, best


def usable(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """Has the vector `dimensions` components, none of them null, non-finite or beyond what a squared distance can hold?"""
    limit = float(LARGEST // scale)
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= limit))
    return F.coalesce((F.size(embedding) == dimensions) & ~odd, F.lit(False))


def integers(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per centroid and component and numbers of vectors: a task adds up what it read, the rest is clusters x dimensions rows."""
    k, dimensions = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))  # k centroids

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, nodes = shared.value
        sums, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                x = _matrix(b.column(0).slice(at, TOGETHER), dimensions)
                who, _ = nearest(x, centroids, nodes)
                order = np.argsort(who, kind="stable")
                starts = np.flatnonzero(np.diff(who[order], prepend=-1))
                sums[who[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
                count += np.bincount(who, minlength=k)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(there, dimensions).astype(np.int32)), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(there))),
             pa.array(sums[there].ravel()), pa.array(np.repeat(count[there], dimensions))], ["cluster", "i", "s", "n"])

    rows = (vectors.select("v").mapInArrow(added, "cluster int, i int, s long, n long").groupBy("cluster", "i")
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect())  # clusters x dimensions rows
    shared.destroy()
    sums, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
    for r in rows:
        sums[r["cluster"], r["i"]], count[r["cluster"]] = r["s"], r["n"]
    return sums, count


def fit(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after `rounds` rounds over `vectors` (v: array<int>); a centroid without vectors stays as it is."""
    centroids = start
    for _ in range(rounds if len(start) else 0):
        sums, count = _sums(vectors, centroids)
        moved = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
        if (moved == centroids).all():
            break  # further rounds would give the same again
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance per row of `vectors` (vec_id, v)."""
    dimensions = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, nodes = shared.value
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                who, best = nearest(_matrix(part.column(1), dimensions), centroids, nodes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v").mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long")


def cluster(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of `embeddings`.

    Rows that are not `usable` are left out. Starts are the vectors with the least hashes of their ids; a null id never
    starts unless there are too few others, and of equal ids the lesser vector comes first. With fewer vectors than
    `clusters` each is a start. Repeated rows are vectors like others. Sums of distances beyond a long are null.
    """
    spark = embeddings.sparkSession
    ship(spark)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    v = F.col(embedding)
    vectors = staged(embeddings.where(usable(v, dimensions, scale)).select(F.col(vec_id).alias("vec_id"), integers(v, scale).alias("v")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions)
    centroids = fit(vectors, start, rounds)
    found = staged(assign(vectors, centroids))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row per cluster
    total = None if None in sums.values() or sum(sums.values()) > _FAR else sum(sums.values())
    about = [(k, sums[k], total, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k in sorted(sums)]
    return (found.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
