"""Centroid clustering in exact integers: ball k-means.

Components are scaled and floored to integers, so sums, means and squared
distances are exact and no result depends on partitions. A cluster is a ball:
its centroid and a radius that no member exceeds. Centroid j is a neighbour of
i if it is nearer to centroid i than twice the radius of ball i; no other
centroid can be as near to a member of i. A member nearer to its centroid than
half the way to the nearest neighbour is in the stable core and stays. The
rest of the ball is cut into annuli by half the ways to the neighbours: a
member is compared exactly with the neighbours whose half way it reaches, and
with no others. The first assignment has no balls and compares all.

Each round reads and writes the vectors once, with their cluster and distance,
and adds up sums, counts and radii in the tasks; the driver holds the
centroids and their balls alone, which are as many as clusters. Vectors never
move between executors. A radius after a round is the largest distance
measured in it plus the way that the centroid went.

Kept are vectors of exactly ``dims`` components, none null or non-finite, whose
integers are at most 2**27 in size: beyond that a squared distance has no room
in a long. Repeated rows and ids count as often as they come; a vector without
an id is assigned but never starts a cluster. Starting ties (equal ids) go to
the smaller components. Fewer vectors than clusters make fewer clusters, an
empty table an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, stored

LARGEST = 1 << 27
_BATCH = 4096
_EXACT = 1 << 53  # doubles hold all integers up to it


@dataclass
class Balls:
    """Centroids, and for each one its neighbours by distance.

    ``near[i]`` are the neighbours of ball i, ``half[i]`` the squared half ways
    to them, rounded up; without balls (``near`` is None) every vector is
    compared with every centroid.
    """

    centres: np.ndarray
    near: list[np.ndarray] | None = None
    half: list[np.ndarray] | None = None


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres, as longs."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(centres).max(initial=0)), 1)
    if 4 * most * most * rows.shape[1] < _EXACT:
        a, b = rows.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(rows), len(centres)), np.int64)
    for j, c in enumerate(centres):
        d = rows - c
        out[:, j] = (d * d).sum(1)
    return out


def surround(centres: np.ndarray, radius: np.ndarray) -> Balls:
    """Neighbours of each ball; ``radius`` is an upper bound of a member's distance."""
    ways = squared(centres, centres)
    near, half = [], []
    for i in range(len(centres)):
        # as exact as needed: a centroid within 2 r (1 + 1e-9) is kept, and whether it matters is decided in integers
        close = [j for j in range(len(centres)) if j != i and math.sqrt(int(ways[i, j])) <= 2 * radius[i] * (1 + 1e-9)]
        order = sorted(close, key=lambda j, i=i: (int(ways[i, j]), j))
        near.append(np.array(order, np.int64))
        half.append((ways[i, order].astype(np.int64) + 3) // 4)
    return Balls(centres, near, half)


def assign(rows: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and the number of comparisons."""
    if balls.near is None:
        d = squared(rows, balls.centres)
        best = d.argmin(1)
        return best, d[np.arange(len(rows)), best], d.size
    best, least, made = cluster.copy(), np.zeros(len(rows), np.int64), len(rows)
    for i in np.unique(cluster):
        own = np.flatnonzero(cluster == i)
        at = rows[own]
        d = squared(at, balls.centres[i : i + 1])[:, 0]
        least[own] = d
        # a neighbour can be as near as the own centroid only if half the way to it is no longer than the distance
        reach = np.searchsorted(balls.half[i], d, "right")
        if not reach.any():
            continue  # all in the stable core
        out = np.flatnonzero(reach)
        most = int(reach.max())
        shown = balls.near[i][:most]
        for k in np.unique(reach[out]):  # annulus by annulus
            ring = out[reach[out] == k]
            far = squared(at[ring], balls.centres[shown[:k]])
            made += far.size
            numbers = np.append(shown[:k], i)
            far = np.concatenate([far, d[ring][:, None]], axis=1)
            order = np.argsort(numbers, kind="stable")
            pick = order[far[:, order].argmin(1)]
            best[own[ring]] = numbers[pick]
            least[own[ring]] = far[np.arange(len(ring)), pick]
    return best, least, made


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _assigned(balls: Balls, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column("vector"), dims)
            cluster, distance, _ = assign(rows, b.column("cluster").to_numpy(zero_copy_only=False), balls)
            cols = [b.column("vec_id"), b.column("vector"), pa.array(cluster, pa.int64()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "vector", "cluster", "distance"])

    return run


_PART = "cluster long, dim int, total decimal(38,0), n long, reach long"


def _sums(k: int, dims: int):
    """Sums of components (dim >= 0), and counts and largest squared distances (dim = -1), of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a component is at most 2**27, so 2**36 rows of one task fit in a long
        total, n, reach = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for b in batches:
            rows, cluster = _matrix(b.column("vector"), dims), b.column("cluster").to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            kinds, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(kinds):
                total[kinds] += np.add.reduceat(rows[order], starts, axis=0)
                n[kinds] += counts
                reach[kinds] = np.maximum(reach[kinds], np.maximum.reduceat(b.column("distance").to_numpy()[order], starts))
        has = np.flatnonzero(n)
        numbers = np.repeat(has, dims + 1)
        dim = np.tile(np.arange(-1, dims), len(has))
        sums = np.concatenate([np.zeros((len(has), 1), np.int64), total[has]], axis=1).ravel()
        cols = [pa.array(numbers, pa.int64()), pa.array(dim, pa.int32()), pa.array(sums, pa.int64()).cast(pa.decimal128(38, 0))]
        cols += [pa.array(np.where(dim < 0, x[numbers], 0), pa.int64()) for x in (n, reach)]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "dim", "total", "n", "reach"])

    return run


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and the integers ``floor(scale * x)`` of the kept vectors."""
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"))
    kept = rows.where((F.size("raw") == dims) & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.transform("raw", lambda x: F.floor(x * scale).cast("int")).alias("vector"))


def _state(rows: DataFrame, k: int, dims: int, old: Balls) -> tuple[np.ndarray, np.ndarray]:
    """New centroids (empty clusters keep theirs), and upper bounds of their members' distances."""
    parts = rows.select("vector", "cluster", "distance").mapInArrow(_sums(k, dims), _PART)
    sums = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("reach").alias("reach"))
    got = sums.collect()  # clusters times components
    count = {r.cluster: r.n for r in got if r.dim < 0}
    centres, radius = old.centres.copy(), np.zeros(k)
    for r in got:
        if r.dim >= 0:
            centres[r.cluster, r.dim] = int(r.total) // count[r.cluster]
    for r in got:
        if r.dim < 0:
            went = sum((int(a) - int(b)) ** 2 for a, b in zip(centres[r.cluster], old.centres[r.cluster], strict=True))
            radius[r.cluster] = math.sqrt(r.reach) + math.sqrt(went)
    return centres, radius


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors of smallest sha256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    base = scaled(vectors, id_col, vector_col, dims, scale)
    kind = dict(base.dtypes)["vec_id"]
    schema = f"vec_id {kind}, vector array<int>, cluster long, distance long"
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = base.where(F.col("vec_id").isNotNull()).orderBy(name, "vector").select("vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(first)
    balls = Balls(np.array([r.vector for r in first], np.int64).reshape(k, dims))
    rows = base.select("*", F.lit(0).cast("long").alias("cluster"))
    old = None
    for turn in range(rounds + 1):
        rows = stored(rows.mapInArrow(_assigned(balls, dims), schema), "clusters", batch=_BATCH)
        if old is not None:
            dropped(old)
        old = rows
        if turn < rounds:
            balls = surround(*_state(rows, k, dims, balls))
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in balls.centres]
    facts = spark.createDataFrame([(i, inertia[i], sum(inertia.values()), digest[i]) for i in inertia], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    out = rows.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
