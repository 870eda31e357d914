"""Exact Lloyd clustering that skips vectors whose bounds, tightened by planar geometry, settle them.

Vectors are turned into integers, so all distances and sums are exact, ties go to the smaller
number, and the result depends neither on partitioning nor on the bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance to
all others. When centroids move, the lower bound of a vector in cluster i has to be loosened by what
another centroid, moving from p to q, can have come closer. The full drift |pq| is needed only for points
straight ahead of the move. All vectors of a cluster lie in a sphere around its centroid, and how
much closer a point comes depends on its place along the line pq and its distance from that line alone, so
the sphere is a disc in a plane. Points that come closer by s or more lie inside a hyperbola whose
asymptotes leave the midpoint of pq at the angle arccos(s / |pq|); a disc seen from the midpoint at an
angle of at least t from the move is outside of it for s = |pq| cos t. Spheres behind the midpoint need
no loosening at all.

A vector stays unscanned while its upper bound is below its lower bound, or below half of the way from its
centroid to the next one. The others get their exact distance to their own centroid, and, if that does
not decide, are compared with all centroids. Sums change by the vectors that changed their cluster only.

Vectors that are null, have another length or a component that is null or not finite are left out. Integers are
held within +-2**27, so that a distance fits a long. A null id takes part like any other and is hashed as
an empty one; rows that repeat are rows of their own, and of equal hashes the smaller vector comes
first. With fewer vectors than clusters there are as many clusters as vectors; an empty table gives an
empty result. An inertia beyond a long is null. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import discard, keep, text_bytes

LIMIT = 1 << 27
EXACT_FLOAT = 1 << 22  # components up to which sums of 64 products are exact in double precision
SLACK = 1e-9  # of bounds, above all rounding of double precision
ROWS = 8192
_STATE = "cluster int, before int, upper double, lower double"


# -- geometry -------------------------------------------------------------------------------------


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``[i, j]``: by how much centroid j can have come closer to points within ``radius[i]`` of the old centroid i."""
    move = new - old
    drift = np.sqrt((move**2).sum(axis=1))
    away = old[:, None, :] - (old + new)[None, :, :] / 2
    far = np.sqrt((away**2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ahead = np.arccos(np.clip((away * move[None]).sum(axis=2) / (far * drift), -1, 1))
        seen = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    angle = np.where(far > radius[:, None], np.maximum(ahead - seen, 0), 0)
    return np.where(drift > 0, drift * np.maximum(np.cos(np.where(drift > 0, angle, 0)) + SLACK, 0), 0)


class Step:
    """Centroids of a round, and how the bounds of the round before change."""

    def __init__(self, old: np.ndarray, new: np.ndarray, radius: np.ndarray):
        self.centroids = new
        was, now = old.astype(float), new.astype(float)
        self.drift = np.sqrt(((now - was) ** 2).sum(axis=1))
        closer = loosening(was, now, radius)
        gap = np.sqrt(((now[:, None] - now[None]) ** 2).sum(axis=2))
        np.fill_diagonal(closer, 0)
        np.fill_diagonal(gap, np.inf)
        self.closer, self.half_gap = closer.max(axis=1), gap.min(axis=1) / 2


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids, as integers."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_FLOAT:
        x, c = vectors.astype(float), centroids.astype(float)
        return ((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def own_squared(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((vectors - centroids[cluster]) ** 2).sum(axis=1)


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties to the smaller number), its distance, and the distance of the next one."""
    distance = squared(vectors, centroids)
    cluster = np.argmin(distance, axis=1)
    every = np.arange(len(vectors))
    upper = np.sqrt(distance[every, cluster].astype(float))
    if len(centroids) == 1:
        return cluster, upper, np.full(len(vectors), np.inf)
    distance[every, cluster] = np.iinfo(np.int64).max
    return cluster, upper, np.sqrt(distance.min(axis=1).astype(float))


def reassign(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New clusters and bounds, and which vectors had to be compared with all centroids."""
    was = cluster
    cluster, upper, lower = was.copy(), upper + step.drift[was], lower - step.closer[was]
    floor = np.maximum(lower, step.half_gap[was])
    unsettled = lambda rows: rows[upper[rows] * (1 + SLACK) + SLACK >= floor[rows] * (1 - SLACK)]
    open_rows = unsettled(np.arange(len(was)))
    upper[open_rows] = np.sqrt(own_squared(vectors[open_rows], step.centroids, was[open_rows]).astype(float))
    open_rows = unsettled(open_rows)
    cluster[open_rows], upper[open_rows], lower[open_rows] = scan(vectors[open_rows], step.centroids)
    return cluster, upper, lower, open_rows


# -- passes over the table ------------------------------------------------------------------------


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    data, _ = text_bytes(column)
    return np.ascontiguousarray(data).view(np.int32).reshape(-1, dims).astype(np.int64)


def integers(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, vector`` (32-bit integers in a row) of the usable rows of ``table(vec_id, embedding)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            whole = np.clip(np.floor(scale * value), -LIMIT, LIMIT).astype(np.int32)
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * dims)
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), raw], names=["vec_id", "vector"])

    unfit = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where((F.size("embedding") == dims) & ~unfit).select("vec_id", "embedding")
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, vector binary")


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of seed and id: at most ``k`` rows on the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, np.int32) for r in rows], np.int64).reshape(-1, dims)


def _assigned(state: DataFrame, centroids: np.ndarray, step: Step | None) -> DataFrame:
    """``vec_id, vector`` with cluster and bounds of the next round; ``step`` is None in the first."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                vectors = _vectors(batch.column("vector"), dims)
                if step is None:
                    before = np.full(len(vectors), -1)
                    cluster, upper, lower = scan(vectors, centroids)
                else:
                    before, upper, lower = (batch.column(n).to_numpy() for n in ("cluster", "upper", "lower"))
                    cluster, upper, lower, _ = reassign(vectors, before, upper, lower, step)
                columns = [
                    *(batch.column(n) for n in ("vec_id", "vector")),
                    *(pa.array(x.astype(np.int32)) for x in (cluster, before)),
                    *(pa.array(x) for x in (upper, lower)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "cluster", "before", "upper", "lower"])

    fields = state.select("vec_id", "vector").schema.fields
    return state.mapInArrow(run, StructType([*fields, *StructType.fromDDL(_STATE).fields]))


def _moved_sums(state: DataFrame, k: int, dims: int) -> dict[tuple[int, int], int]:
    """By how much the sum of each cluster and component changes: only vectors with a new cluster are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims), np.int64)
        for batch in batches:
            vectors = _vectors(batch.column("vector"), dims)
            cluster, before = (batch.column(n).to_numpy() for n in ("cluster", "before"))
            for c in range(k):
                total[c] += vectors[cluster == c].sum(axis=0) - vectors[before == c].sum(axis=0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], names=["c", "d", "n"])

    moved = state.where("cluster != before").select("vector", "cluster", "before")
    sums = moved.mapInArrow(run, "c long, d long, n long").groupBy("c", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return {(r.c, r.d): int(r.n) for r in sums.collect()}  # at most a row per cluster and component


def cluster_vectors(
    table: DataFrame, k: int = 40, rounds: int = 5, *, dims: int = 64, scale: int = 256, seed: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of every usable vector of ``table``, and the final centroids."""
    vectors = keep(integers(table, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, dims, seed)
    state, step, sums = vectors, None, {}
    for _ in range(rounds if len(centroids) else 0):
        before, state = state, keep(_assigned(state, centroids, step), "clusters")
        discard(before)
        sizes, radius = [0] * len(centroids), np.zeros(len(centroids))
        for row in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("far")).collect():
            sizes[row.cluster], radius[row.cluster] = row.n, row.far  # a row per cluster
        for cell, change in _moved_sums(state, len(centroids), dims).items():
            sums[cell] = sums.get(cell, 0) + change
        moved = centroids.copy()
        for c, n in enumerate(sizes):
            if n:
                moved[c] = [sums.get((c, d), 0) // n for d in range(dims)]
        step, centroids = Step(centroids, moved, radius * (1 + SLACK)), moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            distance = own_squared(_vectors(batch.column("vector"), dims), centroids, cluster)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    last = _assigned(state, centroids, step) if len(centroids) else state.withColumn("cluster", F.lit(0))
    fields = last.select("vec_id").schema.fields
    found = last.mapInArrow(run, StructType([*fields, *StructType.fromDDL("cluster int, distance long").fields]))
    return found, centroids


def cluster_report(
    table: DataFrame, k: int = 40, rounds: int = 5, *, dims: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """``cluster_vectors`` with the inertia of its cluster and of all, and the digest of its centroid, in every row."""
    found, centroids = cluster_vectors(table, k, rounds, dims=dims, scale=scale, seed=seed)
    found = keep(found, "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = table.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = inertia.agg(F.sum("own").cast("decimal(38,0)").alias("total"))
    facts = inertia.join(named, "cluster").join(F.broadcast(total)).select(
        "cluster",
        F.expr("try_cast(own AS long)").alias("cluster_inertia"),
        F.expr("try_cast(total AS long)").alias("inertia"),
        "centroid_sha256",
    )
    return found.join(F.broadcast(facts), "cluster").select(  # a row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
