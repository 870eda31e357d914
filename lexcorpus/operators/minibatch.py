"""Mini-batch k-means over sparse text vectors, and the nearest of given centers.

Batches are slices of a seeded hash order of the keys, so they do not depend on partitioning. A batch is
compared with the centers in tasks, which give out the sum of the vectors and the number of rows per center;
one grouping combines them, and each center moves towards the mean of its new rows with a step that
shrinks as 1 / (rows it has seen). Weights are summed as multiples of 2**-30, which are exact in any
order. Only sums (centers x vocabulary at most) and the rows of the first batch, which choose the
first centers, reach the driver. The rows of all batches are written once, a folder per batch, so
a fit reads its sample of a large table and not the table again and again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .sampling import hash_order, sample_exact

UNIT = float(1 << 30)
BATCH_ROWS = 2048
BATCHES = 100
PATIENCE = 10
TOLERANCE = 1e-4
FIRST_TRIES = 3
FILE_ROWS = 50_000


def sparse_parts(column: str = "features") -> tuple[Column, Column]:
    """Places and weights of a sparse vector column."""
    vector = F.unwrap_udt(column)
    return vector["indices"].alias("at"), vector["values"].alias("w")


def _rows(at: pa.Array, w: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places, all weights, and where each row begins."""
    size = np.asarray(at.value_lengths().fill_null(0))
    start = np.concatenate([[0], np.cumsum(size)])
    return at.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), start


def _distances(at: np.ndarray, w: np.ndarray, start: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """``[center, row]``: squared distances."""
    dot, own = np.zeros((len(centers), len(start) - 1)), np.zeros(len(start) - 1)
    filled = np.flatnonzero(np.diff(start))
    if len(filled):
        dot[:, filled] = np.add.reduceat(centers[:, at] * w, start[filled], axis=1)
        own[filled] = np.add.reduceat(w * w, start[filled])
    return np.maximum((centers**2).sum(axis=1)[:, None] - 2 * dot + own, 0)


def nearest_center(centers: np.ndarray, column: str = "features") -> Column:
    """Number of the nearest center of a vector column; ties go to the smaller number."""

    @F.arrow_udf("int")
    def nearest(at: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(_distances(*_rows(at, w), centers).argmin(axis=0).astype(np.int32))

    return nearest(*sparse_parts(column))


def inertia(features: DataFrame, centers: np.ndarray, column: str = "features") -> float:
    """Sum of the squared distances of all rows to their nearest center."""
    return _step(features.select(*sparse_parts(column)), centers)[2]


def _step(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Per center the sum of its rows' vectors and their number; and the inertia."""
    k, size = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, away = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            at, w, start = _rows(batch.column("at"), batch.column("w"))
            distance = _distances(at, w, start, centers)
            own = distance.argmin(axis=0)
            np.add.at(total, (np.repeat(own, np.diff(start)), at), np.rint(w * UNIT).astype(np.int64))
            count += np.bincount(own, minlength=k)
            away += int(np.rint(distance.min(axis=0, initial=np.inf) * UNIT).sum()) if len(own) else 0
        c, i = np.nonzero(total)
        seen = np.flatnonzero(count)
        columns = [
            np.concatenate([c, seen, [0]]),
            np.concatenate([i, np.full(len(seen), -1), [-2]]),
            np.concatenate([total[c, i], count[seen], [away]]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["c", "i", "n"])

    sums = points.mapInArrow(run, "c long, i long, n long").groupBy("c", "i").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most centers x (vocabulary + 1) + 1 rows
    c, i, n = (table.column(name).to_numpy() for name in ("c", "i", "n"))
    total, count = np.zeros((k, size)), np.zeros(k)
    words, rows = i >= 0, i == -1
    total[c[words], i[words]] = n[words] / UNIT
    count[c[rows]] = n[rows]
    return total, count, float(n[i == -2].sum()) / UNIT


def _uniform(seed: int, turn: str) -> float:
    return int(hashlib.md5(f"{seed}:{turn}".encode()).hexdigest()[:8], 16) / 2**32


def first_centers(rows: list[tuple[list[int], list[float]]], k: int, size: int, seed: int) -> np.ndarray:
    """k-means++ over the given rows: of a few rows drawn by squared distance the one that helps most is the next center.

    The best of ``FIRST_TRIES`` sets of centers is taken.
    """
    at = pa.array([r[0] for r in rows], pa.list_(pa.int64()))
    w = pa.array([r[1] for r in rows], pa.list_(pa.float64()))
    at, w, start = _rows(at, w)

    def dense(row: int) -> np.ndarray:
        out = np.zeros(size)
        out[at[start[row] : start[row + 1]]] = w[start[row] : start[row + 1]]
        return out

    trials, best = 2 + int(np.log(k)), None
    for attempt in range(FIRST_TRIES):
        centers = [dense(int(_uniform(seed, f"{attempt}:0:0") * len(rows)))]
        away = _distances(at, w, start, np.array(centers))[0]
        while len(centers) < min(k, len(rows)):
            reach = np.cumsum(away)
            goals = [_uniform(seed, f"{attempt}:{len(centers)}:{t}") * reach[-1] for t in range(trials)]
            drawn = np.array([dense(min(int(row), len(rows) - 1)) for row in np.searchsorted(reach, goals, "right")])
            closer = np.minimum(away, _distances(at, w, start, drawn))
            best_drawn = closer.sum(axis=1).argmin()
            centers.append(drawn[best_drawn])
            away = closer[best_drawn]
        if best is None or away.sum() < best[0]:
            best = away.sum(), np.array(centers)
    return best[1]


def _batches(points: DataFrame, rows: int, seed: int, size: int, count: int) -> Iterator[DataFrame]:
    """``count`` batches of the order of ``seed``, then of ``seed + 1`` and so on, each with its rows' ``place``.

    Rows are numbered by hash and key only, and no more of them than all batches take: a size that the
    caller has chosen. If one batch takes all rows, every batch is the whole table.
    """
    per_pass, made = -(-rows // size), 0
    while made < count:
        taken = min(per_pass, count - made)
        place = F.row_number().over(Window.orderBy(hash_order(seed, "id"), "w")) - 1
        picked = sample_exact(points, size * taken, seed, "id") if size * taken < rows else points
        numbered = picked.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size).cast("int"))
        file = F.floor(F.col("place") % size / FILE_ROWS).cast("int")
        stored = materialize(numbered.repartition("batch", file), "batches", "batch")
        if per_pass == 1:
            while made < count:
                made += 1
                yield stored
        for number in range(taken):
            made += 1
            yield stored.where(F.col("batch") == number)
        seed += 1


def fit_minibatch(
    features: DataFrame,
    vocabulary_size: int,
    k: int = 10,
    seed: int = 42,
    key: str = "id",
    column: str = "features",
    batch_rows: int = BATCH_ROWS,
    batches: int = BATCHES,
    patience: int = PATIENCE,
) -> np.ndarray:
    """``[center, term]``: centers after at most ``batches`` batches of ``batch_rows`` rows.

    When a pass through the order has used up the rows, the next one takes another order. The fit ends
    early when the smoothed inertia has not fallen by ``TOLERANCE`` for ``patience`` batches. With fewer rows than
    centers there are as many centers as rows.
    """
    points = materialize(features.select(F.col(key).alias("id"), *sparse_parts(column)), "points")
    rows = points.count()
    if not rows:
        return np.zeros((0, vocabulary_size))
    smooth = min(1.0, 2.0 * batch_rows / (rows + 1))
    centers, seen, level, least, idle = None, None, None, np.inf, 0
    for batch in _batches(points, rows, seed, batch_rows, batches):
        if centers is None:
            drawn = batch.orderBy("place").select("at", "w").collect()  # batch_rows rows
            centers = first_centers([(r.at, r.w) for r in drawn], k, vocabulary_size, seed)
            seen = np.zeros(len(centers))
        total, count, away = _step(batch.select("at", "w"), centers)
        seen += count
        hit = np.flatnonzero(count)
        centers[hit] += (total[hit] - count[hit, None] * centers[hit]) / seen[hit, None]
        mean = away / max(count.sum(), 1)
        level = mean if level is None else level + smooth * (mean - level)
        idle = 0 if level < least * (1 - TOLERANCE) else idle + 1
        least = min(least, level)
        if idle >= patience:
            break
    return centers
