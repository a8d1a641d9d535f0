"""Operator 13, centroid clustering over a pivot table (LAESA).

Vectors become integers once, and their distances to a few fixed pivots are stored with them.  For a pivot p, a vector v
and a centroid c the triangle inequality gives ``|d(v, p) - d(c, p)| <= d(v, c)``.  In every round each batch of vectors
therefore has lower bounds to all centroids from a table lookup; the centroid with the least bound is measured first, and
only centroids whose bound does not exceed the least distance so far are measured at all, with exact integers.  Bounds
are floats and are lowered by more than their rounding error, so none prunes a nearest centroid.

Every round is one scan of the stored table: tasks fold their vectors to a sum per centroid, Spark adds the sums as
decimals, and ``k * width`` sums reach the driver.  Centroids travel in the closure, their size is fixed by ``k``.

Vectors whose integers are beyond ``WIDE`` (products no longer fit 64 bits) are measured with Python integers against all
centroids; their sums are added in limbs of 60 bits, so they are exact at any size too.

* vectors of another length, null, or with null or non-finite components take no part.
* ties go to the smaller centroid number; equal vectors and repeated ids are rows of their own.
* a null id takes part but comes last where initial centroids are chosen; fewer rows than ``k`` give as many centroids.
* distances and inertias beyond 64 bits are null.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage

WIDE = 1 << 26               # components up to here: 64 * 256 squared differences fit in 64 bits
LIMB = 60
SLACK = 1e-9                 # share by which float bounds are lowered


def integer_vectors(rows: DataFrame, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, wide): components ``floor(scale * x)``; ``wide`` holds them in decimal instead where one is beyond WIDE."""
    if width > 256:
        raise ValueError("vectors of more than 256 components need a smaller WIDE")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = (rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("x").isNotNull() & (F.size("x") == width) & finite))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column("x").flatten().to_numpy().reshape(b.num_rows, width)
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * values)
            far = (np.abs(scaled) > WIDE).any(axis=1)
            whole = np.where(far[:, None], 0, scaled).astype(np.int32)
            # x is a double: scale * x may be beyond doubles, so such rows are scaled as integers
            texts = [[str(_floored(c, scale)) for c in row.tolist()] if f else None for f, row in zip(far, values)] if far.any() else [None] * len(far)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, whole.size + 1, width, dtype=np.int32)), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(texts, pa.list_(pa.string()))], ["vec_id", "v", "wide"])
    return kept.mapInArrow(run, "vec_id bigint, v array<int>, wide array<string>")


def _floored(x: float, scale: int) -> int:
    """floor of the double ``scale * x``; exact where the product is beyond doubles."""
    product = scale * x
    if np.isfinite(product):
        return int(np.floor(product))
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def _matrix(b: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to the matching rows of ``c``."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, c_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row of ``v``, and how many exact distances that took.

    ``to_pivots`` are the stored distances of the rows to the pivots, ``c_pivots`` those of the centroids.
    """
    n, k = len(v), len(centroids)
    low = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        mine, theirs = to_pivots[:, p, None], c_pivots[None, :, p]
        np.maximum(low, np.abs(mine - theirs) - SLACK * (mine + theirs + 1), out=low)
    low *= low
    order = np.argsort(low, axis=1, kind="stable")
    best = order[:, 0].copy()
    least = _distances(v, centroids[best])
    measured, rows = n, np.arange(n)
    for step in range(1, k):
        c = order[rows, step]
        rows = rows[low[rows, c] <= least[rows]]            # bounds ascend: a row that drops out stays out
        if not len(rows):
            break
        c = order[rows, step]
        d = _distances(v[rows], centroids[c])
        measured += len(rows)
        nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
        at = rows[nearer]
        least[at], best[at] = d[nearer], c[nearer]
    return best, least, measured


def _nearest_wide(v: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centroids))[::-1]


class Centroids:
    """Centroids as Python integers, with what the bounds need of those that are not wide."""

    def __init__(self, values: list[list[int]], pivots: np.ndarray):
        self.values = values
        self.narrow = [i for i, c in enumerate(values) if max(map(abs, c), default=0) <= WIDE]
        self.matrix = np.array([values[i] for i in self.narrow], np.int64).reshape(len(self.narrow), -1)
        self.pivots = pivot_distances(self.matrix, pivots) if self.narrow else np.empty((0, len(pivots)))

    def assign(self, b: pa.RecordBatch, width: int, n_pivots: int) -> tuple[np.ndarray, list[int]]:
        """(centroid numbers, squared distances) of a batch."""
        v, wide = _matrix(b, "v", width), b.column("wide").to_pylist()
        if len(self.narrow) == len(self.values) and not any(w is not None for w in wide):
            best, least, _ = nearest(v, _matrix(b, "to_pivots", n_pivots), self.matrix, self.pivots)
            return best, least.tolist()
        # one far vector or centroid: exact integers for the whole batch
        found = [_nearest_wide(row if w is None else [int(x) for x in w], self.values) for row, w in zip(v.tolist(), wide)]
        return np.array([c for c, _ in found], np.int64), [d for _, d in found]


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(pivots)))
    for p, pivot in enumerate(pivots):
        out[:, p] = np.sqrt(_distances(v, pivot[None, :]).astype(np.float64))
    return out


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    sign, total, place = (-1 if total < 0 else 1), abs(total), 0
    while total or not place:
        yield place, sign * (total & ((1 << LIMB) - 1))
        total, place = total >> LIMB, place + 1


def _folded(stored: DataFrame, centroids: Centroids, width: int, n_pivots: int) -> dict[int, tuple[int, list[int]]]:
    """(rows, sums of components) of each centroid that has rows."""
    def run(batches: Iterator[pa.RecordBatch]):
        counts, sums = {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            best, _ = centroids.assign(b, width, n_pivots)
            v, wide = _matrix(b, "v", width).astype(np.int64), b.column("wide").to_pylist()
            for c in np.unique(best).tolist():
                mine = np.flatnonzero(best == c)
                counts[c] = counts.get(c, 0) + len(mine)
                total = v[mine].sum(axis=0).tolist()
                for row in mine.tolist():
                    if wide[row] is not None:                # its ``v`` is zero
                        total = [t + int(x) for t, x in zip(total, wide[row])]
                sums[c] = [s + t for s, t in zip(sums.get(c, [0] * width), total)]
        rows = [(c, i, place, limb) for c, total in sums.items() for i, t in enumerate(total) for place, limb in _limbs(t)]
        rows += [(c, -1, 0, n) for c, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         ["cluster", "i", "place", "part"])
    parts = (stored.mapInArrow(run, "cluster int, i int, place int, part bigint").groupBy("cluster", "i", "place")
             .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts:
        n, sums = found.setdefault(r["cluster"], (0, [0] * width))
        if r["i"] < 0:
            found[r["cluster"]] = (int(r["total"]), sums)
        else:
            sums[r["i"]] += int(r["total"]) << (LIMB * r["place"])
    return found


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str = "", n_pivots: int = 8, width: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every row of ``vectors`` (from ``integer_vectors``), and the final centroids.

    Initial centroids are the ``k`` rows with the smallest sha256 of ``seed`` and the decimal id, in that order (rows of one id
    by their components).  A round assigns all rows and moves centroids to ``floor(sum / count)``; after ``rounds`` rounds the
    rows are assigned once more.  Pivots are the first ``n_pivots`` initial centroids that are not wide.
    """
    spark = vectors.sparkSession
    first = (vectors.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)), "v", "wide").limit(k).collect())
    values = [[int(x) for x in (r["wide"] or r["v"])] for r in first]
    if not values:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    pivots = np.array([c for c in values if max(map(abs, c)) <= WIDE][:n_pivots], np.int64).reshape(-1, width)

    def pivoted(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            far = pivot_distances(_matrix(b, "v", width), pivots)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(pivots)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("wide"), lists], ["vec_id", "v", "wide", "to_pivots"])
    stored = cut_lineage(vectors.mapInArrow(pivoted, "vec_id bigint, v array<int>, wide array<string>, to_pivots array<double>"))
    for _ in range(rounds):
        moved = _folded(stored, Centroids(values, pivots), width, len(pivots))
        values = [[s // moved[c][0] for s in moved[c][1]] if c in moved else old for c, old in enumerate(values)]
    final = Centroids(values, pivots)

    def assigned(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            best, least = final.assign(b, width, len(pivots))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array([d if d < 1 << 63 else None for d in least], pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return stored.mapInArrow(assigned, "vec_id bigint, cluster int, distance bigint"), values


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` (null beyond 64 bits) and ``centroid_sha256``.

    One sum per centroid reaches the driver, and as many rows go back to be joined.
    """
    rows = cut_lineage(assigned)
    known = F.count("distance") == F.count(F.lit(1))
    sums = {r["cluster"]: None if r["s"] is None else int(r["s"])
            for r in rows.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}

    def fitting(x: int | None) -> int | None:
        return x if x is not None and x < 1 << 63 else None
    total = None if None in sums.values() else sum(sums.values())
    stats = [(c, fitting(s), fitting(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    named = assigned.sparkSession.createDataFrame(stats, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
