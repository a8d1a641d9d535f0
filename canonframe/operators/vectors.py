"""Exact nearest vectors by cosine over an index of lists.

Vectors are scaled to length one, so the nearest by angle are the nearest by distance.  The index deals them to the nearest of
a bounded number of centroids and packs each list, ordered by distance to its centroid, into blocks.  For a query at distance
``d`` of a centroid, a vector at distance ``r`` of it is at least ``|d - r|`` away (triangle inequality).

Queries are rows, not a driver's loop.  They meet the lists in two joins whatever their number: first the nearest lists that
hold ``k`` vectors, which gives every query a bound; then those of the other lists that may hold something nearer.  Queries
travel side by side in tiles, once for a shelf of several lists.  Where a tile meets a block, only queries within the bound are
multiplied, in single precision; what that leaves, its error allowed for, is scored in double precision.
Without clusters that is still every pair of a query and a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

LISTS = 64                   # centroids
SAMPLE = 8192                # vectors the centroids are fitted on; they decide speed, never results
BLOCK_ROWS = 4096            # vectors multiplied together
TILE_ROWS = 2048             # queries that travel together
CHUNK_ROWS = 512             # queries multiplied together
SHELVES = 8                  # groups of lists; a tile travels once to each it needs
SHARES = 4                   # cells of a join for every core
SLACK = 1e-9                 # by which float bounds are loosened


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, u) of the vectors with a direction: null or empty ones, those with null or non-finite components and zeros are left out."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column("u")), 0).to_numpy().astype(np.int64)
            parts, some = b.column("u").flatten().to_numpy(zero_copy_only=False), n > 0              # a null component becomes a NaN
            square, begin = np.zeros(len(n)), np.cumsum(n) - n
            with np.errstate(over="ignore", invalid="ignore"):
                if some.any():
                    square[some] = np.add.reduceat(parts * parts, begin[some])
                fine = (square > 0) & np.isfinite(square)
                parts = (parts / np.repeat(np.sqrt(square), n))[np.repeat(fine, n)]
            ends = np.concatenate([[0], np.cumsum(n[fine])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(ends), pa.array(parts))], ["id", "u"])
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("u")).where("id is not null and u is not null")
    return given.mapInArrow(run, "id bigint, u array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Consecutive rows of one ``key``, at most ``rows`` together."""
    held, n, now = [], 0, None
    for b in batches:
        keys = b.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in zip(edges, edges[1:]):
            while start < stop:
                if held and (keys[start] != now or n == rows):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                now, take = keys[start], min(stop - start, rows - n)
                held.append(b.slice(start, take))
                n, start = n + take, start + take
    if held:
        yield pa.Table.from_batches(held)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def fit_centroids(units: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample (the vectors with the smallest hash of their id)."""
    rows = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("u").collect()
    sample = np.array([r["u"] for r in rows])
    if not len(sample):
        return np.empty((0, 0))
    centres = np.unique(sample[:lists], axis=0)
    for _ in range(rounds):
        nearest = distances(sample, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Lists:
    """Centroids, and per list how many vectors it has and their least and greatest distance to the centroid."""
    centroids: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def first(self, far: np.ndarray, k: int) -> np.ndarray:
        """Which lists are the nearest that hold ``k`` vectors together, by distances ``far`` to the centroids (a row per query)."""
        order = np.argsort(np.where(self.sizes > 0, far, np.inf), axis=1, kind="stable")
        held = self.sizes[order]
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, np.cumsum(held, axis=1) - held < k, axis=1)
        return out & (self.sizes > 0)

    def reach(self, far: np.ndarray) -> np.ndarray:
        """The greatest similarity a list's vectors can have."""
        return _most(np.maximum(far - self.high, self.low - far))


def _most(gap: np.ndarray) -> np.ndarray:
    """The greatest similarity at a distance of ``gap`` at least."""
    return 1 - np.maximum(gap - SLACK, 0) ** 2 / 2


def _step(digits: int) -> float:
    """More than rounding changes."""
    return 10.0 ** -digits + 1e-12


@dataclass(frozen=True)
class Index:
    """``blocks``: list, low, high (distances to the centroid), n, ids and vectors (64-bit numbers)."""
    blocks: DataFrame
    lists: Lists


def build(vectors: DataFrame, id_col: str, vec_col: str, lists: int = LISTS, block_rows: int = BLOCK_ROWS) -> Index:
    """Index all rows of ``vectors`` that ``unit_vectors`` keeps; they must have one width."""
    units = cut_lineage(unit_vectors(vectors, id_col, vec_col))
    centres = fit_centroids(units, lists)

    def assign(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                far = distances(_matrix(b.column("u")), centres)
                best = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(best)), best]), b.column("id"), b.column("u")], ["list", "r", "id", "u"])

    def pack(batches: Iterator[pa.RecordBatch]):
        for t in _runs(batches, "list", block_rows):
            r = t.column("r")
            yield pa.RecordBatch.from_arrays([t.column("list").slice(0, 1).combine_chunks(), pa.array([r[0].as_py()]), pa.array([r[-1].as_py()]), pa.array([len(t)]),
                                              pa.array([t.column("id").to_numpy().tobytes()]), pa.array([_matrix(_joined(t.column("u"))).tobytes()])],
                                             ["list", "low", "high", "n", "ids", "vectors"])
    # ranges of (list, r): a large list is dealt to many tasks
    dealt = units.mapInArrow(assign, "list int, r double, id bigint, u array<double>").repartitionByRange("list", "r", "id").sortWithinPartitions("list", "r", "id")
    blocks = cut_lineage(dealt.mapInArrow(pack, "list int, low double, high double, n bigint, ids binary, vectors binary"))
    known = blocks.groupBy("list").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()     # one row per list
    sizes, low, high = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for r in known:
        sizes[r["list"]], low[r["list"]], high[r["list"]] = r["n"], r["low"], r["high"]
    return Index(blocks, Lists(centres, sizes, low, high))


def _placed(queries: DataFrame, lists: Lists, k: int) -> DataFrame:
    """(id, list, d, first, u): each query's nearest list, the distance, and the nearest lists that hold ``k`` vectors together."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                u = _matrix(b.column("u"))
                far = distances(u, lists.centroids)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(u)), near]),
                                                  pa.array([np.flatnonzero(f).astype(np.int32) for f in lists.first(far, k)], pa.list_(pa.int32())), pa.array([v.tobytes() for v in u], pa.binary())],
                                                 ["id", "list", "d", "first", "u"])
    return queries.mapInArrow(run, "id bigint, list int, d double, first array<int>, u binary")


@dataclass(frozen=True)
class Cells:
    """A join's keys: lists are grouped, and the tiles that come to a group are dealt to so many cells, each with all blocks of the group."""
    group: np.ndarray            # of every list
    shares: np.ndarray           # cells of every group
    begin: np.ndarray            # first cell of every group

    @classmethod
    def of(cls, index: Index, group: np.ndarray) -> Cells:
        held, cells = np.bincount(group, index.lists.sizes), SHARES * index.blocks.sparkSession.sparkContext.defaultParallelism
        shares = np.maximum(1, np.ceil(cells * held / max(held.sum(), 1))).astype(int)
        return cls(group, shares, np.cumsum(shares) - shares)

    def blocks(self, blocks: DataFrame) -> DataFrame:
        of = F.array(*[F.sequence(F.lit(int(self.begin[g])), F.lit(int(self.begin[g] + self.shares[g] - 1))) for g in self.group])
        return blocks.withColumn("cell", F.explode(F.element_at(of, F.col("list") + 1)))


def _tiles(asked: DataFrame, key: str, cells: Cells, wanted, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Queries side by side: cell, tile, queries, asked, least, first.  ``wanted(tile's rows)``: its groups and the rows each needs."""
    def pack(batches: Iterator[pa.RecordBatch]):
        start = None
        for number, t in enumerate(_runs(batches, key, tile_rows)):
            ids, least = t.column("id").to_numpy(), t.column("least").to_numpy()
            first, u = t.column("first").to_pylist(), t.column("u").to_pylist()
            start = crc32(ids[:1].tobytes()) if start is None else start
            for g, rows in wanted(int(t.column(key)[0].as_py()), np.frombuffer(b"".join(u)).reshape(len(u), -1), least, first):
                cell = int(cells.begin[g]) + (start + number) % int(cells.shares[g])
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([int(ids[rows[0]])]), pa.array([ids[rows].tobytes()]), pa.array([b"".join(u[i] for i in rows.tolist())]),
                                                  pa.array([least[rows].tobytes()]), pa.array([[first[i] for i in rows.tolist()]], pa.list_(pa.list_(pa.int32())))],
                                                 ["cell", "tile", "queries", "asked", "least", "first"])
    return (asked.repartitionByRange(key, "list", "d", "id").sortWithinPartitions(key, "list", "d", "id")
            .mapInArrow(pack, "cell int, tile bigint, queries binary, asked binary, least binary, first array<array<int>>"))


def _open(first: list[list[int]], n_lists: int) -> np.ndarray:
    """Which lists a query does not name."""
    out = np.ones((len(first), n_lists), bool)
    out[np.repeat(np.arange(len(first)), [len(f) for f in first]), [c for f in first for c in f]] = False
    return out


class Tile:
    """Queries side by side and the ``k`` best found for each so far, by falling similarity, then id.

    ``least``: similarities below it are of no use to a query; ``open``: the lists each query wants.
    """

    def __init__(self, queries: np.ndarray, u: np.ndarray, least: np.ndarray, open: np.ndarray, lists: Lists, k: int, digits: int):
        self.queries, self.u, self.least, self.open, self.k, self.digits = queries, u, least.copy(), open, k, digits
        self.rough, self.far = u.astype(np.float32), distances(u, lists.centroids)
        self.error = (u.shape[1] + 4) * 2.0 ** -23                       # more than single precision loses in a product of vectors of length one
        self.sims, self.ids = np.full((len(u), k), -np.inf), np.full((len(u), k), np.iinfo(np.int64).max)
        self.n_scored = 0

    def meet(self, number: int, low: float, high: float, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take what a block of list ``number`` has."""
        far = self.far[:, number]
        near = np.flatnonzero(self.open[:, number] & (_most(np.maximum(far - high, low - far)) >= self.least - _step(self.digits)))
        if len(near):
            rough = vectors.astype(np.float32).T
            for at in range(0, len(near), CHUNK_ROWS):
                self._chunk(near[at:at + CHUNK_ROWS], ids, vectors, rough)

    def _chunk(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray) -> None:
        sims, least = self.rough[rows] @ rough, self.least[rows]
        unknown = np.flatnonzero(np.isneginf(least))
        if len(unknown) and self.k <= len(ids):
            least[unknown] = np.partition(sims[unknown], -self.k, axis=1)[:, -self.k] - self.error
        least = (least - self.error - _step(self.digits)).astype(np.float32)
        some = np.flatnonzero(sims.max(axis=1) >= least)
        if not len(some):
            return
        rows, sims = rows[some], sims[some]
        hits = np.flatnonzero(sims >= least[some, None])
        q, c = np.divmod(hits, len(ids))
        self.n_scored += len(hits)
        if 32 * len(hits) > sims.size:
            exact = (self.u[rows] @ vectors.T)[q, c]
        else:
            part = max(1, (1 << 21) // self.u.shape[1])
            exact = np.concatenate([np.einsum("ij,ij->i", self.u[rows[q[i:i + part]]], vectors[c[i:i + part]]) for i in range(0, len(q), part)])
        self._keep(rows[q], ids[c], np.round(exact, self.digits))

    def _keep(self, row: np.ndarray, ident: np.ndarray, sim: np.ndarray) -> None:
        last, last_id = self.sims[row, -1], self.ids[row, -1]
        good = (sim >= self.least[row]) & ((sim > last) | ((sim == last) & (ident < last_id)))
        row, ident, sim = row[good], ident[good], sim[good]
        changed = np.unique(row)
        row = np.concatenate([row, np.repeat(changed, self.k)])
        ident, sim = np.concatenate([ident, self.ids[changed].ravel()]), np.concatenate([sim, self.sims[changed].ravel()])
        order = np.lexsort((ident, -sim, row))
        row, ident, sim = row[order], ident[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.sims[row[kept], place[kept]], self.ids[row[kept], place[kept]] = sim[kept], ident[kept]
        self.least[changed] = np.maximum(self.least[changed], self.sims[changed, -1])

    def rows(self) -> pa.RecordBatch:
        found = np.isfinite(self.sims)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries, found.sum(axis=1))), pa.array(self.ids[found]), pa.array(self.sims[found])], ["query_id", "id", "similarity"])


def _scored(tiles: DataFrame, index: Index, cells: Cells, k: int, digits: int, first: bool) -> DataFrame:
    """(query_id, id, similarity): the ``k`` best per query of what a tile meets in its cell, in its first lists or in the others."""
    lists = index.lists

    def run(batches: Iterator[pa.RecordBatch]):
        now, tile = None, None
        for b in batches:
            names = list(zip(b.column("cell").to_pylist(), b.column("tile").to_pylist()))
            blocks = list(zip(b.column("list").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist()))
            for i, name in enumerate(names):
                if name != now:
                    if tile is not None:
                        yield tile.rows()
                    queries, least = (np.frombuffer(b.column(c)[i].as_buffer(), t).copy() for c, t in (("queries", np.int64), ("least", np.float64)))
                    wanted = _open(b.column("first")[i].as_py(), len(lists.centroids))
                    tile = Tile(queries, np.frombuffer(b.column("asked")[i].as_buffer()).reshape(len(queries), -1).copy(), least, ~wanted if first else wanted, lists, k, digits)
                    now = name
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
                tile.meet(*blocks[i], ids, np.frombuffer(b.column("vectors")[i].as_buffer()).reshape(len(ids), -1))
        if tile is not None:
            yield tile.rows()
    return tiles.join(cells.blocks(index.blocks), "cell").mapInArrow(run, "query_id bigint, id bigint, similarity double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def candidates(index: Index, queries: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Best rows of the first lists, and tiles of the queries that have to look into other lists, one for each shelf."""
    lists = index.lists
    asked = cut_lineage(_placed(unit_vectors(queries, "query_id", "vector").dropDuplicates(["id"]), lists, k))
    each, shelves = Cells.of(index, np.arange(len(lists.centroids))), Cells.of(index, np.arange(len(lists.centroids)) % SHELVES)
    tiles = _tiles(asked.withColumn("at", F.explode("first")).withColumn("least", F.lit(float("-inf"))), "at", each, lambda at, u, least, first: [(at, np.arange(len(u)))])
    first = cut_lineage(best(_scored(tiles, index, each, k, digits, True), k).drop("rank"))
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(float("-inf"))).alias("least"))

    def wanted(_, u, least, seen):
        useful = _open(seen, len(lists.centroids)) & (lists.sizes > 0) & (lists.reach(distances(u, lists.centroids)) >= least[:, None] - _step(digits))
        for g in range(len(shelves.shares)):
            rows = np.flatnonzero(useful[:, shelves.group == g].any(axis=1))
            if len(rows):
                yield g, rows
    bounded = cut_lineage(asked.join(known, "id").withColumn("at", F.lit(0)))
    return first, _tiles(bounded, "at", shelves, wanted)


def nearest(vectors: DataFrame | Index, id_col: str, vec_col: str, queries: DataFrame, k: int, digits: int = 6, **options) -> DataFrame:
    """(query_id, id_col, similarity, rank): the exact ``k`` nearest vectors by cosine for every row of ``queries`` (query_id, vector).

    Similarities are rounded to ``digits``, and equal ones are in the order of ids.  Vectors and queries without a direction
    (see ``unit_vectors``) take no part; of queries that share an id one counts.  ``vectors`` may be an ``Index`` made before.
    """
    index = vectors if isinstance(vectors, Index) else build(vectors, id_col, vec_col, **options)
    if not len(index.lists.centroids):
        return queries.sparkSession.createDataFrame([], f"query_id bigint, {id_col} bigint, similarity double, rank bigint")
    first, others = candidates(index, queries, k, digits)
    shelves = Cells.of(index, np.arange(len(index.lists.centroids)) % SHELVES)
    return best(first.unionByName(_scored(others, index, shelves, k, digits, False)), k).withColumnRenamed("id", id_col)


def pool(vectors: DataFrame, group: Column, vec: str) -> DataFrame:
    """Mean vector per group, averaged dimension by dimension with map-side sums."""
    cells = (vectors.select(group.alias("group_id"), F.posexplode(vec).alias("dim", "x"))
             .groupBy("group_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return cells.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))),
                                                     lambda s: s["x"]).alias("vector"))
