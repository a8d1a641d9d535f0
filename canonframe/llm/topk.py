"""Operator 10, exact top-k inner products over norm-sorted vectors.

Vectors are turned to integers and rotated by the right singular vectors of the whole table (from its d x d Gram matrix,
a distributed sum), so that the first rotated components carry most of each length.  Candidates are written once in
descending length.  Queries are taken in blocks of a bounded number of rows; a block is broadcast and searched in two
passes over the candidates: the longest vectors first, whose k-th best score is the bound every later task starts from;
then all others.  A task walks its rows in chunks of descending length and drops a pair as soon as its partial product
over the leading components plus the product of the two residual lengths (Cauchy-Schwarz) cannot reach the bound, and a
whole chunk as soon as the product of lengths cannot.  What is left is scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut_lineage

BLOCK_ROWS = 4096            # queries in one broadcast block
HEAD_ROWS = 8192             # longest vectors searched first
CHUNK = 2048                 # candidates bounded together
QUERY_SLICE, PAIR_SLICE = 256, 32_768      # queries and pairs that are held at once
LEADS = (8, 24)              # leading components after which pairs are pruned


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a dense matrix; shorter vectors are padded with zeros, which changes no product."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of every component; null vectors and ones with a null or non-finite component go.

    Components must stay below 2**26 in size for products to be exact in 64 bits; larger ones raise an error.
    """
    v = F.col("_e")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("bigint"))
    small = F.forall(F.col("v"), lambda x: F.abs(x) < (1 << 26))
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(col).cast("array<double>").alias("_e")).where(fine)
            .select("vec_id", whole.alias("v"))
            .select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large"))).alias("v")))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("v"), width).astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])
    rows = (vectors.select("v").mapInArrow(run, "i bigint, row array<double>")
            .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect())   # width**2 rows
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"], r["j"]] = r["x"]
    return out


class _Block:
    """A block of queries, rotated, with the bounds known so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, floors: np.ndarray):
        self.ids, self.vectors, self.rotation, self.floors = ids, vectors, rotation, floors
        self.rotated = vectors.astype(np.float64) @ rotation
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.rest = [np.sqrt((self.rotated[:, n:] ** 2).sum(axis=1)) for n in LEADS]
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]       # (-score, vec_id), sorted
        self.bounds = floors.copy()

    def feed(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        """Candidates in descending length."""
        wide = vectors.astype(np.float64)
        rotated = wide @ self.rotation
        norms = np.sqrt((wide ** 2).sum(axis=1))
        slack = 1e-9 * (norms.max(initial=0) + 1) * (self.norms.max(initial=0) + 1)      # rounding of the rotated sums
        live = np.flatnonzero(self.norms * norms.max(initial=0) + slack >= self.bounds)
        if not len(live):
            return
        c_rests = [np.sqrt((rotated[:, n:] ** 2).sum(axis=1)) for n in LEADS]
        for at in range(0, len(live), QUERY_SLICE):
            part = live[at:at + QUERY_SLICE]
            n = LEADS[0]
            top = self.rotated[part, :n] @ rotated[:, :n].T + self.rest[0][part, None] * c_rests[0]
            able = top + slack >= self.bounds[part, None]
            able &= self.ids[part, None] != ids
            if able.mean() > 0.25:                       # bounds say little yet: score the slice whole
                scores = self.vectors[part] @ vectors.T
                able &= scores >= self.bounds[part, None]
                rows, cols = np.nonzero(able)
                self._take(part[rows], ids[cols], scores[rows, cols], k)
                continue
            rows, cols = np.nonzero(able)
            for s in range(0, len(rows), PAIR_SLICE):
                r, c = part[rows[s:s + PAIR_SLICE]], cols[s:s + PAIR_SLICE]
                for n, q_rest, c_rest in list(zip(LEADS, self.rest, c_rests))[1:]:
                    top = np.einsum("ij,ij->i", self.rotated[r, :n], rotated[c, :n]) + q_rest[r] * c_rest[c]
                    keep = top + slack >= self.bounds[r]
                    r, c = r[keep], c[keep]
                scores = np.einsum("ij,ij->i", self.vectors[r], vectors[c])
                keep = scores >= self.bounds[r]
                self._take(r[keep], ids[c[keep]], scores[keep], k)

    def _take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        """Merge scored pairs into the best of their queries."""
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            q = int(rows[s])
            e = min(e, s + k)
            merged = sorted(self.best[q] + list(zip((-scores[s:e]).tolist(), ids[s:e].tolist())))[:k]
            self.best[q] = merged
            if len(merged) == k:
                self.bounds[q] = max(self.bounds[q], -merged[-1][0])

    def result(self) -> pa.RecordBatch:
        found = [(int(q), i, -s) for q, best in zip(self.ids, self.best) for s, i in best]
        return pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, head_rows: int = HEAD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with rows of another id.

    Both tables are (vec_id, v) of ``integer_vectors``.  Ties go to the smaller vec_id; fewer than k rows give them all.
    Rows with a null id take no part.  Repeated rows are candidates each; a query id that repeats is asked once for each
    distinct vector it has, and the results are ranked together.
    """
    spark = candidates.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    sized = candidates.where("vec_id is not null").select("vec_id", "v", length.alias("square"))
    table = cut_lineage(sized.repartitionByRange(F.desc("square")).sortWithinPartitions(F.desc("square"), "vec_id"))
    asked = cut_lineage(queries.where("vec_id is not null").select("vec_id", "v").distinct())
    facts = table.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    widest = asked.agg(F.max(F.size("v")), F.min("vec_id"), F.count(F.lit(1))).first()
    if not facts[1] or not widest[2]:
        return spark.createDataFrame([], schema)
    width = max(facts[0], widest[0], LEADS[-1] + 1)
    rotation = np.linalg.eigh(_gram(table, width))[1][:, ::-1].copy()
    cut = table.select("square").orderBy(F.desc("square")).limit(head_rows).agg(F.min("square")).first()[0]
    head, tail = table.where(F.col("square") >= cut).orderBy(F.desc("square"), "vec_id").limit(head_rows), table

    def scan(part: DataFrame, ids, vectors, floors) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, vectors, rotation, floors))

        def run(batches: Iterator[pa.RecordBatch]):
            block = _Block(*shared.value)
            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    piece = b.slice(at, CHUNK)
                    block.feed(piece.column("vec_id").to_numpy(), _matrix(piece.column("v"), width).astype(np.int64), k)
            yield block.result()
        return part.select("vec_id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")

    found, after = None, None
    while True:
        rows = asked if after is None else asked.where((F.col("vec_id") > after))
        block = rows.orderBy("vec_id").limit(block_rows).toPandas()
        if not len(block):
            break
        after = int(block["vec_id"].iloc[-1])
        if len(block) == block_rows:                 # an id's vectors stay in one block
            block = asked.where((F.col("vec_id") >= int(block["vec_id"].iloc[0])) & (F.col("vec_id") <= after)).toPandas()
        ids = block["vec_id"].to_numpy(np.int64)
        vectors = np.zeros((len(ids), width), np.int64)
        for i, v in enumerate(block["v"]):
            vectors[i, :len(v)] = v
        low = np.full(len(ids), -np.inf)
        best = scan(head.coalesce(1), ids, vectors, low).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).collect()
        floors = {r["query_id"]: r["s"] for r in best if r["n"] == k}       # one number per query of the block
        floors = np.array([floors.get(i, -np.inf) for i in ids.tolist()], float)
        repeated = {i for i in ids.tolist() if (ids == i).sum() > 1} if len(set(ids.tolist())) < len(ids) else set()
        if repeated:
            floors[np.isin(ids, list(repeated))] = -np.inf
        part = scan(tail, ids, vectors, floors)
        found = part if found is None else found.unionByName(part)
        if found is not part:
            found = cut_lineage(found)
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
