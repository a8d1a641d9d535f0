"""Nearest vectors against all cosines."""

import numpy as np
import pytest

from canonframe.operators import vectors as V


def plain(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = set()
    for q, v in queries:
        v = np.asarray(v, np.float64)
        sims = np.round(m @ (v / np.linalg.norm(v)), 6)
        out |= {(q, int(ids[i]), rank + 1) for rank, i in enumerate(np.lexsort((ids, -sims))[:k])}
    return out


def clustered(rng, n, spread):
    centres = rng.normal(0, 1, (12, 16))
    return [(i, (centres[i % 12] + rng.normal(0, spread, 16)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, k, options", [(0.05, 4, {}), (5.0, 7, {"lists": 9, "block_rows": 16}), (0.3, 400, {"block_rows": 10}), (0.05, 1, {"lists": 1})])
def test_nearest_is_exact(spark, spread, k, options):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 300, spread)
    vectors += [(400 + i, vectors[3][1]) for i in range(9)]                                # ties go to the smaller id
    queries = [(i, rng.normal(0, 1, 16).tolist()) for i in range(40)] + [(100, vectors[3][1]), (101, vectors[7][1])]
    given = spark.createDataFrame(vectors, "i bigint, v array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>").repartition(3)
    got = V.nearest(given, "i", "v", asked, k, **options).collect()
    assert {(r["query_id"], r["i"], r["rank"]) for r in got} == plain(vectors, queries, k)
    assert len(got) == len(queries) * min(k, len(vectors))


def test_lists_out_of_reach_are_not_read(spark):
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 2000, 0.01)
    index = V.build(spark.createDataFrame(vectors, "i bigint, v array<double>"), "i", "v", lists=24, block_rows=32)
    asked = spark.createDataFrame([(i, v) for i, v in vectors[:200]], "query_id bigint, vector array<double>")
    _, others = V.candidates(index, asked, 3)
    assert others.count() < 0.2 * 200 * len(index.lists.centroids)
    assert index.blocks.count() > 2000 / 32 and int(index.lists.sizes.sum()) == 2000


def test_rows_without_a_direction(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0])]
    given = spark.createDataFrame([r + ("clash", 0) for r in rows], "id bigint, u array<double>, list string, similarity int")
    asked = spark.createDataFrame(rows + [(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    got = {(r["query_id"], r["id"]) for r in V.nearest(given, "id", "u", asked, 1).collect()}
    assert got == {(1, 1), (2, 2), (8, 8)}
    assert V.nearest(given.limit(0), "id", "u", asked, 3).count() == 0 and V.nearest(given, "id", "u", asked.limit(0), 3).count() == 0


def test_copies_and_queries_without_clusters(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(0, 1, 24).tolist()) for i in range(900)]
    vectors += [(2000 - i, vectors[5][1]) for i in range(700)]                             # one large group of copies
    given = spark.createDataFrame(vectors, "i bigint, v array<double>").repartition(3)
    index = V.build(given, "i", "v", lists=64, block_rows=50)
    asked = given.select(given.i.alias("query_id"), given.v.alias("vector"))
    got = V.nearest(index, "i", "v", asked, 3).collect()
    assert {(r["query_id"], r["i"], r["rank"]) for r in got} == plain(vectors, vectors, 3) and len(got) == 3 * len(vectors)
    _, others = V.candidates(index, asked, 3)
    sent = sum(len(r["queries"]) // 8 for r in others.collect())
    assert sent <= V.SHELVES * len(vectors) < 0.5 * len(vectors) * len(index.lists.centroids)      # once for a shelf, not once for a list


def test_a_tile_scores_little_more_than_it_keeps():
    rng = np.random.default_rng(8)
    u = rng.normal(0, 1, (3000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lists = V.Lists(np.zeros((1, 32)), np.array([3000]), np.array([1.0]), np.array([1.0]))
    tile = V.Tile(np.arange(100), u[:100], np.full(100, -np.inf), np.ones((100, 1), bool), lists, 4, 6)
    for at in range(0, 3000, 500):
        tile.meet(0, 1.0, 1.0, np.arange(at, at + 500), u[at:at + 500])
    sims = np.round(u[:100] @ u.T, 6)
    assert tile.ids.tolist() == [np.lexsort((np.arange(3000), -row))[:4].tolist() for row in sims]
    assert tile.n_scored < 0.02 * 100 * 3000
