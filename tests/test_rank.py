import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonframe.operators import links as L, space as S
from canonframe.session import cut_bucketed

N = 60
EDGES = [(i, (i * 7 + k * k) % N) for i in range(50) for k in range(i % 5 + 1)] + [(3, 4)] * 5 + [(i, 0) for i in range(1, 50)]


def plain(steps, damping=0.85):
    w = np.zeros((N, N))
    for a, b in EDGES:
        w[a, b] += 1
    out = w.sum(axis=1)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    rank = np.full(N, 1 / N)
    moved = []
    for _ in range(steps):
        new = (1 - damping) / N + damping * (rank @ share + rank[out == 0].sum() / N)
        moved.append(np.abs(new - rank).sum())
        rank = new
    return rank, moved


def frames(spark):
    return spark.createDataFrame(EDGES, "src long, dst long"), spark.range(N).toDF("node")


@pytest.mark.parametrize("steps", [0, 1, 5])
def test_rank_equals_a_plain_power_iteration(spark, steps):
    got = {r["node"]: r["rank"] for r in L.page_rank(*frames(spark), iterations=steps).collect()}
    want, _ = plain(steps)
    assert len(got) == N and all(abs(got[i] - want[i]) < 1e-12 for i in range(N)) and abs(sum(got.values()) - 1) < 1e-9


def test_rank_stops_once_it_has_settled(spark):
    _, moved = plain(40)
    tolerance = 1e-2
    needed = next(i for i, m in enumerate(moved) if m < tolerance) + 1
    assert 1 < needed < 20
    got = {r["node"]: r["rank"] for r in L.page_rank(*frames(spark), iterations=20, tolerance=tolerance).collect()}
    want, _ = plain(needed)
    settled, _ = plain(200)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(N)) and np.abs(want - settled).sum() < 10 * tolerance


def test_a_step_exchanges_sums_alone(spark):
    """Neither edges nor ranks are exchanged for the join; the sums are, by their target."""
    edges, nodes = frames(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shares = cut_bucketed(edges.select("src", "dst", F.lit(0.1).alias("share")), "src")
        base = cut_bucketed(nodes.withColumn("has_out", F.lit(True)), "node")
        ranks = cut_bucketed(base.withColumn("rank", F.lit(0.1)), "node")
        plan = L.rank_step(shares, ranks, base, S.row_total(base), 0.85)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["dst"], plan
    assert "SortMergeJoin" in plan and not any(re.fullmatch("canonframe_[0-9a-f]{32}", t.name) for t in spark.catalog.listTables())
