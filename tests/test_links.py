"""Heat buckets, totals and walks."""

import pytest

from canonframe.operators import links as L
from canonframe.plans import link_queries as Lq
from canonframe.plans.views import Tables
from .test_space import make_space


# A small graph with every case: a strong, a weak and an unpopular target, a link back to the seed, a range target.
WALK_EDGES = [
    ("a", 1001001, 1001005, 1001005, 9), ("b", 1001001, 1001007, 1001008, 4), ("c", 1001005, 1001009, 1001009, 7),
    ("d", 1001003, 1001001, 1001002, 6), ("e", 1001001, 1001004, 1001004, 0), ("f", 1001009, 1001010, 1001010, 3)]
SEED, FIVE, SEVEN, THREE = "1001001-1001001", "1001005-1001005", "1001007-1001008", "1001003-1001003"
NINE, BACK = "1001009-1001009", "1001001-1001002"

# (depth, degree, nodes, votes) -> nodes with depth and degree, edges with votes, flags; worked out by hand.
WALKS = {
    (2, 12, 60, 1): (
        {SEED: (0, 3), FIVE: (1, 2), SEVEN: (1, 1), THREE: (1, 2), NINE: (2, 1), BACK: (2, 1)},
        {(SEED, FIVE): 9, (SEED, SEVEN): 4, (THREE, SEED): 6, (FIVE, NINE): 7, (THREE, BACK): 6},
        dict(candidates=8, shown=5, depth_capped=True, nodes_capped=False, degree_capped=False, votes_capped=True)),
    (1, 1, 60, 1): (                                       # only the strongest link in each direction
        {SEED: (0, 2), FIVE: (1, 1), THREE: (1, 1)},
        {(SEED, FIVE): 9, (THREE, SEED): 6},
        dict(candidates=2, shown=2, depth_capped=True, nodes_capped=False, degree_capped=True, votes_capped=False)),
    (1, 12, 2, 1): (                                       # room for one node beside the seed
        {SEED: (0, 1), FIVE: (1, 1)},
        {(SEED, FIVE): 9},
        dict(candidates=4, shown=1, depth_capped=True, nodes_capped=True, degree_capped=False, votes_capped=True)),
}


@pytest.mark.parametrize("caps", WALKS)
def test_walk(spark, caps):
    edges = spark.createDataFrame(WALK_EDGES, "edge_id string, src long, dst_start long, dst_end long, votes long")
    seeds = spark.createDataFrame([(1, 1001001, 1001001), (2, 1009001, 1009001)], "seed long, start long, end long")
    nodes, out, flags = L.walk(seeds, edges, *caps)
    want_nodes, want_edges, want_flags = WALKS[caps]
    nodes, flags = nodes.collect(), {r.seed: r.asDict() for r in flags.collect()}
    assert {r.id: (r.depth, r.degree) for r in nodes if r.seed == 1} == want_nodes
    assert {(r.source, r.target): r.votes for r in out.collect()} == want_edges
    assert {k: flags[1][k] for k in want_flags} == want_flags
    assert [(r.id, r.depth, r.degree) for r in nodes if r.seed == 2] == [("1009001-1009001", 0, 0)]      # a seed nobody links
    assert flags[2]["candidates"] == 0 and not any(v for k, v in flags[2].items() if k.endswith("capped"))


def test_bucket_formula_when_not_a_multiple_of_five(spark):
    rows = [(1001000 + i, c, c) for i, c in enumerate([3, 1, 1, 2, 9, 4, 4], 1)]
    got = {r.addr: r.heat_bucket for r in L.heat_buckets(spark.createDataFrame(rows, "addr long, inbound_count long, weighted_score long")).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {r[0]: min(5, i * 5 // 7 + 1) for i, r in enumerate(order)}


def test_unique_total_counts_two_way_links_once(spark):
    e = spark.createDataFrame([("a", 43003001, 43003010, 43003012, 5), ("b", 43003002, 1001001, 1001001, 5),
                               ("c", 1001001, 43003016, 43003016, 5), ("d", 43003001, 43003002, 43003002, -1)],
                              "edge_id string, src long, dst_start long, dst_end long, votes long")
    q = spark.createDataFrame([(1, 43003001, 43003999)], "req long, q_start long, q_end long")
    assert tuple(L.totals(q, e).first()) == (1, 2, 2, 3)
    assert tuple(L.totals(q, e, -10).first()) == (1, 3, 3, 4)


def test_heat_default_keeps_unreferenced_units(spark):
    space = make_space(spark, [1001001, 1001002])
    e = spark.createDataFrame([(1001001, 1001001, 0)], "dst_start long, dst_end long, votes long")
    heat = L.heat_buckets(L.heat(e, space))
    got = {r.addr: r.heat_bucket for r in L.with_heat(space, heat).collect()}
    assert got == {1001001: 1, 1001002: 0}


def wide_links(n=450):
    """Links from every address; the first has no quantity and reaches from the first address to the last, more than LINK_SPAN ones."""
    space = [(1, 1001000 + u, u - 1) for u in range(1, n + 1)]
    parts = [(1001, u, 1, 1, None if u == 1 else 7, 100, 1001000 + u, 1001000 + (n if u == 1 else u)) for u in range(1, n + 1)]
    return space, parts


def wide_tables(spark):
    space, parts = wide_links()
    t = Tables(spark, "/nowhere")
    t.__dict__["space"] = spark.createDataFrame(space, "book long, addr long, pos long")
    t.__dict__["edge_parts"] = spark.createDataFrame(parts, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, _qty long, _price long, dst_start long, dst_end long")
    return t


def test_links_are_expanded_beyond_the_span_of_heat(spark):
    rows = Lq.range_expansion(wide_tables(spark)).collect()
    assert len(rows) == 450 + 449 and sum(r.edge_id == "1001-1-1-1-100" for r in rows) == 450


def test_rank_reaches_whole_target_ranges(spark):
    """The rank of the first address is spread over all addresses, also those behind the four-hundredth."""
    ranks = {r.node: r.rank_ppm for r in Lq.page_rank(wide_tables(spark)).collect()}
    n = 450
    rank = [1 / n] * n
    for _ in range(4):
        rank = [0.15 / n + 0.85 * ((rank[i] if i else 0) + rank[0] / n) for i in range(n)]
    assert len(ranks) == n and all(abs(ranks[1001001 + i] - rank[i] * 1e6) < 1e-3 for i in range(n))
