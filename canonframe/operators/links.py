"""Weighted references over the address space: heat, lists, totals, walks, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import address as A
from ..session import cut_bucketed, cut_lineage
from . import space as S


def heat(edges: DataFrame, space: DataFrame) -> DataFrame:
    """addr, inbound_count, weighted_score (a link weighs at least 1)."""
    return (S.tally_ranges(edges, space, F.greatest(F.col("votes"), F.lit(1)), "dst_start", "dst_end", S.LINK_SPAN)
            .select("addr", F.col("n_ranges").alias("inbound_count"), F.col("weight").alias("weighted_score")))


def heat_recomputed(edges: DataFrame, space: DataFrame) -> DataFrame:
    """The same by running sums instead of expansion: the independent recomputation a gate compares with."""
    return (S.tally_ranges_by_deltas(edges, space, F.greatest(F.col("votes"), F.lit(1)), "dst_start", "dst_end", S.LINK_SPAN)
            .select("addr", F.col("n_ranges").alias("inbound_count"), F.col("weight").alias("weighted_score")))


def heat_buckets(heat_rows: DataFrame) -> DataFrame:
    """Heat with its 1-5 bucket by ascending count; ties in address order."""
    ranked = S.global_position(cut_lineage(heat_rows), "addr", ["inbound_count"], "_i", "_n")
    return (ranked
            .withColumn("heat_bucket", S.quintile("_i", F.col("_n"))).drop("_i", "_n"))


def with_heat(units: DataFrame, heat_rows: DataFrame) -> DataFrame:
    """Left join: a unit nobody refers to has heat 0 and stays."""
    return (units.join(heat_rows.select("addr", "heat_bucket"), "addr", "left")
            .withColumn("heat_bucket", F.coalesce("heat_bucket", F.lit(0).cast("bigint"))))


def outbound(requests: DataFrame, edges: DataFrame, min_votes: int = 0) -> DataFrame:
    """Links leaving any address of each requested range."""
    return S.points_in_ranges(edges.where(F.col("votes") >= min_votes), requests, "src", ("q_start", "q_end"))


def inbound(requests: DataFrame, edges: DataFrame, min_votes: int = 0) -> DataFrame:
    """Links whose target range overlaps each requested range."""
    return S.overlap_join(requests, edges.where(F.col("votes") >= min_votes),
                          ("q_start", "q_end"), ("dst_start", "dst_end"))


def strongest(pairs: DataFrame, key: str, limit: int, address: str) -> DataFrame:
    """Top ``limit`` links per key by votes, then address; per-task limits apply before the shuffle."""
    order = W.partitionBy(key).orderBy(F.desc("votes"), F.asc(address), F.asc("edge_id"))
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def totals(requests: DataFrame, edges: DataFrame, min_votes: int = 0) -> DataFrame:
    """Outbound, inbound and unique link counts per request.

    A link that leaves the range and also points into it is one link: it is
    recognised on the outbound pair itself, so no pair list is deduplicated.
    """
    out = outbound(requests, edges, min_votes)
    both = A.overlaps("dst_start", "dst_end", "q_start", "q_end")
    n_out = out.groupBy("req").agg(F.count(F.lit(1)).alias("n_outbound"), F.count_if(both).alias("_both"))
    n_in = inbound(requests, edges, min_votes).groupBy("req").agg(F.count(F.lit(1)).alias("n_inbound"))
    zero = F.lit(0).cast("bigint")
    return (requests.select("req").join(n_out, "req", "left").join(n_in, "req", "left")
            .select("req", F.coalesce("n_outbound", zero).alias("n_outbound"),
                    F.coalesce("n_inbound", zero).alias("n_inbound"),
                    (F.coalesce("n_outbound", zero) + F.coalesce("n_inbound", zero)
                     - F.coalesce("_both", zero)).alias("n_unique")))


def by_target_book(pairs: DataFrame, limit: int) -> DataFrame:
    """Links of each request ranked within the target's collection, collections by their strongest link."""
    items = pairs.withColumn("book", A.book_of("dst_start"))
    groups = items.groupBy("req", "book").agg(F.max("votes").alias("top_votes"), F.count(F.lit(1)).alias("n_items"))
    groups = groups.withColumn("group_rank", F.row_number().over(
        W.partitionBy("req").orderBy(F.desc("top_votes"), "book")).cast("bigint"))
    order = W.partitionBy("req", "book").orderBy(F.desc("votes"), "dst_start", "dst_end", "edge_id")
    ranked = items.withColumn("item_rank", F.row_number().over(order).cast("bigint")).where(F.col("item_rank") <= limit)
    return ranked.join(groups, ["req", "book"])


def directed_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target range): the strongest, ties by edge id; with its tier."""
    best = edges.groupBy("src", "dst_start", "dst_end").agg(
        F.max_by("edge_id", F.struct("votes", "edge_id")).alias("edge_id"), F.max("votes").alias("votes"))
    return best.withColumn("tier", A.vote_tier("votes"))


def degrees(edges: DataFrame) -> DataFrame:
    """How many edges touch each node; a node is a range."""
    return (edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("start"), F.col("src").alias("end")),
        F.struct(F.col("dst_start").alias("start"), F.col("dst_end").alias("end")))).alias("n"))
        .groupBy("n.start", "n.end").agg(F.count(F.lit(1)).alias("degree")))


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int = 2, max_degree: int = 12,
         max_nodes: int = 60, min_votes: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Breadth-first walk from many seed ranges at once.

    ``seeds``: seed, start, end.  Returns (nodes, edges, flags) per seed.  The
    caps are part of the operation: every node asks for its ``max_degree``
    strongest links in each direction, the vote floor is applied after those
    candidates are counted, and new nodes are admitted in visiting order until
    ``max_nodes``.  All per-seed state is therefore bounded by the caps, while
    the link joins run over the whole edge table.
    """
    def node_id(start: str, end: str):
        return F.concat_ws("-", F.col(start), F.col(end))

    nodes = cut_lineage(seeds.select("seed", "start", "end", node_id("start", "end").alias("id"),
                                     F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ord")))
    seeds = nodes.select("seed")
    frontier = nodes
    found_edges: DataFrame | None = None
    stats: DataFrame | None = None
    links = edges.select("edge_id", "src", "dst_start", "dst_end", "votes")

    for depth in range(max_depth):
        asked = frontier.select("seed", F.col("ord").alias("p_ord"), F.col("id").alias("p_id"),
                                F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        distinct_ranges = asked.select("p_start", "p_end").distinct()
        out = S.points_in_ranges(links, distinct_ranges, "src", ("p_start", "p_end"))
        inn = S.overlap_join(distinct_ranges, links, ("p_start", "p_end"), ("dst_start", "dst_end"))
        directions = [
            out.select("p_start", "p_end", F.lit(0).alias("dir"), "edge_id", "votes",
                       F.col("dst_start").alias("start"), F.col("dst_end").alias("end")),
            inn.select("p_start", "p_end", F.lit(1).alias("dir"), "edge_id", "votes",
                       F.col("src").alias("start"), F.col("src").alias("end"))]
        top = None
        for rows in directions:
            order = W.partitionBy("p_start", "p_end").orderBy(F.desc("votes"), "start", "end", "edge_id")
            cut = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_degree)
            top = cut if top is None else top.unionByName(cut)
        cand = (asked.join(top, ["p_start", "p_end"])
                .withColumn("id", node_id("start", "end"))
                .withColumn("seq", F.struct("p_ord", "dir", "rn")))
        cand = cut_lineage(cand)

        size = nodes.groupBy("seed").agg(F.count(F.lit(1)).alias("_size"))
        known = nodes.select("seed", "id", F.lit(True).alias("_known"))
        # New nodes in first-seen order; the k-th is admitted while the budget lasts.
        strong = cand.where(F.col("votes") >= min_votes).join(known, ["seed", "id"], "left_anti")
        first = strong.groupBy("seed", "id", "start", "end").agg(F.min("seq").alias("seq"))
        first = (first.withColumn("_k", F.row_number().over(W.partitionBy("seed").orderBy("seq")))
                 .join(size, "seed").withColumn("admitted", F.col("_size") + F.col("_k") <= max_nodes))
        fresh = first.where("admitted").select(
            "seed", "start", "end", "id", F.lit(depth + 1).alias("depth"),
            (F.col("_size") + F.col("_k") - 1).cast("bigint").alias("ord"), F.col("seq.p_ord").alias("parent_ord"))
        fresh = cut_lineage(fresh)
        # A frontier node is visited while the budget is not used up before it.
        before = (asked.select("seed", "p_ord").join(size, "seed")
                  .join(fresh.groupBy("seed", F.col("parent_ord").alias("p_ord")).agg(F.count(F.lit(1)).alias("_new")),
                        ["seed", "p_ord"], "left")
                  .withColumn("_used", F.col("_size") + F.coalesce(F.sum("_new").over(
                      W.partitionBy("seed").orderBy("p_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                  .withColumn("visited", F.col("_used") < max_nodes).select("seed", "p_ord", "visited"))
        seen = cand.join(before.where("visited").drop("visited"), ["seed", "p_ord"])
        reach = known.select("seed", "id").unionByName(fresh.select("seed", "id"))
        kept = (seen.where(F.col("votes") >= min_votes).join(reach, ["seed", "id"], "left_semi")
                .select("seed", F.lit(depth).alias("depth"), "seq",
                        F.when(F.col("dir") == 0, F.col("p_id")).otherwise(F.col("id")).alias("source"),
                        F.when(F.col("dir") == 0, F.col("id")).otherwise(F.col("p_id")).alias("target"), "votes"))
        full = (seen.where(F.col("votes") >= min_votes).join(reach, ["seed", "id"], "left_anti")
                .select("seed").distinct().withColumn("_full", F.lit(True)))
        per_seed = (seen.groupBy("seed", "p_ord", "dir").agg(F.count(F.lit(1)).alias("_c"))
                    .groupBy("seed").agg(F.sum("_c").alias("candidates"),
                                         F.max(F.col("_c") >= max_degree).alias("degree_capped")))
        stopped = before.groupBy("seed").agg(F.max(~F.col("visited")).alias("_stopped"))
        step = (stopped.join(per_seed, "seed", "left").join(full, "seed", "left")
                .select("seed", F.coalesce("candidates", F.lit(0)).alias("candidates"),
                        F.coalesce("degree_capped", F.lit(False)).alias("degree_capped"),
                        F.col("_stopped").alias("stopped"),
                        (F.col("_stopped") | F.coalesce("_full", F.lit(False))).alias("nodes_capped")))
        found_edges = kept if found_edges is None else found_edges.unionByName(kept)
        stats = step if stats is None else stats.unionByName(step)
        frontier = fresh.drop("parent_ord")
        nodes = nodes.unionByName(frontier)

    found_edges, stats = cut_lineage(found_edges), cut_lineage(stats)
    first_seen = found_edges.groupBy("seed", "source", "target").agg(
        F.min_by("votes", F.struct("depth", "seq")).alias("votes"))
    graph_edges = first_seen.withColumn("tier", A.vote_tier("votes"))
    ends = graph_edges.select("seed", F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("seed", "id").agg(F.count(F.lit(1)).alias("degree"))
    graph_nodes = (nodes.join(degree, ["seed", "id"], "left")
                   .select("seed", "id", "start", "end", F.col("depth").cast("bigint").alias("depth"),
                           F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"), "ord"))
    # The deepest nodes are never asked; with a used-up budget the walk stops before noticing.
    size = nodes.groupBy("seed").agg(F.count(F.lit(1)).alias("n_nodes"))
    deep = frontier.groupBy("seed").agg(F.count(F.lit(1)).alias("_deep"))
    broke = (stats.groupBy("seed").agg(F.sum("candidates").alias("candidates"),
                                       F.max("degree_capped").alias("degree_capped"),
                                       F.max("stopped").alias("stopped"),
                                       F.max("nodes_capped").alias("nodes_capped")))
    shown = graph_edges.groupBy("seed").agg(F.count(F.lit(1)).alias("shown"))
    flags = (seeds.select("seed").join(size, "seed").join(broke, "seed", "left").join(deep, "seed", "left")
             .join(shown, "seed", "left")
             .select("seed", "n_nodes", F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
                     F.coalesce("shown", F.lit(0)).cast("bigint").alias("shown"),
                     F.coalesce("degree_capped", F.lit(False)).alias("degree_capped"),
                     F.coalesce("nodes_capped", F.lit(False)).alias("nodes_capped"),
                     ((F.coalesce("_deep", F.lit(0)) > 0)
                      & ~F.coalesce("stopped", F.lit(False))).alias("depth_capped"))
             .withColumn("votes_capped", F.col("shown") < F.col("candidates")))
    return graph_nodes, graph_edges, flags


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst_start, dst_end, n_paths): targets two links away, over every address of the first target range.

    Parallel links are folded first on both sides; the ranges meet the sources in bins of their own size.
    """
    first = edges.groupBy("src", "dst_start", "dst_end").agg(F.count(F.lit(1)).alias("_n1")).select(
        F.col("src").alias("_from"), F.col("dst_start").alias("_s"), F.col("dst_end").alias("_e"), "_n1")
    second = edges.groupBy("src", "dst_start", "dst_end").agg(F.count(F.lit(1)).alias("_n2"))
    met = S.points_in_ranges(second, first, "src", ("_s", "_e"))
    return (met.groupBy(F.col("_from").alias("src"), "dst_start", "dst_end")
            .agg(F.sum(F.col("_n1") * F.col("_n2")).cast("bigint").alias("n_paths")))


def page_rank(edges: DataFrame, nodes: DataFrame, iterations: int = 10, damping: float = 0.85,
              tolerance: float | None = None) -> DataFrame:
    """Iterative rank over (src, dst) edges; the mass of sinks is spread evenly.

    Parallel edges are folded into one weighted edge once, so a hub costs one
    row per neighbour.  Edges and ranks are stored once in buckets of their
    node, so a step exchanges nothing but sums that were folded map-side.
    With ``tolerance`` the iteration ends as soon as the ranks' total change
    (one number) is below it.
    """
    dealt = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")      # the only exchange of edges
    weighted = dealt.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    share = F.col("w") / F.sum("w").over(W.partitionBy("src"))
    shares = cut_bucketed(weighted.select("src", "dst", share.alias("share")), "src", dealt=True)
    sources = shares.select(F.col("src").alias("node")).distinct().withColumn("_has_out", F.lit(True))
    base = nodes.select("node").distinct().join(sources, "node", "left")
    base = cut_bucketed(base.select("node", F.coalesce("_has_out", F.lit(False)).alias("has_out")), "node")
    n = S.row_total(base)
    ranks = base.withColumn("_n", n).select("node", "has_out", (1.0 / F.col("_n")).alias("rank"))
    for _ in range(iterations):
        new = cut_bucketed(rank_step(shares, ranks, base, n, damping), "node")
        if tolerance is not None:
            old = ranks.select("node", F.col("rank").alias("_old"))
            moved = new.join(old, "node").agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
            if moved is None or moved < tolerance:
                return new.select("node", "rank")
        ranks = new
    return ranks.select("node", "rank")


def rank_step(shares: DataFrame, ranks: DataFrame, base: DataFrame, n: Column, damping: float) -> DataFrame:
    """(node, has_out, rank) after one more step."""
    sent = (shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src")
            .groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("_in")))
    lost = ranks.where(~F.col("has_out")).select(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
    return (base.join(sent, "node", "left").withColumn("_n", n).withColumn("_lost", lost)
            .select("node", "has_out",
                    ((1 - damping) / F.col("_n")
                     + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") / F.col("_n"))).alias("rank")))
