"""Weighted references: heat, lists, totals, graph."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import address as A
from ..operators import links as L, space as S
from .registry import query

_BUCKETS = """hb AS (SELECT addr, inbound_count, weighted_score,
    CAST(least(5, (row_number() OVER (ORDER BY inbound_count, addr) - 1) * 5 // (SELECT count(*) FROM heat) + 1) AS BIGINT) AS heat_bucket FROM heat)"""


@query("ag01_reference_heat", "SELECT addr, inbound_count, weighted_score FROM heat", ("heat",))
def reference_heat(t):
    return L.heat(t.edges, t.space)


@query("jn05_range_expansion", "SELECT edge_id, addr FROM edge_reach", ("edge_reach",))
def range_expansion(t):
    """Every address of every target range, however wide; a link's id is put together behind the expansion."""
    steps = S.expand_ranges(t.edge_parts, t.space, "dst_start", "dst_end")
    return t._with_ids(steps, "addr").select("edge_id", "addr")


@query("jn05_range_report", """
    WITH p AS (SELECT l.*, a.pos AS ps, b.pos AS pe FROM links l LEFT JOIN space a ON a.addr = l.start LEFT JOIN space b ON b.addr = greatest(l.start, l."end"))
    SELECT bad, count(*) AS n, CAST(coalesce(sum(lost), 0) AS BIGINT) AS lost FROM (
      SELECT 'start' AS bad, NULL AS lost FROM p WHERE ps IS NULL UNION ALL SELECT 'end', NULL FROM p WHERE ps IS NOT NULL AND pe IS NULL
      UNION ALL SELECT 'truncated', pe - ps - 1 FROM p WHERE pe - ps > 1) GROUP BY bad""", ("links", "space"))
def range_report(t):
    """What an expansion to two addresses leaves out: unreal ends, and the addresses behind the cut."""
    return S.range_report(t.links, t.space, max_span=2).groupBy("bad").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lost"), F.lit(0).cast("bigint")).alias("lost"))


@query("wn02_heat_quintile", f"WITH {_BUCKETS} SELECT addr, inbound_count, weighted_score, heat_bucket FROM hb", ("heat",))
def heat_quintile(t):
    return L.heat_buckets(L.heat(t.edges, t.space))


@query("tk01_most_referenced", f"""WITH {_BUCKETS}
    SELECT addr, inbound_count, weighted_score, heat_bucket FROM hb ORDER BY inbound_count DESC, addr LIMIT 20""", ("heat",))
def most_referenced(t):
    return L.heat_buckets(L.heat(t.edges, t.space)).orderBy(F.desc("inbound_count"), "addr").limit(20)


@query("jn06_overlap_join", """
    SELECT p.req, e.edge_id FROM passages p JOIN edges e ON e.dst_start <= p.q_end AND e.dst_end >= p.q_start""", ("edges", "passages"))
def overlap_join(t):
    return L.inbound(t.passages, t.edges, -10**6).select("req", "edge_id")


@query("jn07_first_unit_preview", """
    SELECT d.addr, t.edition, t.text FROM (SELECT DISTINCT addr FROM omissions) d JOIN texts t ON t.addr = d.addr + 1""", ("texts", "omissions"))
def first_unit_preview(t):
    """Preview text for many targets; each target is looked up once however often it is cited."""
    targets = t.omissions.select("addr").dropDuplicates().withColumn("_k", F.col("addr") + 1)
    previews = t.texts.select(F.col("addr").alias("_k"), "edition", "text")
    return targets.join(previews, "_k").select("addr", "edition", "text")


@query("jn08_orphans", """
    SELECT 'link start' AS check_name, count(*) AS n FROM links WHERE start NOT IN (SELECT addr FROM space)
    UNION ALL SELECT 'link end', count(*) FROM links WHERE "end" NOT IN (SELECT addr FROM space)
    UNION ALL SELECT 'edge source', count(*) FROM edges WHERE src NOT IN (SELECT addr FROM space)""", ("edges", "links"))
def orphans(t):
    real = S.address_space(t.line_addresses).select("addr")

    def count(df, col, name):
        return (df.join(real, F.col(col) == real["addr"], "left_anti")
                .agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n"))
    return (count(t.links, "start", "link start").unionByName(count(t.links, "end", "link end"))
            .unionByName(count(t.edges, "src", "edge source")))


@query("ag21_node_degree", """
    SELECT "start", "end", count(*) AS degree FROM (SELECT src AS "start", src AS "end" FROM edges
      UNION ALL SELECT dst_start, dst_end FROM edges) GROUP BY 1, 2""", ("edges",))
def node_degree(t):
    return L.degrees(t.edges)


@query("ag22_reference_totals", """
    SELECT p.req, coalesce(o.n, 0) AS n_outbound, coalesce(i.n, 0) AS n_inbound, coalesce(u.n, 0) AS n_unique FROM passages p
    LEFT JOIN (SELECT req, count(*) AS n FROM passages JOIN edges ON src BETWEEN q_start AND q_end WHERE votes >= 0 GROUP BY req) o USING (req)
    LEFT JOIN (SELECT req, count(*) AS n FROM passages JOIN edges ON dst_start <= q_end AND dst_end >= q_start WHERE votes >= 0 GROUP BY req) i USING (req)
    LEFT JOIN (SELECT req, count(*) AS n FROM (
        SELECT req, edge_id FROM passages JOIN edges ON src BETWEEN q_start AND q_end WHERE votes >= 0
        UNION SELECT req, edge_id FROM passages JOIN edges ON dst_start <= q_end AND dst_end >= q_start WHERE votes >= 0) GROUP BY req) u USING (req)""",
       ("edges", "passages"))
def reference_totals(t):
    return L.totals(t.passages, t.edges)


@query("ag23_by_target_book", """
    WITH p AS (SELECT req, edge_id, votes, dst_start, dst_end, dst_start // 1000000 AS book FROM passages JOIN edges ON src BETWEEN q_start AND q_end WHERE votes >= 0),
    g AS (SELECT req, book, max(votes) AS top_votes, count(*) AS n_items FROM p GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY top_votes DESC, book) AS group_rank FROM g)
    SELECT * FROM (SELECT p.req, p.book, r.group_rank, r.top_votes, r.n_items, p.edge_id, p.votes,
      row_number() OVER (PARTITION BY p.req, p.book ORDER BY p.votes DESC, p.dst_start, p.dst_end, p.edge_id) AS item_rank
      FROM p JOIN r ON r.req = p.req AND r.book = p.book) WHERE item_rank <= 50""", ("edges", "passages"))
def by_target_book(t):
    rows = L.by_target_book(L.outbound(t.passages, t.edges), 50)
    return rows.select("req", "book", "group_rank", "top_votes", "n_items", "edge_id", "votes", "item_rank")


@query("wn13_top_neighbours", """
    SELECT src, edge_id, votes, rank FROM (SELECT src, edge_id, votes,
      row_number() OVER (PARTITION BY src ORDER BY votes DESC, dst_start, edge_id) AS rank FROM edges) WHERE rank <= 2""", ("edges",))
def top_neighbours(t):
    return L.strongest(t.edges, "src", 2, "dst_start").select("src", "edge_id", "votes", "rank")


@query("tk05_votes_then_address", """
    SELECT edge_id, votes, rank FROM (SELECT edge_id, votes, row_number() OVER (ORDER BY votes DESC, dst_start, edge_id) AS rank FROM edges) WHERE rank <= 100""", ("edges",))
def votes_then_address(t):
    top = t.edges.orderBy(F.desc("votes"), "dst_start", "edge_id").limit(100)
    order = W.orderBy(F.desc("votes"), "dst_start", "edge_id")   # 100 rows: the report itself
    return top.select("edge_id", "votes", F.row_number().over(order).cast("bigint").alias("rank"))


@query("gr02_directed_edges", """
    SELECT src, dst_start, dst_end, max(votes) AS votes, arg_max(edge_id, (votes, edge_id)) AS edge_id,
           CASE WHEN max(votes) >= 20 THEN 'strong' WHEN max(votes) >= 5 THEN 'moderate' ELSE 'light' END AS tier
    FROM edges GROUP BY 1, 2, 3""", ("edges",))
def directed_edges(t):
    return L.directed_edges(t.edges)


@query("gr03_reference_lists", """
    WITH o AS (SELECT req, 'outbound' AS direction, edge_id, votes, row_number() OVER (PARTITION BY req ORDER BY votes DESC, dst_start, edge_id) AS rank
               FROM passages JOIN edges ON src BETWEEN q_start AND q_end WHERE votes >= 5),
    i AS (SELECT req, 'inbound' AS direction, edge_id, votes, row_number() OVER (PARTITION BY req ORDER BY votes DESC, src, edge_id) AS rank
               FROM passages JOIN edges ON dst_start <= q_end AND dst_end >= q_start WHERE votes >= 5)
    SELECT * FROM o WHERE rank <= 10 UNION ALL SELECT * FROM i WHERE rank <= 10""", ("edges", "passages"))
def reference_lists(t):
    out = L.strongest(L.outbound(t.passages, t.edges, 5), "req", 10, "dst_start")
    inn = L.strongest(L.inbound(t.passages, t.edges, 5), "req", 10, "src")
    cols = ["edge_id", "votes", "rank"]
    return (out.select("req", F.lit("outbound").alias("direction"), *cols)
            .unionByName(inn.select("req", F.lit("inbound").alias("direction"), *cols)))


def _seeds(t):
    """One seed per collection: its most referenced address."""
    hot = L.heat(t.edges, t.space).withColumn("book", A.book_of("addr"))
    best = hot.groupBy("book").agg(F.max_by("addr", F.struct("inbound_count", -F.col("addr"))).alias("start"))
    return best.select(F.col("book").alias("seed"), "start", F.col("start").alias("end"))


def _walk_sql(result: str, depths: int = 2, degree: int = 12, most: int = 60) -> str:
    """The walk written out: one group of steps a depth, every rule as a row filter."""
    parts = ["""n0 AS MATERIALIZED (SELECT book AS seed, addr AS s, addr AS e, addr || '-' || addr AS id, 0 AS depth, 0 AS ord
      FROM (SELECT addr, addr // 1000000 AS book, row_number() OVER (PARTITION BY addr // 1000000 ORDER BY inbound_count DESC, addr) AS k FROM heat) WHERE k = 1), f0 AS (SELECT * FROM n0)"""]
    for d in range(depths):
        parts.append(f"""g{d} AS MATERIALIZED (SELECT DISTINCT s AS ps, e AS pe FROM f{d}),
    t{d} AS MATERIALIZED (SELECT * FROM (
      SELECT ps, pe, 0 AS dir, votes, dst_start AS s, dst_end AS e, row_number() OVER (PARTITION BY ps, pe ORDER BY votes DESC, dst_start, dst_end, edge_id) AS rn FROM g{d} JOIN edges ON src BETWEEN ps AND pe
      UNION ALL SELECT ps, pe, 1, votes, src, src, row_number() OVER (PARTITION BY ps, pe ORDER BY votes DESC, src, edge_id) FROM g{d} JOIN edges ON dst_start <= pe AND dst_end >= ps) WHERE rn <= {degree}),
    k{d} AS MATERIALIZED (SELECT f.seed, f.ord AS po, f.id AS pid, t.dir, t.rn, t.votes, t.s, t.e, t.s || '-' || t.e AS id FROM f{d} f JOIN t{d} t ON f.s = t.ps AND f.e = t.pe),
    z{d} AS (SELECT seed, count(*) AS size FROM n{d} GROUP BY 1),
    new{d} AS (SELECT seed, id, s, e, row_number() OVER (PARTITION BY seed ORDER BY min(po * 1000000 + dir * 1000 + rn)) AS k, min(po) AS po
      FROM k{d} WHERE votes >= 1 AND (seed, id) NOT IN (SELECT (seed, id) FROM n{d}) GROUP BY 1, 2, 3, 4),
    f{d + 1} AS MATERIALIZED (SELECT seed, s, e, id, {d + 1} AS depth, size + k - 1 AS ord, po FROM new{d} JOIN z{d} USING (seed) WHERE size + k <= {most}),
    v{d} AS MATERIALIZED (SELECT seed, f.ord AS po, size + coalesce(sum(c) OVER (PARTITION BY seed ORDER BY f.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {most} AS visited
      FROM f{d} f JOIN z{d} USING (seed) LEFT JOIN (SELECT seed, po AS ord, count(*) AS c FROM f{d + 1} GROUP BY 1, 2) USING (seed, ord)),
    n{d + 1} AS MATERIALIZED (SELECT * FROM n{d} UNION ALL SELECT seed, s, e, id, depth, ord FROM f{d + 1}),
    seen{d} AS MATERIALIZED (SELECT k.*, (seed, id) IN (SELECT (seed, id) FROM n{d + 1}) AS reached FROM k{d} k JOIN v{d} USING (seed, po) WHERE visited),
    e{d} AS (SELECT seed, CASE dir WHEN 0 THEN pid ELSE id END AS source, CASE dir WHEN 0 THEN id ELSE pid END AS target FROM seen{d} WHERE votes >= 1 AND reached),
    w{d} AS (SELECT seed, bool_or(NOT visited) AS stopped, (SELECT count(*) FROM seen{d} x WHERE x.seed = v.seed) AS candidates,
      coalesce((SELECT bool_or(c >= {degree}) FROM (SELECT seed, count(*) AS c FROM seen{d} GROUP BY seed, po, dir) y WHERE y.seed = v.seed), false) AS degree_capped,
      coalesce((SELECT bool_or(votes >= 1 AND NOT reached) FROM seen{d} x WHERE x.seed = v.seed), false) AS was_full FROM v{d} v GROUP BY seed)""")
    steps = " UNION ALL ".join(f"SELECT * FROM w{d}" for d in range(depths))
    shown = " UNION ".join(f"SELECT * FROM e{d}" for d in range(depths))
    parts.append(f"""shown AS MATERIALIZED ({shown}), steps AS MATERIALIZED ({steps}),
    deg AS (SELECT seed, id, count(*) AS degree FROM (SELECT seed, source AS id FROM shown UNION ALL SELECT seed, target FROM shown) GROUP BY 1, 2),
    nodes AS (SELECT seed, id, s AS "start", e AS "end", CAST(depth AS BIGINT) AS depth, coalesce(degree, 0) AS degree FROM n{depths} LEFT JOIN deg USING (seed, id)),
    flags AS (SELECT *, shown < candidates AS votes_capped FROM (SELECT seed, (SELECT count(*) FROM n{depths} n WHERE n.seed = w.seed) AS n_nodes, CAST(sum(candidates) AS BIGINT) AS candidates,
      (SELECT count(*) FROM shown x WHERE x.seed = w.seed) AS shown, bool_or(degree_capped) AS degree_capped, bool_or(stopped OR was_full) AS nodes_capped,
      (SELECT count(*) > 0 FROM f{depths} f WHERE f.seed = w.seed) AND NOT bool_or(stopped) AS depth_capped FROM steps w GROUP BY seed))""")
    return "WITH " + ",\n    ".join(parts) + f" SELECT * FROM {result}"


@query("gr01_walk_nodes", _walk_sql("nodes"), ("edges", "heat"))
def walk_nodes(t):
    return L.walk(_seeds(t), t.edges)[0].drop("ord")


@query("gr01_walk_flags", _walk_sql("flags"), ("edges", "heat"))
def walk_flags(t):
    return L.walk(_seeds(t), t.edges)[2]


@query("jn19_two_hops", """
    SELECT a.src, count(*) AS n_paths, count(DISTINCT (b.dst_start, b.dst_end)) AS n_targets
    FROM edges a JOIN edges b ON b.src BETWEEN a.dst_start AND a.dst_end GROUP BY a.src""", ("edges",))
def two_hops(t):
    """The second hop starts at any address of the first one's target range."""
    hops = L.two_hops(t.edges)
    return hops.groupBy("src").agg(F.sum("n_paths").alias("n_paths"), F.count(F.lit(1)).alias("n_targets"))


def _rank_sql(iterations: int) -> str:
    parts = ["""n AS (SELECT count(*) AS n FROM space), w AS (SELECT e.src, h.addr AS dst, count(*) AS w FROM edges e JOIN edge_reach h ON h.edge_id = e.edge_id GROUP BY 1, 2),
    sh AS (SELECT w.src, dst, w.w / o.o AS share FROM w JOIN (SELECT src, sum(w) AS o FROM w GROUP BY src) o ON o.src = w.src),
    b AS (SELECT addr AS node, addr IN (SELECT src FROM sh) AS has_out FROM space),
    r0 AS (SELECT node, has_out, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM b)"""]
    for i in range(iterations):
        parts.append(f"""r{i+1} AS MATERIALIZED (SELECT b.node, b.has_out, 0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * (coalesce(s.v, 0)
          + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE NOT has_out) / (SELECT n FROM n)) AS rank
          FROM b LEFT JOIN (SELECT dst AS node, sum(share * rank) AS v FROM sh JOIN r{i} ON r{i}.node = sh.src GROUP BY 1) s ON s.node = b.node)""")
    return "WITH " + ",\n".join(parts) + f" SELECT node, round(rank * 1e6, 4) AS rank_ppm FROM r{iterations}"


@query("gr04_page_rank", _rank_sql(4), ("edges", "edge_reach", "space"))
def page_rank(t):
    """A link points at every address of its target range, however wide."""
    links = t.edges.select("src", "dst_start", "dst_end")
    e = S.expand_ranges(links, t.space, "dst_start", "dst_end").select("src", F.col("addr").alias("dst"))
    ranks = L.page_rank(e, t.space.select(F.col("addr").alias("node")), iterations=4)
    return ranks.select("node", F.round(F.col("rank") * 1e6, 4).alias("rank_ppm"))
