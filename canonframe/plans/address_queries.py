"""Addresses, ranges, passages and chapter facts."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import address as A
from ..operators import links as L, passages as P, space as S
from .registry import query


@query("prj01_pack_unpack", """
    SELECT l_orderkey AS k, l_linenumber AS n, l_orderkey * 1000 + l_linenumber AS addr,
           (l_orderkey * 1000 + l_linenumber) // 1000000 AS book,
           ((l_orderkey * 1000 + l_linenumber) // 1000) % 1000 AS chapter,
           (l_orderkey * 1000 + l_linenumber) % 1000 AS unit,
           l_orderkey >= 1000 AND l_orderkey % 1000 >= 1 AS encodable FROM lineitem""")
def pack_unpack(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                           A.pack(F.expr("l_orderkey div 1000"), F.expr("l_orderkey % 1000"), "l_linenumber").alias("addr"))
    return (df.withColumn("book", A.book_of("addr")).withColumn("chapter", A.chapter_of("addr"))
            .withColumn("unit", A.unit_of("addr")).withColumn("encodable", A.is_encodable("addr")))


@query("prj02_range_bounds", """
    SELECT book, book * 1000000 + CASE WHEN bool_or(chapter = 1 AND unit = 0) THEN 1000 ELSE 1001 END AS b_start,
           book * 1000000 + 999999 AS b_end,
           book * 1000000 + max(chapter) * 1000 + 1 AS c_start, book * 1000000 + max(chapter) * 1000 + 999 AS c_end
    FROM canon GROUP BY book""", ("canon",))
def range_bounds(t):
    f = P.book_flags(t.canon)
    return f.select("book", A.book_start("book", "has_prologue").alias("b_start"), A.book_end("book").alias("b_end"),
                    A.chapter_start("book", "last_chapter").alias("c_start"),
                    A.chapter_end("book", "last_chapter").alias("c_end"))


@query("prj03_range_scan", """
    WITH hb AS (SELECT addr, least(5, (row_number() OVER (ORDER BY inbound_count, addr) - 1) * 5 // (SELECT count(*) FROM heat) + 1) AS heat_bucket FROM heat)
    SELECT p.req, s.addr, s.chapter, s.unit, CAST(coalesce(h.heat_bucket, 0) AS BIGINT) AS heat_bucket
    FROM passages p JOIN space s ON s.addr // 1000 = p.req LEFT JOIN hb h ON h.addr = s.addr""", ("heat", "passages"))
def range_scan(t):
    buckets = L.heat_buckets(L.heat(t.edges, t.space))
    rows = P.in_chapters(L.with_heat(t.space, buckets), t.passages)
    return rows.select("req", "addr", "chapter", "unit", "heat_bucket")


@query("prj04_existing_addresses", """
    SELECT e.edge_id, s.addr FROM edges e JOIN space s ON s.addr BETWEEN e.dst_start AND e.dst_end""", ("edges",))
def existing_addresses(t):
    return S.points_in_ranges(t.space.select("addr"), t.edges.select("edge_id", "dst_start", "dst_end"),
                              "addr", ("dst_start", "dst_end")).select("edge_id", "addr")


@query("prj05_exists", """
    SELECT k AS addr, k IN (SELECT addr FROM space) AS present
    FROM (SELECT DISTINCT l_orderkey * 1000 + (l_partkey % 9) AS k FROM lineitem)""", ("space",))
def exists(t):
    asked = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 9).alias("addr")).distinct()
    real = t.line_addresses.distinct().withColumn("_hit", F.lit(True))
    return asked.join(real, "addr", "left").select("addr", F.coalesce("_hit", F.lit(False)).alias("present"))


@query("prj06_text_lengths", """
    SELECT t.edition, t.addr, CAST(length(t.text) AS INTEGER) AS n_chars FROM texts t
    WHERE t.addr IN (SELECT addr FROM omissions)""", ("texts", "omissions"))
def text_lengths(t):
    ids = t.omissions.select("addr").distinct()
    return t.texts.join(ids, "addr", "left_semi").select("edition", "addr", F.length("text").alias("n_chars"))


@query("prj07_overlap", """
    SELECT p.req, count(*) AS n_links, CAST(min(l.start) AS BIGINT) AS first_start
    FROM passages p JOIN links l ON l.start <= p.q_end AND l."end" >= p.q_start GROUP BY p.req""", ("passages", "links"))
def overlap(t):
    pairs = S.overlap_join(t.passages, t.links, ("q_start", "q_end"), ("start", "end"))
    return pairs.groupBy("req").agg(F.count(F.lit(1)).alias("n_links"), F.min("start").alias("first_start"))


@query("prj10_matches_all", r"""
    SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(lang || ' ' || source || ' ' || text)), 'the')
      AND contains(lower(strip_accents(lang || ' ' || source || ' ' || text)), 'src1')""")
def matches_all(t):
    from ..functions.text import matches_all as m
    return t.documents.where(m(F.lit("Thé SRC1"), "lang", "source", "text")).select("doc_id", "lang")


@query("prj11_book_flags", """
    SELECT book, bool_or(chapter = 1 AND unit = 0) AS has_prologue, max(chapter) AS last_chapter, min(chapter) AS first_chapter,
           count(DISTINCT chapter) AS n_chapters, count(*) AS n_units FROM space GROUP BY book""", ("space",))
def book_flags(t):
    return P.book_flags(S.address_space(t.line_addresses))


@query("prj12_vote_tiers", """
    SELECT CASE WHEN votes >= 20 THEN 'strong' WHEN votes >= 5 THEN 'moderate' ELSE 'light' END AS tier,
           count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM edges GROUP BY 1""", ("edges",))
def vote_tiers(t):
    return (t.edges.groupBy(A.vote_tier("votes").alias("tier"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes")))


@query("prj15_chunk_milliseconds", """
    SELECT event_id, CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS BIGINT) AS start_ms FROM events""")
def chunk_milliseconds(t):
    offset = t.events_us.groupBy("user_id").agg(F.min("us").alias("_off"))
    return t.events_us.join(offset, "user_id").select("event_id", F.expr("(us - _off) div 1000").alias("start_ms"))


@query("wn04_dense_rank", "SELECT addr, pos FROM space", ("space",))
def dense_rank(t):
    return t.space.select("addr", "pos")


@query("wn05_neighbours", """
    SELECT book, chapter, coalesce(lag(chapter) OVER w, -1) AS prev, coalesce(lead(chapter) OVER w, -1) AS next
    FROM (SELECT DISTINCT book, chapter FROM space) WINDOW w AS (PARTITION BY book ORDER BY chapter)""", ("space",))
def adjacent(t):
    return S.neighbours(S.address_space(t.line_addresses)).fillna(-1, ["prev", "next"])


@query("jn18_neighbour_lookup", """
    WITH c AS (SELECT DISTINCT book, chapter FROM space)
    SELECT q.book, q.chapter, coalesce((SELECT max(chapter) FROM c WHERE c.book = q.book AND c.chapter < q.chapter), -1) AS prev,
           coalesce((SELECT min(chapter) FROM c WHERE c.book = q.book AND c.chapter > q.chapter), -1) AS next
    FROM (SELECT DISTINCT l_orderkey // 1000 AS book, (l_orderkey + l_partkey) % 1000 AS chapter FROM lineitem) q""", ("space",))
def neighbour_lookup(t):
    """Nearest existing chapters around chapters that need not exist."""
    have = S.address_space(t.line_addresses).select("book", "chapter").distinct().withColumn("_real", F.col("chapter"))
    asked = t.lineitem.select(F.expr("l_orderkey div 1000").alias("book"),
                              ((F.col("l_orderkey") + F.col("l_partkey")) % 1000).alias("chapter")).distinct().withColumn("_q", F.lit(True))
    both = asked.join(have, ["book", "chapter"], "full_outer")
    w = W.partitionBy("book").orderBy("chapter")
    return (both.withColumn("prev", F.last("_real", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("next", F.first("_real", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
            .where("_q").select("book", "chapter", "prev", "next").fillna(-1, ["prev", "next"]))


@query("wn10_merge_ranges", """
    WITH r AS (SELECT o_custkey AS user_id, CAST(o_orderkey * 10 AS BIGINT) AS s, o_orderkey * 10 + CAST(floor(o_totalprice / 10) AS BIGINT) AS e FROM orders),
    o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r),
    i AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM o)
    SELECT user_id, min(s) AS "start", max(e) AS "end", count(DISTINCT s) AS n_starts FROM i GROUP BY user_id, island""")
def merge_ranges(t):
    r = t.orders.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") * 10).alias("start"),
                        (F.col("o_orderkey") * 10 + F.floor(F.col("o_totalprice") / 10)).alias("end"))
    return S.merge_ranges(r, "start", "end", ["user_id"])


@query("wn12_chapter_headings", """
    SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS heading FROM conversations""")
def chapter_headings(t):
    return P.with_chapter_headings(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "role", ["turn"])


@query("ag15_chapter_summary", """
    SELECT book, chapter, count(*) AS n_units, min(unit) AS first_unit, max(unit) AS last_unit FROM space GROUP BY book, chapter""", ("space",))
def chapter_summary(t):
    return P.chapter_summary(S.address_space(t.line_addresses))


@query("ag16_chapter_extremes", """
    SELECT book, min(chapter) AS first_chapter, max(chapter) AS last_chapter, count(DISTINCT chapter) AS n_chapters,
           max(addr) AS last_addr FROM canon GROUP BY book""", ("canon",))
def chapter_extremes(t):
    return t.canon.groupBy("book").agg(F.min("chapter").alias("first_chapter"), F.max("chapter").alias("last_chapter"),
                                       F.countDistinct("chapter").alias("n_chapters"), F.max("addr").alias("last_addr"))


@query("ag34_corpus_totals", """
    SELECT 'addresses' AS fact, count(*) AS n FROM space UNION ALL SELECT 'references', count(*) FROM edges
    UNION ALL SELECT 'collections', count(DISTINCT book) FROM space""", ("edges",))
def corpus_totals(t):
    sp = S.address_space(t.line_addresses)
    return (sp.select(F.lit("addresses").alias("fact")).unionByName(t.edges.select(F.lit("references").alias("fact")))
            .groupBy("fact").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(sp.select(F.lit("collections").alias("fact"), "book").groupBy("fact").agg(F.countDistinct("book").alias("n"))))


@query("tk02_opening_units", """
    SELECT req, addr, rank FROM (SELECT p.req, s.addr, row_number() OVER (PARTITION BY p.req ORDER BY s.addr) AS rank
    FROM passages p JOIN space s ON s.addr // 1000 = p.req) WHERE rank <= 3""", ("space", "passages"))
def opening_units(t):
    return P.opening(P.in_chapters(S.address_space(t.line_addresses), t.passages), ["req"], 3).select("req", "addr", "rank")


@query("tk03_request_pages", """
    WITH q AS (SELECT s_suppkey AS req, greatest(s_suppkey * 37 - 50, 0) AS off, least(greatest(s_suppkey % 300 - 20, 1), 100) AS lim FROM supplier)
    SELECT q.req, s.addr, n.total FROM q JOIN space s ON s.pos >= q.off AND s.pos < q.off + q.lim CROSS JOIN (SELECT count(*) AS total FROM space) n""", ("space",))
def request_pages(t):
    """Pages for a table of requests: offsets below zero and limits outside 1 to 100 are clamped."""
    asked = t.supplier.select(F.col("s_suppkey").alias("req"), (F.col("s_suppkey") * 37 - 50).alias("offset"), (F.col("s_suppkey") % 300 - 20).alias("limit"))
    return P.pages(t.space, asked, 100).withColumn("total", S.row_total(t.space))


@query("tk03_page", """
    SELECT addr, total FROM (SELECT addr, row_number() OVER (ORDER BY addr) AS rn, count(*) OVER () AS total FROM space) WHERE rn > 100 AND rn <= 120""", ("space",))
def page(t):
    """One page with the true total; offset and limit come from clamped bounds."""
    sp = S.address_space(t.line_addresses).select("addr")
    rows = sp.orderBy("addr").offset(100).limit(20)
    return rows.withColumn("total", S.row_total(sp))
