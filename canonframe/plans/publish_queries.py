"""Annotations, segments, gates, fingerprints, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as An, coverage as C, gates as G, links as L, space as S, words as Wd, timeline as Tl
from ..sinks import publish as Pu
from ..sources import placement as Pl
from ..functions import text as T
from .registry import query
from .source_queries import WELDS
from .views import epoch_micros


def s(c):
    return F.col(c).cast("string")


def _annotations(t):
    """Lineitems as annotations with every kind of defect."""
    q = F.col("l_quantity").cast("int")
    addr = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q).alias("id"),
        F.when(F.col("l_returnflag") == "R", "highlight").when(F.col("l_returnflag") == "A", "note").otherwise(F.when(q % 2 == 0, "bookmark").otherwise("sticker")).alias("kind"),
        addr.alias("start_addr"), (addr + F.when(q == 3, -1).otherwise(q % 3)).alias("end_addr"),
        F.when(q > 10, q - 12).alias("start_offset"), F.when(q > 11, q - 9).alias("end_offset"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("src"), (F.col("l_suppkey") % 25).cast("string"))).alias("edition"),
        F.lit("q").alias("quoted"), F.repeat(F.lit("x"), F.when(q == 50, 20001).otherwise(5)).alias("body"),
        F.when(q % 7 == 0, "Red!").otherwise("amber").alias("color"), F.array(F.when(q % 11 == 0, "").otherwise("t")).alias("tags"))


_ANN = """an AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q) AS id, * FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, l_orderkey * 1000 + l_linenumber AS sa,
    l_orderkey * 1000 + l_linenumber + CASE WHEN CAST(l_quantity AS INTEGER) = 3 THEN -1 ELSE CAST(l_quantity AS INTEGER) % 3 END AS ea,
    CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS INTEGER) - 12 END AS so, CASE WHEN l_quantity > 11 THEN CAST(l_quantity AS INTEGER) - 9 END AS eo,
    CASE WHEN l_linestatus = 'F' THEN 'src' || l_suppkey % 25 END AS ed FROM lineitem))"""


def _enc(c):
    return f"({c} >= 1000000 AND ({c} // 1000) % 1000 >= 1 AND {c} % 1000 >= 1)"


@query("prj14_annotation_rules", f"""WITH {_ANN} SELECT id, array_to_string(list_filter([CASE WHEN l_returnflag = 'N' AND q % 2 = 1 THEN 'kind' END, CASE WHEN NOT {_enc('sa')} THEN 'start address' END, CASE WHEN NOT {_enc('ea')} THEN 'end address' END,
    CASE WHEN ea < sa THEN 'reversed' END, CASE WHEN (so IS NULL) <> (eo IS NULL) THEN 'offsets not paired' END, CASE WHEN so < 0 AND eo IS NOT NULL THEN 'negative offset' END,
    CASE WHEN so IS NOT NULL AND eo IS NOT NULL AND ed IS NULL THEN 'offsets need an edition' END, CASE WHEN q = 50 THEN 'body too long' END, CASE WHEN q % 7 = 0 THEN 'color' END, CASE WHEN q % 11 = 0 THEN 'tag length' END], lambda x: x IS NOT NULL), ',') AS problems FROM an""")
def annotation_rules(t):
    return An.check_shape(_annotations(t)).select("id", F.array_join("problems", ",").alias("problems"))


@query("prj14_annotation_anchors", f"""WITH {_ANN}, ln AS (SELECT 'src' || p_partkey % 25 AS ed, l_orderkey * 1000 + l_linenumber AS addr, max(length(p_name)) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 25 < 20 GROUP BY 1, 2)
    SELECT an.id, array_to_string(list_filter([CASE WHEN an.ed IS NOT NULL AND CAST(substr(an.ed, 4) AS INT) >= 20 THEN 'unknown edition' END, CASE WHEN sa NOT IN (SELECT addr FROM space) THEN 'start does not exist' END,
      CASE WHEN ea NOT IN (SELECT addr FROM space) THEN 'end does not exist' END, CASE WHEN so IS NOT NULL AND eo IS NOT NULL AND (a.n IS NULL OR b.n IS NULL) THEN 'offsets on unprinted text' END,
      CASE WHEN so IS NOT NULL AND eo IS NOT NULL AND so >= a.n AND b.n IS NOT NULL THEN 'start past text' END, CASE WHEN so IS NOT NULL AND eo > b.n AND a.n IS NOT NULL THEN 'end past text' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM an LEFT JOIN ln a ON a.ed = an.ed AND a.addr = sa LEFT JOIN ln b ON b.ed = an.ed AND b.addr = ea""", ("space",))
def annotation_anchors(t):
    lengths = (t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).where("p_partkey % 25 < 20")
               .groupBy(F.concat(F.lit("src"), (F.col("p_partkey") % 25).cast("string")).alias("edition"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("addr"))
               .agg(F.max(F.length("p_name")).alias("n_chars")))
    d = An.check_anchor(_annotations(t), S.address_space(t.line_addresses), lengths, t.editions)
    return d.select("id", F.array_join("anchor_problems", ",").alias("problems"))


_MARKS = """mk AS (SELECT l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS mark_id,
      (['search-hit', 'highlight', 'note', 'variant', 'crossref', 'source', 'note'])[l_linenumber] AS kind, CAST(l_quantity AS INTEGER) - 3 AS s, CAST(l_quantity AS INTEGER) + CAST(l_partkey % 15 AS INTEGER) - 4 AS e FROM lineitem),
    tx AS (SELECT o_orderkey AS text_id, 40 AS n FROM orders),
    us AS (SELECT text_id, mark_id, kind, greatest(0, least(s, 40)) AS s, greatest(0, least(e, 40)) AS e FROM mk WHERE greatest(0, least(e, 40)) > greatest(0, least(s, 40))),
    pt AS (SELECT text_id, s AS p FROM us UNION SELECT text_id, e FROM us UNION SELECT text_id, 0 FROM tx UNION SELECT text_id, 40 FROM tx),
    sg AS (SELECT text_id, p AS start, lead(p) OVER (PARTITION BY text_id ORDER BY p) AS "end" FROM pt)"""


@query("gr05_segments", f"""WITH {_MARKS} SELECT sg.text_id, sg.start, sg."end", coalesce(string_agg(CAST(u.mark_id AS VARCHAR), ',' ORDER BY CAST(u.mark_id AS VARCHAR)), '') AS marks,
    coalesce(arg_max(u.kind, (list_position(['source', 'crossref', 'variant', 'note', 'highlight', 'search-hit'], u.kind), -u.mark_id)), '') AS dominant, count(u.mark_id) AS n_marks
    FROM sg LEFT JOIN us u ON u.text_id = sg.text_id AND u.s <= sg.start AND u.e >= sg."end" WHERE sg."end" IS NOT NULL GROUP BY 1, 2, 3""")
def segments(t):
    from pyspark.sql import Window as W
    kinds = F.array(*[F.lit(k) for k in ["search-hit", "highlight", "note", "variant", "crossref", "source", "note"]])
    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("bigint")
    q = F.col("l_quantity").cast("int")
    marks = t.lineitem.select(F.col("l_orderkey").alias("text_id"), no.alias("mark_id"), F.element_at(kinds, F.col("l_linenumber")).alias("kind"),
                              (q - 3).alias("start"), (q + (F.col("l_partkey") % 15).cast("int") - 4).alias("end"))
    return An.segments(t.orders.select(F.col("o_orderkey").alias("text_id"), F.lit(40).alias("n_chars")), marks, ["text_id"])


# --- fingerprint and exports -----------------------------------------------------------------------------

@query("ag27_fingerprint", """WITH d AS (SELECT sha256(array_to_string([length(CAST(x AS VARCHAR)) || ':' || x || ';' FOR x IN [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), CAST(epoch_us(o_orderdate) AS VARCHAR), o_orderpriority]], '')) AS d FROM orders),
    g AS (SELECT d, count(*) AS n FROM d GROUP BY d), l AS (SELECT substr(d, 1, 2) AS k, sha256(string_agg(d || '*' || n, ',' ORDER BY d || '*' || n)) AS v, sum(n) AS n FROM g GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, substr(sha256(string_agg(k || '=' || v, ',' ORDER BY k || '=' || v)), 1, 16) AS fingerprint FROM l""")
def fingerprint(t):
    rows = t.orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("bigint")).withColumn("o_orderdate", epoch_micros("o_orderdate"))
    return Pu.fingerprint(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("snk01_staged_build", """SELECT edition, count(*) AS n FROM texts GROUP BY 1""", ("texts",))
def staged_build(t):
    """Write, check, publish, and read back through the pointer."""
    import uuid
    from ..session import shared_folder
    root = f"{shared_folder(t.spark)}/publish-{uuid.uuid4().hex}"
    build = Pu.StagedBuild(t.spark, root, "b1")
    texts = build.write("texts", t.texts.select("edition", "addr", "text"), partition_by=["edition"], sort_by=["edition", "addr"])
    build.promote([("duplicate address", G.repeated(texts, ["edition", "addr"])), ("empty text", G.broken(texts, F.length("text") > 0))])
    published = build.path("texts", Pu.current_build(t.spark, root))
    return t.spark.read.schema("addr long, text string, edition string").parquet(published).groupBy("edition").agg(F.count(F.lit(1)).alias("n"))


@query("snk02_bounded_export", """SELECT o_orderkey || chr(9) || o_orderpriority AS line, (SELECT count(*) FROM orders) AS total, least((SELECT count(*) FROM orders), 5000) AS exported,
    (SELECT count(*) FROM orders) > 5000 AS truncated FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 5000""")
def bounded_export(t):
    return Pu.bounded_export(t.orders, ["o_orderkey", "o_orderpriority"], [F.desc("o_custkey"), "o_orderkey"])


_URLS = """av AS (SELECT edition, addr FROM texts UNION SELECT edition, addr FROM omissions),
    ur AS (SELECT DISTINCT edition, unnest(['/read/' || addr // 1000000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000 || '.' || addr % 1000]) AS url FROM av)"""


@query("snk03_url_lists", f"WITH {_URLS} SELECT edition, url FROM ur", ("texts", "omissions"))
def url_lists(t):
    return Pu.url_list(C.available(t.texts, t.omissions))


@query("st05_url_coverage", f"""WITH {_URLS}, e AS (SELECT DISTINCT edition, unnest(['/read/' || addr // 1000000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000 || '.' || addr % 1000]) AS url FROM texts), a AS (SELECT edition, url FROM ur)
    SELECT edition, url, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT edition, url, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""", ("texts", "omissions"))
def url_coverage(t):
    """Collection, chapter and unit pages of every edition: those published against those with a printed text."""
    urls = Pu.url_list(C.available(t.texts, t.omissions))
    expected = Pu.url_list(t.texts.select("edition", "addr"))
    return C.two_way_difference(urls, expected, ["edition", "url"])


@query("snk04_review_sheet", """WITH c AS (SELECT p.event_id, string_agg('  - Source: ' || s_name || ', ' || p.ordinal, chr(10) ORDER BY p.ordinal, s_name || ', ' || p.ordinal) AS c FROM positions p JOIN supplier ON s_suppkey = p.source_id GROUP BY 1),
    v AS (SELECT subject_id, string_agg('  - Verse (' || link_type || '): ' || start || CASE WHEN "end" <> start THEN ' - ' || "end" ELSE '' END, chr(10) ORDER BY start, "end", link_type) AS v FROM links WHERE subject_kind = 'event' GROUP BY 1)
    SELECT e.event_id, concat_ws(chr(10), '- [ ] **' || title || '** (' || status || ')', c.c, v.v) AS sheet FROM timeline_events e LEFT JOIN c ON c.event_id = e.event_id LEFT JOIN v ON v.subject_id = e.event_id
    WHERE status IN ('draft', 'sources-located')""", ("positions", "links", "timeline_events"))
def review_sheet(t):
    cites = t.positions.join(t.supplier, F.col("s_suppkey") == F.col("source_id")).select("event_id", "ordinal", F.concat("s_name", F.lit(", "), s("ordinal")).alias("label"))
    links = t.links.where("subject_kind = 'event'").withColumnRenamed("subject_id", "event_id")
    return Pu.review_lines(t.timeline_events, cites, links)


@query("snk05_nested_response", """SELECT n_regionkey, '{"region":' || n_regionkey || ',"groups":[' || string_agg('{"nation":"' || n_name || '","customers":' || c || '}', ',' ORDER BY n_name) || ']}' AS body
    FROM (SELECT n_regionkey, n_name, count(*) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1""")
def nested_response(t):
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers")).join(t.nation, "n_nationkey")
    g = per.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("nation"), "customers"))).alias("groups"))
    return g.select("n_regionkey", F.to_json(F.struct(F.col("n_regionkey").alias("region"), "groups")).alias("body"))


@query("snk06_build_summary", """SELECT 'texts' AS table_name, count(*) AS n_rows FROM texts UNION ALL SELECT 'omissions', count(*) FROM omissions UNION ALL SELECT 'canon', count(*) FROM canon
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem""", ("texts", "omissions", "canon"))
def build_summary(t):
    return Pu.table_counts({"texts": t.texts, "omissions": t.omissions, "canon": t.canon, "lineitem": t.lineitem})


# --- gates -----------------------------------------------------------------------------------------------

def _sql(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS gate, CAST(({sql}) AS BIGINT) AS violations" for name, sql in rows)


@query("qg01_size_bands", _sql([("space size", "SELECT count(*) BETWEEN 1 AND 100 FROM space"), ("editions", "SELECT count(*) NOT BETWEEN 1 AND 20 FROM editions")]).replace("count(*) BETWEEN 1 AND 100", "count(*) NOT BETWEEN 1 AND 100"), ("space", "editions"))
def size_bands(t):
    return G.run([("space size", G.count_band(S.address_space(t.line_addresses), 1, 100)), ("editions", G.count_band(t.editions, 1, 20))])


@query("qg02_orphans", _sql([("links", "SELECT count(*) FROM links WHERE \"end\" NOT IN (SELECT addr FROM space)"), ("orders", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")]), ("links", "space"))
def orphans(t):
    return G.run([("links", G.orphans(t.links, "end", S.address_space(t.line_addresses), "addr")), ("orders", G.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey"))])


@query("qg03_declared_chapters", _sql([("chapters", "SELECT count(*) FROM (SELECT book, count(DISTINCT chapter) AS n FROM canon GROUP BY 1) WHERE n <> 4")]), ("canon",))
def declared_chapters(t):
    return G.run([("chapters", G.broken(t.canon.groupBy("book").agg(F.countDistinct("chapter").alias("n")), F.col("n") == 4))])


@query("qg04_licence_and_pins", _sql([("licence phrase", "SELECT count(*) FROM pages WHERE NOT contains(html, '&copy;')"), ("pinned hash", "SELECT count(*) FROM pages WHERE page_id % 2 <> 0")]))
def licence_and_pins(t):
    from .source_queries import licence_evidence, manifest
    return G.run([("licence phrase", G.broken(licence_evidence(t), F.col("holds"))), ("pinned hash", G.broken(manifest(t), F.col("pin_ok")))])


@query("qg05_weld_sites", f"WITH {WELDS} " + _sql([("weld sites", "SELECT count(*) FROM welds WHERE n_sites > 0")]))
def weld_gate(t):
    from .source_queries import weld_sites
    return G.run([("weld sites", weld_sites(t).where("n_sites > 0"))])


@query("qg06_unplaced", _sql([("unresolved", "SELECT count(*) FROM lineitem l WHERE l_orderkey * 1000 + l_partkey % 9 NOT IN (SELECT addr FROM space)"), ("unplaced differs from review", "SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) <> (SELECT count(*) FROM labels)")]), ("space",))
def unplaced_gate(t):
    refs = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 9).alias("a"))
    return G.run([("unresolved", G.orphans(refs, "a", S.address_space(t.line_addresses), "addr")),
                  ("unplaced differs from review", G.equal_counts(t.lineitem.where("l_linenumber = 7"), t.labels))])


@query("qg07_empty_claims", _sql([("claimed but empty", "SELECT count(*) FROM (SELECT DISTINCT edition, book FROM units) u WHERE NOT EXISTS (SELECT 1 FROM texts t WHERE t.edition = u.edition AND t.book = u.book)")]), ("units", "texts"))
def empty_claims(t):
    claimed = t.units.select("edition", "book").distinct()
    return G.run([("claimed but empty", claimed.join(t.texts.select("edition", "book").distinct(), ["edition", "book"], "left_anti"))])


@query("qg08_omission_rules", _sql([("over 40", "SELECT count(*) FROM (SELECT edition FROM omissions GROUP BY 1 HAVING count(*) > 40)"), ("unexplained", "SELECT count(*) FROM omissions WHERE kind = 'unexplained'"),
                                    ("critical outside NT", "SELECT count(*) FROM omissions o JOIN books b ON b.book = o.book WHERE kind = 'critical-text' AND testament <> 'NT'")]), ("omissions", "books"))
def omission_rules(t):
    return G.run([("over 40", t.omissions.groupBy("edition").agg(F.count(F.lit(1)).alias("n")).where("n > 40")), ("unexplained", t.omissions.where("kind = 'unexplained'")),
                  ("critical outside NT", t.omissions.where("kind = 'critical-text'").join(t.books.where("testament <> 'NT'").select("book"), "book", "left_semi"))])


@query("qg09_scope_matches", _sql([("scope", "SELECT count(*) FROM (SELECT e.edition, e.scope, coalesce(bool_or(b.testament = 'OT'), false) AS ot, coalesce(bool_or(b.testament = 'NT'), false) AS nt FROM editions e LEFT JOIN texts t ON t.edition = e.edition LEFT JOIN books b ON b.book = t.book GROUP BY 1, 2) WHERE ot <> (scope <> 'NT') OR nt <> (scope <> 'OT')")]), ("editions", "texts", "books"))
def scope_matches(t):
    printed = t.texts.select("edition", "book").distinct().join(t.books.select("book", "testament"), "book")
    m = printed.groupBy("edition").agg(F.max(F.col("testament") == "OT").alias("ot"), F.max(F.col("testament") == "NT").alias("nt"))
    j = t.editions.join(m, "edition", "left").fillna(False, ["ot", "nt"])
    return G.run([("scope", G.broken(j, (F.col("ot") == (F.col("scope") != "NT")) & (F.col("nt") == (F.col("scope") != "OT"))))])


@query("qg10_gap_gate", """WITH printed AS (SELECT DISTINCT t.edition, t.book FROM texts t JOIN editions e ON e.edition = t.edition JOIN books b ON b.book = t.book WHERE b.testament = 'DC' OR e.scope = 'all' OR e.scope = b.testament),
    have AS (SELECT edition, addr FROM texts UNION SELECT edition, addr FROM omissions)
    SELECT 'unexplained gaps' AS gate, count(*) AS violations FROM printed p JOIN canon c ON c.book = p.book ANTI JOIN have h ON h.edition = p.edition AND h.addr = c.addr""", ("texts", "omissions", "editions", "books", "canon"))
def gap_gate(t):
    return G.run([("unexplained gaps", C.unexplained_gaps(t.canon, t.texts, t.omissions, t.editions, t.books))])


@query("qg11_printed_within_space", _sql([("printed more than space", "SELECT count(*) FROM (SELECT edition, count(*) AS n FROM texts GROUP BY 1) WHERE n > (SELECT count(*) FROM canon)"), ("edition without text", "SELECT count(*) FROM editions WHERE edition NOT IN (SELECT edition FROM texts)"),
                                          ("address printed by nobody", "SELECT count(*) FROM canon WHERE addr NOT IN (SELECT addr FROM texts)")]), ("texts", "canon", "editions"))
def printed_within_space(t):
    n = t.texts.groupBy("edition").agg(F.count(F.lit(1)).alias("n")).withColumn("_s", S.row_total(t.canon))
    return G.run([("printed more than space", n.where("n > _s")), ("edition without text", G.orphans(t.editions, "edition", t.texts, "edition")), ("address printed by nobody", G.orphans(t.canon, "addr", t.texts, "addr"))])


@query("qg12_index_rows", "SELECT 'index rows' AS gate, CAST(count(*) AS BIGINT) AS violations FROM texts WHERE NOT regexp_matches(text, '[\\p{L}\\p{N}]')", ("texts",))
def index_rows(t):
    from ..operators import search as Se
    indexed = Se.index(t.texts, ["edition", "addr"]).select("edition", "addr").distinct()
    return G.run([("index rows", t.texts.join(indexed, ["edition", "addr"], "left_anti"))])


def _heat_gate(where):
    return f"""SELECT count(*) FROM heat h FULL JOIN (SELECT addr, count(*) AS n, CAST(sum(greatest(votes, 1)) AS BIGINT) AS w FROM edge_hits WHERE {where} GROUP BY addr) r
        ON r.addr = h.addr WHERE h.inbound_count IS DISTINCT FROM r.n OR h.weighted_score IS DISTINCT FROM r.w"""


@query("qg13_heat_two_ways", _sql([("heat recomputation", _heat_gate("true")), ("without weak links", _heat_gate("votes > -4"))]), ("heat", "edge_hits"))
def heat_two_ways(t):
    """The second gate recomputes from fewer links, so it must find violations."""
    values, heat = ["inbound_count", "weighted_score"], L.heat(t.edges, t.space)
    return G.run([("heat recomputation", G.differs(heat, L.heat_recomputed(t.edges, t.space), ["addr"], values)),
                  ("without weak links", G.differs(heat, L.heat_recomputed(t.edges.where("votes > -4"), t.space), ["addr"], values))])


@query("qg14_scheme_function", _sql([("not a function", "SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"), ("target not real", "SELECT count(*) FROM links WHERE \"end\" NOT IN (SELECT addr FROM space)"), ("bad type", "SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('R', 'A')")]), ("links", "space"))
def scheme_function(t):
    return G.run([("not a function", G.repeated(t.lineitem, ["l_orderkey", "l_linenumber"])), ("target not real", G.orphans(t.links, "end", S.address_space(t.line_addresses), "addr")), ("bad type", G.not_in(t.lineitem, "l_returnflag", ["R", "A"]))])


@query("qg15_review_sets", _sql([("unused map rows", "SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)"), ("sets differ", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE n_chars > 1500 EXCEPT SELECT doc_id FROM labels)) + (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1500))")]))
def review_sets(t):
    return G.run([("unused map rows", G.orphans(t.supplier, "s_suppkey", t.lineitem.where("l_quantity > 45"), "l_suppkey")), ("sets differ", C.two_way_difference(t.documents.where("n_chars > 1500"), t.labels, ["doc_id"]))])


@query("qg16_resolution", "SELECT 'unresolved references' AS gate, count(*) AS violations FROM lineitem WHERE l_suppkey % 9 = 0 OR l_orderkey * 1000 + l_partkey % 8 NOT IN (SELECT addr FROM space)", ("space",))
def resolution(t):
    from .source_queries import document_refs
    return G.run([("unresolved references", document_refs(t).where("ref_error <> ''"))])


@query("qg17_language_place", "SELECT 'language' AS gate, count(*) AS violations FROM words WHERE language = 'fr' AND doc_id % 2 = 0", ("words",))
def language_place(t):
    return G.run([("language", G.broken(t.words, (F.col("language") != "fr") | (F.col("doc_id") % 2 != 0)))])


@query("qg18_gapless_positions", _sql([("word positions", "SELECT count(*) FROM (SELECT addr FROM words GROUP BY 1 HAVING min(position) <> 1 OR max(position) <> count(*) OR count(DISTINCT position) <> count(*))"), ("line numbers", "SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*))")]), ("words",))
def gapless_positions(t):
    return G.run([("word positions", C.broken_sequences(t.words, ["addr"], "position")), ("line numbers", C.broken_sequences(t.lineitem, ["l_orderkey"], "l_linenumber"))])


def _tally_gate(separator):
    return f"""SELECT count(*) FROM (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) w
        FULL JOIN (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{separator}'), lambda x: x <> '')) AS n FROM documents) d ON d.doc_id = w.doc_id WHERE coalesce(w.n, 0) <> coalesce(d.n, 0)"""


@query("qg19_independent_tally", _sql([("word count", _tally_gate("[^\\p{L}\\p{N}]+")), ("word count by spaces", _tally_gate("[ \n]+"))]), ("words",))
def independent_tally(t):
    """Running words against a tally made without the word table; one by spaces alone must find violations."""
    mine = t.words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

    def tally(separator):
        pieces = F.filter(F.split("text", separator), lambda w: w != "")
        return t.documents.select("doc_id", F.size(pieces).cast("bigint").alias("n")).where("n > 0")
    return G.run([("word count", G.differs(mine, tally(r"[^\p{L}\p{N}]+"), ["doc_id"], ["n"])), ("word count by spaces", G.differs(mine, tally("[ \n]+"), ["doc_id"], ["n"]))])


@query("qg20_minimum_sizes", _sql([("words", "SELECT count(*) < 100 FROM words"), ("dictionary", "SELECT count(*) < 1000000 FROM lexicon")]), ("words", "lexicon"))
def minimum_sizes(t):
    big = 10**18
    return G.run([("words", G.count_band(t.words, 100, big)), ("dictionary", G.count_band(t.lexicon, 1_000_000, big))])


@query("qg21_fold_residue", _sql([("residue", f"SELECT count(*) FROM words WHERE search_form <> lower(search_form) OR regexp_matches(search_form, '[{T.COMBINING}{T.HEBREW_POINTS}]')"), ("probe misses", "SELECT count(*) FROM lexicon WHERE headword NOT IN (SELECT search_form FROM words)")]), ("lexicon", "words"))
def fold_residue(t):
    residue = t.words.where(F.col("search_form").rlike(f"[{T.COMBINING}{T.HEBREW_POINTS}]") | (F.col("search_form") != F.lower("search_form")))
    return G.run([("residue", residue), ("probe misses", G.orphans(t.lexicon, "headword", t.words, "search_form"))])


def _coverage_gate(name, floor, lexicon="lexicon"):
    return f"""SELECT '{name}' AS gate, CAST(100.0 * (SELECT count(*) FROM words WHERE search_form IN (SELECT headword FROM {lexicon})) / (SELECT count(*) FROM words) < {floor} AS BIGINT) AS violations"""


@query("qg22_dictionary_coverage", _coverage_gate("token coverage", 99.9), ("words", "lexicon"))
def coverage_gate(t):
    return G.run([("token coverage", Wd.dictionary_coverage(t.words, t.lexicon).where("token_pct < 99.9"))])


@query("qg23_second_dictionary", _coverage_gate("token coverage", 98, "lexicon2"), ("words", "lexicon2"))
def second_dictionary(t):
    return G.run([("token coverage", Wd.dictionary_coverage(t.words, t.lexicon2).where("token_pct < 98"))])


@query("qg24_heat_band", _sql([("heat rows", "SELECT count(*) NOT BETWEEN 1000000 AND 2000000000 FROM heat")]), ("heat",))
def heat_band(t):
    return G.run([("heat rows", G.count_band(L.heat(t.edges, t.space), 1_000_000, 2_000_000_000))])


@query("qg25_text_artifacts", _sql([("welded punctuation", r"SELECT count(*) FROM texts WHERE regexp_matches(text, '[a-z][.,;:!?][A-Za-z]')")]), ("texts",))
def artifact_gate(t):
    vocabulary = t.conversations.select(F.explode(T.tokens("text")).alias("word"))
    found = Pl.text_artifacts(t.texts, ["edition", "addr"], vocabulary)
    return G.run([("welded punctuation", found.where("kind = 'welded-punctuation'"))])


@query("qg26_entity_rules", _sql([("year zero", "SELECT count(*) FROM positions WHERE earliest = 0 OR latest = 0"), ("years reversed", "SELECT count(*) FROM positions WHERE earliest > latest"), ("uncited", "SELECT count(*) FROM timeline_events WHERE event_id NOT IN (SELECT event_id FROM positions)"),
                                  ("status", "SELECT count(*) FROM timeline_events WHERE status NOT IN ('draft', 'claims-checked')"), ("documents", "SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0")]), ("positions", "timeline_events"))
def entity_rules(t):
    from .source_queries import entity_problems
    return G.run([("year zero", G.broken(t.positions, (F.col("earliest") != 0) & (F.col("latest") != 0))), ("years reversed", t.positions.where("earliest > latest")),
                  ("uncited", G.orphans(t.timeline_events, "event_id", t.positions, "event_id")), ("status", G.not_in(t.timeline_events, "status", ["draft", "claims-checked"])),
                  ("documents", entity_problems(t))])


@query("qg27_composition_rules", _sql([("only composition positions", "SELECT count(*) FROM (SELECT p.event_id FROM positions p JOIN timeline_events e ON e.event_id = p.event_id WHERE e.axis <> 'composition' GROUP BY 1 HAVING bool_and(dates = 'composition'))"),
                                       ("only traditional positions", "SELECT count(*) FROM (SELECT event_id FROM positions GROUP BY 1 HAVING bool_and(tradition = 'traditional'))")]), ("positions", "timeline_events"))
def composition_rules(t):
    other = t.positions.join(t.timeline_events.where("axis <> 'composition'").select("event_id"), "event_id", "left_semi")
    return G.run([("only composition positions", other.groupBy("event_id").agg(F.min(F.col("dates") == "composition").alias("x")).where("x")),
                  ("only traditional positions", t.positions.groupBy("event_id").agg(F.min(F.col("tradition") == "traditional").alias("x")).where("x"))])


@query("qg28_cross_references", _sql([("unknown source", "SELECT count(*) FROM positions WHERE source_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)"), ("never cited", "SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")]), ("positions",))
def cross_references(t):
    return G.run([("unknown source", G.orphans(t.positions, "source_id", t.supplier.where("s_nationkey < 20"), "s_suppkey")), ("never cited", G.orphans(t.part, "p_partkey", t.lineitem.where("l_quantity > 48"), "l_partkey"))])


@query("qg29_excerpts_and_checks", _sql([("excerpt over 24 words", "SELECT count(*) FROM benchmark WHERE len(string_split_regex(trim(text), '\\s+')) > 24"), ("axis enum", "SELECT count(*) FROM timeline_events WHERE axis NOT IN ('narrative', 'canon')"), ("foreign key", "SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)")]), ("timeline_events",))
def excerpts_and_checks(t):
    return G.run([("excerpt over 24 words", t.benchmark.where(F.size(F.split(F.trim("text"), r"\s+")) > 24)), ("axis enum", G.not_in(t.timeline_events, "axis", ["narrative", "canon"])),
                  ("foreign key", G.orphans(t.customer, "c_nationkey", t.nation.where("n_regionkey <> 0"), "n_nationkey"))])


@query("qg30_published_urls", f"""WITH {_URLS}, e AS (SELECT DISTINCT edition, unnest(['/read/' || addr // 1000000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000, '/read/' || addr // 1000000 || '.' || (addr // 1000) % 1000 || '.' || addr % 1000]) AS url FROM texts), a AS (SELECT edition, url FROM ur)
    SELECT 'urls' AS gate, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM a)) + (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM e)) AS violations""", ("texts", "omissions"))
def published_urls(t):
    return G.run([("urls", url_coverage(t))])


@query("qg31_work_rules", _sql([("dated xor undated", "SELECT count(*) FROM (SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size HAVING (count(l_partkey) > 0) = (p_size % 2 = 0))"),
                                ("traditional leads", "SELECT count(*) FROM (SELECT event_id FROM positions GROUP BY 1 HAVING min(ordinal) FILTER (tradition = 'traditional') < max(ordinal) FILTER (tradition <> 'traditional'))"),
                                ("event linked twice", "SELECT count(*) FROM (SELECT l_partkey, l_orderkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")]), ("positions",))
def work_rules(t):
    used = t.part.join(t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")), "p_partkey", "left").fillna(0, ["n"])
    lead = t.positions.groupBy("event_id").agg(F.min(F.when(F.col("tradition") == "traditional", F.col("ordinal"))).alias("a"), F.max(F.when(F.col("tradition") != "traditional", F.col("ordinal"))).alias("b"))
    return G.run([("dated xor undated", G.broken(used, (F.col("n") > 0) != (F.col("p_size") % 2 == 0))), ("traditional leads", lead.where("a < b")), ("event linked twice", G.repeated(t.lineitem, ["l_partkey", "l_orderkey"]))])


@query("qg32_study_content", _sql([("mirrored pairs", "SELECT count(*) FROM (SELECT a.conv_id, a.turn, a.role AS r, b.role AS m FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.n - 1 - a.turn) WHERE r <> m"),
                                   ("dates unique", "SELECT count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1)")]))
def study_content(t):
    """Mirrored units pair up at n + 1 - position; schedule dates are unique per series."""
    n = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    a = t.conversations.join(n, "conv_id").select("conv_id", (F.col("n") - 1 - F.col("turn")).alias("turn"), F.col("role").alias("r"))
    pairs = a.join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return G.run([("mirrored pairs", pairs.where("r <> role")), ("dates unique", G.repeated(t.orders, ["o_custkey", "o_orderdate"]))])
