"""Editions: parallel texts, coverage, omissions, gaps, censuses, set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C, passages as P, space as S
from .registry import query


@query("jn01_text_with_heat", """
    SELECT t.edition, t.addr, length(t.text) AS n_chars, coalesce(h.n, 0) AS heat FROM texts t
    LEFT JOIN (SELECT addr, count(*) AS n FROM omissions GROUP BY addr) h ON h.addr = t.addr""", ("texts", "omissions"))
def text_with_heat(t):
    heat = t.omissions.groupBy("addr").agg(F.count(F.lit(1)).alias("heat"))
    return (t.texts.join(heat, "addr", "left")
            .select("edition", "addr", F.length("text").cast("bigint").alias("n_chars"), F.coalesce("heat", F.lit(0).cast("bigint")).alias("heat")))


@query("jn02_parallel_editions", """
    SELECT addr, max(CASE WHEN edition = 'src0' THEN text END) AS src0, max(CASE WHEN edition = 'src1' THEN text END) AS src1,
           max(CASE WHEN edition = 'src2' THEN text END) AS src2
    FROM texts WHERE edition IN ('src0', 'src1', 'src2') GROUP BY addr""", ("texts",))
def parallel_editions(t):
    wanted = ["src0", "src1", "src2"]
    return t.texts.where(F.col("edition").isin(wanted)).groupBy("addr").pivot("edition", wanted).agg(F.max("text"))


@query("jn09_coverage_matrix", """
    SELECT e.edition, b.book, CASE WHEN p.edition IS NULL THEN 'out_of_scope' ELSE 'printed' END AS status
    FROM editions e CROSS JOIN books b LEFT JOIN (SELECT DISTINCT edition, book FROM texts) p ON p.edition = e.edition AND p.book = b.book""",
       ("editions", "books", "texts"))
def coverage_matrix(t):
    return C.coverage_matrix(t.texts, t.editions, t.books)


@query("jn10_unexplained_gaps", """
    WITH printed AS (SELECT DISTINCT t.edition, t.book FROM texts t JOIN editions e ON e.edition = t.edition JOIN books b ON b.book = t.book
                     WHERE b.testament = 'DC' OR e.scope = 'all' OR e.scope = b.testament),
    have AS (SELECT edition, addr FROM texts UNION SELECT edition, addr FROM omissions)
    SELECT p.edition, c.book, c.addr FROM printed p JOIN canon c ON c.book = p.book
    ANTI JOIN have h ON h.edition = p.edition AND h.addr = c.addr""", ("texts", "omissions", "editions", "books", "canon"))
def unexplained_gaps(t):
    return C.unexplained_gaps(t.canon, t.texts, t.omissions, t.editions, t.books).select("edition", "book", "addr")


@query("jn23_omission_index", """
    WITH g AS (SELECT o.addr, o.kind, min(o.reason) AS reason,
                      list_aggregate(list_transform(list_sort(list(DISTINCT {'n': e.edition_no, 'e': o.edition})), lambda s: s.e), 'string_agg', ',') AS omitted_by
               FROM omissions o JOIN editions e ON e.edition = o.edition WHERE e.licensed GROUP BY o.addr, o.kind),
    p AS (SELECT t.addr, arg_min(t.edition, e.edition_no) AS printed_by FROM texts t JOIN editions e ON e.edition = t.edition WHERE e.licensed GROUP BY t.addr)
    SELECT g.addr, g.kind, g.omitted_by, g.reason, coalesce(p.printed_by, '') AS printed_by FROM g LEFT JOIN p ON p.addr = g.addr""",
       ("texts", "omissions", "editions"))
def omission_index(t):
    return C.omission_index(t.omissions, t.texts, t.editions).fillna("", ["printed_by"])


@query("jn24_editions_printing", """
    SELECT o.edition, o.addr, count(t.edition) AS n_others, coalesce(min(t.edition), '') AS first_other FROM omissions o
    LEFT JOIN (SELECT t.* FROM texts t JOIN editions e ON e.edition = t.edition AND e.licensed) t ON t.addr = o.addr AND t.edition <> o.edition
    GROUP BY o.edition, o.addr""", ("texts", "omissions", "editions"))
def editions_printing(t):
    licensed = t.texts.join(t.editions.where("licensed"), "edition", "left_semi").select(F.col("edition").alias("other"), "addr")
    j = t.omissions.select("edition", "addr").join(licensed, "addr", "left")
    other = F.when(F.col("other") != F.col("edition"), F.col("other"))
    return j.groupBy("edition", "addr").agg(F.count(other).alias("n_others"), F.coalesce(F.min(other), F.lit("")).alias("first_other"))


@query("jn26_item_stream", """
    WITH i AS (SELECT edition, addr, 'unit' AS item, text AS body FROM texts UNION ALL SELECT edition, addr, 'omission', kind FROM omissions)
    SELECT edition, addr, item, body, addr = min(addr) OVER (PARTITION BY edition, addr // 1000) AS heading FROM i""", ("texts", "omissions"))
def item_stream(t):
    """Printed units and omission notes in one address-ordered stream; a heading where the chapter changes."""
    items = (t.texts.select("edition", "addr", F.lit("unit").alias("item"), F.col("text").alias("body"))
             .unionByName(t.omissions.select("edition", "addr", F.lit("omission").alias("item"), F.col("kind").alias("body"))))
    chapter = F.expr("addr div 1000").alias("_ch")
    heads = items.groupBy("edition", chapter).agg(F.min("addr").alias("_first"))
    return (items.withColumn("_ch", F.expr("addr div 1000")).join(heads, ["edition", "_ch"])
            .select("edition", "addr", "item", "body", (F.col("addr") == F.col("_first")).alias("heading")))


@query("jn30_edition_choice", """
    WITH c AS (SELECT DISTINCT t.edition, t.book, e.edition_no FROM texts t JOIN editions e ON e.edition = t.edition)
    SELECT b.book, coalesce(max(CASE WHEN c.edition = 'src7' THEN c.edition END), arg_min(c.edition, c.edition_no)) AS left_edition,
           arg_min(c.edition, c.edition_no) FILTER (c.edition <> coalesce((SELECT max(x.edition) FROM c x WHERE x.book = b.book AND x.edition = 'src7'),
             (SELECT arg_min(x.edition, x.edition_no) FROM c x WHERE x.book = b.book))) AS right_edition
    FROM books b JOIN c ON c.book = b.book GROUP BY b.book""", ("texts", "editions", "books"))
def edition_choice(t):
    """The requested edition when it carries the collection, else the first carrier; and a second one beside it."""
    carriers = t.texts.select("edition", "book").distinct().join(t.editions.select("edition", "edition_no"), "edition")
    left = carriers.groupBy("book").agg(F.coalesce(F.max(F.when(F.col("edition") == "src7", F.col("edition"))),
                                                   F.min_by("edition", "edition_no")).alias("left_edition"))
    rest = carriers.join(left, "book").where(F.col("edition") != F.col("left_edition"))
    right = rest.groupBy("book").agg(F.min_by("edition", "edition_no").alias("right_edition"))
    return left.join(right, "book", "left")


@query("ag09_edition_census", """
    SELECT e.edition, (SELECT count(*) FROM texts t WHERE t.edition = e.edition) AS printed,
           (SELECT count(*) FROM omissions o WHERE o.edition = e.edition) AS omitted,
           (SELECT count(DISTINCT book) FROM texts t WHERE t.edition = e.edition) AS books FROM editions e""",
       ("texts", "omissions", "editions"))
def edition_census(t):
    return C.census(t.texts, t.omissions, t.editions)


@query("ag10_conditional_counts", """
    SELECT edition, count(CASE WHEN kind = 'critical-text' THEN 1 END) AS critical, count(CASE WHEN kind = 'versification' THEN 1 END) AS versification,
           count(CASE WHEN kind = 'unexplained' THEN 1 END) AS unexplained FROM omissions GROUP BY edition""", ("omissions",))
def conditional_counts(t):
    return t.omissions.groupBy("edition").agg(F.count_if(F.col("kind") == "critical-text").alias("critical"),
                                              F.count_if(F.col("kind") == "versification").alias("versification"),
                                              F.count_if(F.col("kind") == "unexplained").alias("unexplained"))


@query("ag11_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t):
    return C.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("ag12_broken_sequences", """
    SELECT l_orderkey, CAST(min(l_linenumber) AS BIGINT) AS lo, CAST(max(l_linenumber) AS BIGINT) AS hi, count(DISTINCT l_linenumber) AS n_distinct, count(*) AS n
    FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def broken_sequences(t):
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return C.broken_sequences(lines, ["l_orderkey"], "l_linenumber")


@query("ag13_declared_vs_actual", """
    SELECT c_custkey, c_custkey % 12 AS declared, count(DISTINCT o_orderkey) AS actual FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey HAVING c_custkey % 12 <> count(DISTINCT o_orderkey)""")
def declared_vs_actual(t):
    actual = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("actual"))
    return (t.customer.select("c_custkey", (F.col("c_custkey") % 12).alias("declared")).join(actual, "c_custkey", "left")
            .withColumn("actual", F.coalesce("actual", F.lit(0).cast("bigint"))).where("declared <> actual"))


@query("ag14_edition_lists", """
    SELECT addr, kind, list_aggregate(list_sort(list(DISTINCT edition)), 'string_agg', ',') AS editions FROM omissions GROUP BY addr, kind""", ("omissions",))
def edition_lists(t):
    return t.omissions.groupBy("addr", "kind").agg(F.array_join(F.array_sort(F.collect_set("edition")), ",").alias("editions"))


@query("ag17_canon_census", """
    SELECT e.edition, b.canon, count(DISTINCT b.book) AS books, count(t.addr) AS units FROM books b CROSS JOIN editions e
    LEFT JOIN texts t ON t.book = b.book AND t.edition = e.edition GROUP BY ALL""", ("books", "texts", "editions"))
def canon_census(t):
    """Collections without a unit are kept."""
    per_book = t.texts.groupBy("edition", "book").agg(F.count(F.lit(1)).alias("n"))
    return (C.grid(t.books, t.editions).join(per_book, ["edition", "book"], "left").groupBy("edition", "canon")
            .agg(F.countDistinct("book").alias("books"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("units")))


@query("ag33_omission_counts", "SELECT edition, kind, count(*) AS n FROM omissions GROUP BY edition, kind", ("omissions",))
def omission_counts(t):
    return t.omissions.groupBy("edition", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("ag35_assembled_addresses", """
    SELECT edition, addr, count(DISTINCT doc_id) AS n_sources, min(doc_id) AS first_source, max(doc_id) AS last_source
    FROM source_lines GROUP BY edition, addr HAVING count(DISTINCT doc_id) > 1""", ("source_lines",))
def assembled_addresses(t):
    return (t.source_lines.groupBy("edition", "addr").agg(F.countDistinct("doc_id").alias("n_sources"),
            F.min("doc_id").alias("first_source"), F.max("doc_id").alias("last_source")).where("n_sources > 1"))


@query("st02_available_addresses", "SELECT edition, addr FROM texts UNION SELECT edition, addr FROM omissions", ("texts", "omissions"))
def available_addresses(t):
    return C.available(t.texts, t.omissions)


@query("st04_two_way_difference", """
    SELECT doc_id, 'unexpected' AS side FROM (SELECT doc_id FROM documents WHERE n_chars > 1500 EXCEPT SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT doc_id, 'missing' FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1500)""")
def two_way_difference(t):
    return C.two_way_difference(t.documents.where("n_chars > 1500"), t.labels.where("quality = 1"), ["doc_id"])


@query("st07_any_content", """
    SELECT b.book, e.edition, EXISTS (SELECT 1 FROM (SELECT edition, book FROM texts UNION ALL SELECT edition, book FROM omissions) x
        WHERE x.edition = e.edition AND x.book = b.book) AS has_content
    FROM books b, editions e""", ("texts", "omissions", "books", "editions"))
def any_content(t):
    hits = t.texts.select("edition", "book").union(t.omissions.select("edition", "book")).distinct().withColumn("_hit", F.lit(True))
    return C.grid(t.books.select("book"), t.editions).join(hits, ["edition", "book"], "left").select("book", "edition", F.coalesce("_hit", F.lit(False)).alias("has_content"))


_SPACE_SQL = """
    WITH ref AS (SELECT DISTINCT addr FROM source_lines WHERE edition IN ('src0', 'src1')),
    ex AS (SELECT DISTINCT addr FROM source_lines WHERE edition IN ('src2', 'src3')),
    outside AS (SELECT DISTINCT s.addr FROM source_lines s JOIN books b ON b.book = s.addr // 1000000 WHERE b.canon NOT IN ('hebrew', 'nt')),
    ch AS (SELECT DISTINCT addr // 1000 AS ch FROM ref),
    good AS (SELECT addr FROM ex WHERE addr NOT IN (SELECT addr FROM ref) AND addr // 1000 IN (SELECT ch FROM ch))"""


def _space_parts(t):
    lines = t.source_lines
    ref = lines.where(F.col("edition").isin("src0", "src1"))
    extras = lines.where(F.col("edition").isin("src2", "src3"))
    outer_books = t.books.where(~F.col("canon").isin("hebrew", "nt")).select("book")
    outside = lines.withColumn("book", F.expr("addr div 1000000")).join(outer_books, "book", "left_semi")
    return C.build_space(ref, extras, outside)


@query("st08_space_construction", _SPACE_SQL + """
    SELECT addr FROM ref UNION SELECT addr FROM good UNION SELECT addr FROM outside""", ("source_lines", "books"))
def space_construction(t):
    return _space_parts(t)[0]


@query("st08_rejected_extras", _SPACE_SQL + """
    SELECT addr, CASE WHEN addr IN (SELECT addr FROM ref) THEN 'already present' ELSE 'no such chapter' END AS reason
    FROM ex WHERE addr NOT IN (SELECT addr FROM good)""", ("source_lines", "books"))
def rejected_extras(t):
    return _space_parts(t)[1]


_CLASS = """CASE WHEN b.testament = 'DC' THEN 'versification' WHEN c.addr % 1000 = 1 THEN 'critical-text'
    WHEN e.edition_no % 3 = 0 AND b.testament = 'OT' THEN 'versification' ELSE 'unexplained' END"""


@query("st09_fill_unwritten", f"""
    WITH printed AS (SELECT DISTINCT edition, book FROM texts), have AS (SELECT edition, addr FROM texts UNION SELECT edition, addr FROM omissions),
    gaps AS (SELECT p.edition, c.book, c.addr FROM printed p JOIN canon c ON c.book = p.book ANTI JOIN have h ON h.edition = p.edition AND h.addr = c.addr)
    SELECT c.edition, c.addr, {_CLASS} AS kind FROM gaps c JOIN books b ON b.book = c.book JOIN editions e ON e.edition = c.edition
    UNION ALL SELECT edition, addr, kind FROM omissions""", ("texts", "omissions", "editions", "books", "canon"))
def fill_unwritten(t):
    whole = t.editions.withColumn("scope", F.lit("all"))
    gaps = C.unexplained_gaps(t.canon, t.texts, t.omissions, whole, t.books)
    rows = gaps.join(t.books.select("book", "testament"), "book").join(t.editions.select("edition", "edition_no"), "edition")
    kind = C.classify_omission(F.col("testament"), F.expr("addr % 1000 = 1"),
                               F.when(F.col("edition_no") % 3 == 0, "greek").otherwise("org"))
    return (rows.select("edition", "addr", kind.alias("kind"))
            .unionByName(t.omissions.select("edition", "addr", "kind")))


@query("fn17_omission_kinds", f"""
    SELECT c.edition, c.addr, {_CLASS} AS kind FROM omissions c JOIN books b ON b.book = c.book JOIN editions e ON e.edition = c.edition""",
       ("omissions", "books", "editions"))
def omission_kinds(t):
    rows = t.omissions.select("edition", "addr", "book").join(t.books.select("book", "testament"), "book").join(t.editions, "edition")
    kind = C.classify_omission(F.col("testament"), F.expr("addr % 1000 = 1"),
                               F.when(F.col("edition_no") % 3 == 0, "greek").otherwise("org"))
    return rows.select("edition", "addr", kind.alias("kind"))


@query("wn08_first_wins", """
    SELECT * FROM (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nth FROM customer) WHERE nth > 1""")
def first_wins(t):
    return C.first_wins(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])[1]


@query("prj18_dimension_lists", """
    SELECT edition, edition_no, scope FROM editions WHERE licensed""", ("editions",))
def dimension_lists(t):
    return t.editions.where("licensed").select("edition", "edition_no", "scope")


@query("prj18_collections", "SELECT book, name, testament, canon FROM books", ("books",))
def collections(t):
    return t.books.select("book", "name", "testament", "canon")


@query("prj18_dictionaries", "SELECT 'first' AS dictionary, count(*) AS n_entries FROM lexicon UNION ALL SELECT 'second', count(*) FROM lexicon2", ("lexicon", "lexicon2"))
def dictionaries(t):
    def sized(name, entries):
        return entries.agg(F.count(F.lit(1)).alias("n_entries")).select(F.lit(name).alias("dictionary"), "n_entries")
    return sized("first", t.lexicon).unionByName(sized("second", t.lexicon2))


@query("prj18_original_texts", "SELECT DISTINCT e.edition, d.lang FROM editions e JOIN documents d ON d.source = e.edition WHERE e.licensed AND e.scope <> 'all'", ("editions",))
def original_texts(t):
    langs = t.documents.select(F.col("source").alias("edition"), "lang").distinct()
    return t.editions.where("licensed AND scope <> 'all'").join(langs, "edition").select("edition", "lang")


@query("prj18_edition_by_code", "SELECT s_suppkey AS req, e.edition, e.scope FROM supplier LEFT JOIN editions e ON e.edition = 'src' || s_suppkey % 30", ("editions",))
def edition_by_code(t):
    """Editions for a table of codes; unknown codes keep their row."""
    asked = t.supplier.select(F.col("s_suppkey").alias("req"), F.concat(F.lit("src"), (F.col("s_suppkey") % 30).cast("string")).alias("edition"))
    return asked.join(t.editions.select(F.col("edition").alias("_e"), "scope"), F.col("edition") == F.col("_e"), "left").select("req", F.col("_e").alias("edition"), "scope")


@query("jn28_cross_checks", """
    SELECT 'customer names unknown nation' AS problem, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)
    UNION ALL SELECT 'nation never cited by a supplier', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'order names unknown customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def cross_checks(t):
    def missing(a, b, cond, name):
        return a.join(b, cond, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    known = t.nation.where("n_regionkey < 4")
    return (missing(t.customer, known, F.col("c_nationkey") == F.col("n_nationkey"), "customer names unknown nation")
            .unionByName(missing(t.nation, t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "nation never cited by a supplier"))
            .unionByName(missing(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey"), "order names unknown customer")))


# Display order of the genres.
GENRES = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]


@query("ag26_nested_groups", """
    SELECT n.n_regionkey, c.c_mktsegment, coalesce(list_position(['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE'], c.c_mktsegment), 6) AS genre_rank,
           count(DISTINCT n.n_nationkey) AS n_books, list_aggregate(list_sort(list(DISTINCT n.n_name)), 'string_agg', ',') AS books
    FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2""")
def nested_groups(t):
    """Region -> segment -> nations, segments in their enumerated order."""
    pairs = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_mktsegment", "n_name").distinct()
    rank = F.array_position(F.array(*[F.lit(g) for g in GENRES]), F.col("c_mktsegment"))
    return (pairs.groupBy("n_regionkey", "c_mktsegment")
            .agg(F.count(F.lit(1)).alias("n_books"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("books"))
            .withColumn("genre_rank", F.when(rank == 0, len(GENRES) + 1).otherwise(rank).cast("int")))


@query("st01_union_distinct", """
    SELECT subject_id AS event_id FROM links WHERE subject_kind = 'event' UNION SELECT p.event_id FROM links l JOIN positions p ON p.event_id = l.subject_id WHERE l.subject_kind = 'argument'""", ("links", "positions"))
def union_distinct(t):
    direct = t.links.where("subject_kind = 'event'").select(F.col("subject_id").alias("event_id"))
    argued = (t.links.where("subject_kind = 'argument'").select(F.col("subject_id").alias("event_id")).distinct()
              .join(t.positions.select("event_id"), "event_id", "left_semi"))
    return direct.union(argued).distinct()


@query("st03_heterogeneous_links", """
    SELECT subject_kind, subject_id, start, "end", link_type FROM links UNION ALL SELECT 'edge', CAST(l_partkey AS BIGINT), l_orderkey * 1000, l_orderkey * 1000 + 999, NULL FROM lineitem""", ("links",))
def heterogeneous_links(t):
    wide = t.lineitem.select(F.lit("edge").alias("subject_kind"), F.col("l_partkey").alias("subject_id"),
                             (F.col("l_orderkey") * 1000).alias("start"), (F.col("l_orderkey") * 1000 + 999).alias("end"))
    return t.links.unionByName(wide, allowMissingColumns=True)
