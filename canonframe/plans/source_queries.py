"""Source layouts rebuilt from the given tables, parsed back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morphology as Mo, references as R, text as T
from ..operators import coverage as C, space as S
from ..session import spread
from ..sources import parsers as Ps, placement as Pl
from .registry import query


def s(c):
    return F.col(c).cast("string")


def _escape(c):
    return F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _per_conversation(t, entry):
    """One document per conversation from its turns, in order (a conversation is one small file)."""
    rows = t.conversations.select("conv_id", "turn", entry.alias("e"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]).alias("parts"))


@query("src01_nested_json", "SELECT conv_id AS book, CAST(1 AS BIGINT) AS chapter, turn AS unit, text FROM conversations")
def nested_json(t):
    verse = F.struct(F.lit(1).cast("bigint").alias("chapter"), F.col("turn").alias("verse"), F.col("text").alias("text"))
    docs = _per_conversation(t, verse).select(F.to_json(F.struct(F.array(F.struct(
        F.col("conv_id").alias("nr"), F.lit("n").alias("name"),
        F.array(F.struct(F.lit(1).cast("bigint").alias("chapter"), F.col("parts").alias("verses"))).alias("chapters"))).alias("books"))).alias("content"))
    return Ps.nested_json(docs)[0]


_SEGMENTS = "(SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE']) AS name, unnest([1, 2, 3, 4]) AS book_id)"


def _customer_lines(t):
    line = F.when(F.col("c_custkey") == 0, "Verse\tText").when(F.col("c_custkey") == 1, "a preamble without a tab").otherwise(
        F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 50 + 1).cast("string"), F.lit(":"), s("c_custkey"), F.lit("\t"), "c_name"))
    lines = t.customer.select(F.lit("f").alias("file"), F.col("c_custkey").alias("line_no"), line.alias("line"))
    order = F.array(*[F.lit(x) for x in ["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE"]])
    names = t.customer.select(F.col("c_mktsegment").alias("name")).distinct().withColumn("book_id", F.array_position(order, F.col("name"))).where("book_id > 0")
    return Ps.reference_lines(lines, names)


@query("src02_reference_lines", f"""SELECT 'f' AS file, c_custkey AS line_no, CAST(n.book_id AS BIGINT) AS book_id, c_custkey % 50 + 1 AS chapter, c_custkey AS unit, c_name AS text
    FROM customer JOIN {_SEGMENTS} n ON n.name = c_mktsegment WHERE c_custkey > 1""")
def reference_lines(t):
    return _customer_lines(t)[0]


@query("src02_unmapped_names", "SELECT 'f' AS file, c_custkey AS line_no, c_mktsegment AS name FROM customer WHERE c_custkey > 1 AND c_mktsegment = 'AUTOMOBILE'")
def unmapped_names(t):
    return _customer_lines(t)[1]


def _edge_lines(t):
    line = F.concat(F.lit("B."), s("l_orderkey"), F.lit("."), s("l_linenumber"), F.lit("\tB."), s("l_partkey"), F.lit(".1"),
                    F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("-B."), s("l_partkey"), F.lit(".2"))).otherwise(""), F.lit("\t"),
                    F.when(F.col("l_quantity") == 50, "many").otherwise((F.col("l_quantity").cast("bigint") - 5).cast("string")))
    return Ps.edge_lines(t.lineitem.select(F.lit("f").alias("file"), (F.col("l_orderkey") + 2).alias("line_no"), line.alias("line")))


@query("src03_edge_lines", """SELECT 'f' AS file, l_orderkey + 2 AS line_no, 'B.' || l_orderkey || '.' || l_linenumber AS from_ref, 'B.' || l_partkey || '.1' AS to_start_ref,
    'B.' || l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN '.2' ELSE '.1' END AS to_end_ref, CAST(l_quantity AS BIGINT) - 5 AS votes FROM lineitem WHERE l_quantity <> 50""")
def edge_lines(t):
    return _edge_lines(t)[0]


@query("src03_bad_votes", "SELECT 'f' AS file, l_orderkey + 2 AS line_no, 'many' AS votes_text FROM lineitem WHERE l_quantity = 50")
def bad_votes(t):
    return _edge_lines(t)[1]


def _markup_books(t):
    unit = F.concat(F.lit('<v id="'), s("turn"), F.lit('" bcv="C'), s("conv_id"), F.lit(".1."), s("turn"), F.lit('"/>'), _escape("text"),
                    F.lit('<f caller="+"><fr>1</fr><ft>said by '), "role", F.lit("</ft></f><x caller=\"-\"> </x>"), F.when(F.col("turn") % 2 == 0, "<ve/>").otherwise(""))
    docs = _per_conversation(t, unit)
    return docs.select(F.concat(F.lit("c"), s("conv_id")).alias("file"), F.concat(
        F.lit('<book id="C'), s("conv_id"), F.lit('"><h>Title</h><c id="1"/><s>head</s>'), F.when(F.col("conv_id") % 3 == 0, "an opening").otherwise(""),
        F.array_join("parts", ""), F.lit("</book>")).alias("content"))


@query("src04_milestone_units", "SELECT 'C' || conv_id AS book_code, turn AS seq, 'C' || conv_id || '.1.' || turn AS ref, text, 'ok' AS state FROM conversations")
def milestone_units(t):
    return Ps.milestone_units(_markup_books(t)).select("book_code", "seq", "ref", "text", F.coalesce("error", F.lit("ok")).alias("state"))


@query("src05_notes", "SELECT 'C' || conv_id || '.1.' || turn AS ref, 'footnote' AS kind, '+' AS caller, '1said by ' || role AS text FROM conversations")
def notes(t):
    u = Ps.milestone_units(_markup_books(t))
    return u.select("ref", F.explode(Ps.notes(F.col("raw"))).alias("n")).select("ref", "n.kind", "n.caller", "n.text")


@query("src06_prologues", "SELECT DISTINCT 'c' || conv_id AS file, 'C' || conv_id AS book_code, 'an opening' AS text FROM conversations WHERE conv_id % 3 = 0")
def prologues(t):
    return Ps.prologues(_markup_books(t))


def _word_docs(t):
    toks = t.benchmark.select("item_id", F.posexplode(T.tokens("text")).alias("p", "w"))
    w = F.concat(F.lit('<w lemma="b/'), s("p"), F.lit('" morph="'), F.when(F.col("p") % 3 == 0, "A").otherwise("H"), F.lit('Nc">'), "w", F.lit("</w> "))
    x = F.when(F.col("p") % 5 == 4, F.concat(F.lit('<note type="variant"><catchWord>c</catchWord><rdg>'), w, F.lit("</rdg></note>"))).otherwise(w)
    return (toks.select("item_id", "p", x.alias("x")).groupBy("item_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda e: e["x"]), "").alias("xml")))


_WORDS = """b AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS t FROM benchmark))"""


@query("src07_running_words", f"""WITH {_WORDS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) AS position, w AS surface, 'b/' || p AS lemma,
    CASE WHEN p % 3 = 0 THEN 'A' ELSE 'H' END || 'Nc' AS morph, CASE WHEN p % 3 = 0 THEN 'arc' ELSE 'hbo' END AS language FROM b WHERE p % 5 <> 4""")
def running_words(t):
    return Ps.word_markup(_word_docs(t), ["item_id"], "xml")[0]


@query("src07_marginal_words", f"WITH {_WORDS} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) AS position, w AS surface FROM b WHERE p % 5 = 4")
def marginal_words(t):
    return Ps.word_markup(_word_docs(t), ["item_id"], "xml")[1].select("item_id", "position", "surface")


@query("src08_reference_scan", "SELECT DISTINCT 'O.' || l_orderkey || '.' || l_linenumber AS ref FROM lineitem")
def reference_scan(t):
    docs = t.lineitem.select(F.concat(F.lit('<verse osisID="O.'), s("l_orderkey"), F.lit("."), s("l_linenumber"), F.lit('" x="y">')).alias("content"))
    return Ps.scan_references(docs)


def _fixed_lines(t):
    ref = F.concat(F.lpad((F.col("l_orderkey") % 27 + 1).cast("string"), 2, "0"), F.lpad((F.col("l_partkey") % 28 + 1).cast("string"), 2, "0"), F.lpad(s("l_linenumber"), 2, "0"))
    line = F.concat_ws(" ", ref, F.lit("N-"), F.lit("----NSF-"), F.concat(s("l_suppkey"), F.lit(",")), s("l_suppkey"),
                       F.when(F.col("l_quantity") != 13, F.concat(F.lit("Ä"), s("l_suppkey"))), s("l_partkey"))
    return Ps.fixed_field_words(t.lineitem.select(F.lit("f").alias("file"), "l_orderkey", line.alias("line")).withColumnRenamed("l_orderkey", "line_no"))


@query("src09_fixed_field_words", """SELECT 'f' AS file, l_orderkey AS line_no, l_orderkey % 27 + 1 AS book_no, l_partkey % 28 + 1 AS chapter, CAST(l_linenumber AS BIGINT) AS unit,
    'N- ----NSF-' AS morph, l_suppkey || ',' AS surface, 'Ä' || l_suppkey AS normalized, CAST(l_partkey AS VARCHAR) AS lemma, 'a' || l_suppkey AS search_form FROM lineitem WHERE l_quantity <> 13""")
def fixed_field_words(t):
    return _fixed_lines(t)[0]


@query("src09_malformed_lines", "SELECT l_orderkey AS line_no, count(*) AS n FROM lineitem WHERE l_quantity = 13 GROUP BY 1")
def malformed_lines(t):
    return _fixed_lines(t)[1].groupBy("line_no").agg(F.count(F.lit(1)).alias("n"))


@query("src10_edition_variants", """SELECT 'Bk.' || o_custkey || '.1' AS source_ref, o_orderkey AS position, 'w' || o_orderkey AS base_surface,
    CASE WHEN o_orderkey % 5 = 0 THEN 'alt' || o_orderkey ELSE '' END AS alternate_surface, CASE WHEN o_orderkey % 5 = 0 THEN 'TR+Byz' ELSE '' END AS alternate_editions
    FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 5 = 0""")
def edition_variants(t):
    full = "+".join(Ps.ALL_EDITIONS)
    line = F.concat(F.lit("Bk."), s("o_custkey"), F.lit(".1#"), s("o_orderkey"), F.lit("=N\tw"), s("o_orderkey"), F.lit(" (w)\t\t\t\t"),
                    F.when(F.col("o_custkey") % 3 == 0, "NA28+SBL").otherwise(full), F.lit("\t"),
                    F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("alt"), s("o_orderkey"), F.lit(" (x) other - word in: TR+Byz"))).otherwise(""), F.lit("\t"))
    v = Ps.edition_variants(t.orders.select(line.alias("line")))
    return v.select("source_ref", "position", "base_surface", "alternate_surface", "alternate_editions").fillna("")


@query("src11_witness_readings", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS reading_order, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey FROM lineitem)
    SELECT l_orderkey, reading_order, 'reading ' || l_partkey AS reading, 'P' || l_suppkey || ' B' AS witnesses, reading_order = 0 AS is_base FROM r WHERE n >= 2""")
def witness_readings(t):
    line = F.concat(F.lit("<b>reading</b> "), s("l_partkey"), F.lit(" ] P"), s("l_suppkey"), F.lit("  B"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("x")))),
                                                                         lambda e: e["x"]), "<br/>").alias("entry"))
    return Ps.witness_readings(docs, "l_orderkey", "entry")


@query("src13_dictionary_entries", """WITH e AS (SELECT p_brand AS file, lpad(CAST(p_size AS VARCHAR), 4, '0') AS digits, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_partkey) AS n FROM part)
    SELECT file, 'G' || digits || CASE WHEN n > 1 THEN '.' || n ELSE '' END AS entry_key, CAST(digits AS BIGINT) AS number, p_name AS headword, p_type AS gloss, 'part ' || p_partkey AS definition FROM e""")
def dictionary_entries(t):
    """Also SRC-12 and WN-07: dictionary markup flattened, reused numbers suffixed in document order."""
    e = F.concat(F.lit('<entry n="'), "p_name", F.lit(" | "), F.lpad(s("p_size"), 4, "0"), F.lit('"><orth>x</orth><def role="brief">'), "p_type",
                 F.lit('</def><def role="full">part\n  '), s("p_partkey"), F.lit("</def></entry>"))
    docs = t.part.groupBy(F.col("p_brand").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", e.alias("x")))), lambda r: r["x"]), "\n").alias("content"))
    return Ps.dictionary_entries(docs).select("file", "entry_key", "number", "headword", "gloss", "definition")


def _numbered_files(t):
    e = F.concat(F.lit('<entry id="H'), s("p_partkey"), F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "").otherwise("?"),
                 F.lit('"><w pos="n-m" pron="p" xlit="x'), s("p_size"), F.lit('" xml:lang="'), F.when(F.col("p_size") % 2 == 0, "arc").otherwise("heb"), F.lit('">'), "p_name",
                 F.lit('</w><source>from <w src="H1">other</w></source><meaning>so\n <def>'), "p_type", F.lit("</def>, and <def>more</def></meaning><usage>use.</usage></entry>"))
    return t.part.groupBy(F.col("p_brand").alias("file")).agg(F.concat_ws("\n", F.collect_list(e)).alias("content"))


@query("src12_numbered_entries", """SELECT p_brand AS file, 'H' || p_partkey || CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN '' ELSE '?' END AS entry_key, CASE WHEN p_size % 3 = 2 THEN -1 ELSE p_partkey END AS number,
    CASE WHEN p_size % 2 = 0 THEN 'arc' ELSE 'hbo' END AS language, p_name AS headword, 'x' || p_size AS xlit, p_type AS gloss, 'so ' || p_type || ', and more' AS meaning, 'from other' AS etymology,
    CASE WHEN p_size % 3 = 2 THEN 'unrecognised entry id' ELSE '' END AS error FROM part""")
def numbered_entries(t):
    d = Ps.numbered_entries(_numbered_files(t))
    return d.select("file", "entry_key", "number", "language", "headword", "xlit", "gloss", "meaning", "etymology", "error").fillna(-1, ["number"]).fillna("", ["error"])


@query("src12_index_entries", """SELECT p_brand AS file, 'H' || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'b' ELSE '' END AS entry_key, CASE WHEN p_size % 2 = 0 THEN 'arc' ELSE 'hbo' END AS language, p_name AS headword, p_type AS gloss, 't' || p_size AS twot
    FROM part WHERE p_partkey % 5 <> 0""")
def index_entries(t):
    e = F.concat(F.lit('<entry id="x"><w xlit="x">'), "p_name", F.lit("</w><pos>N</pos><def>"), "p_type", F.lit('</def><xref bdb="b" twot="t'), s("p_size"), F.lit('"'),
                 F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(' strong="'), s("p_partkey"), F.lit('"'))).otherwise(""), F.when(F.col("p_size") % 2 == 0, ' aug="b"').otherwise(""), F.lit("/></entry>"))
    side = F.col("p_size") % 2 == 0
    docs = t.part.groupBy(F.col("p_brand").alias("file")).agg(F.concat(
        F.lit('<part xml:lang="heb">'), F.concat_ws("", F.collect_list(F.when(~side, e))), F.lit('</part><part xml:lang="arc">'), F.concat_ws("", F.collect_list(F.when(side, e))), F.lit("</part>")).alias("content"))
    return Ps.index_entries(docs).select("file", "entry_key", "language", "headword", "gloss", "twot")


@query("wn07_suffixed_keys", """SELECT 'G' || lpad(CAST(p_size AS VARCHAR), 4, '0') || CASE WHEN row_number() OVER w > 1 THEN '.' || row_number() OVER w ELSE '' END AS entry_key, p_brand AS file FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_brand, p_partkey)""")
def suffixed_keys(t):
    return dictionary_entries(t).select("entry_key", "file")


def _tab_files(t):
    line = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# book: "), "role", F.lit("\n# a comment\n"))).otherwise(""),
                    F.when(F.col("turn") % 5 == 4, "a line without a tab").otherwise(F.concat(F.lit("u"), s("turn"), F.lit("\t"), F.regexp_replace("text", r"\s+", " "))))
    docs = _per_conversation(t, line).select(s("conv_id").alias("file"), F.array_join("parts", "\r\n").alias("content"))
    return Ps.tab_text(Ps.lines_of(docs))


_HEADER = "(SELECT arg_max(h.role, h.turn) FROM conversations h WHERE h.conv_id = c.conv_id AND h.turn <= c.turn AND h.turn % 3 = 0)"


@query("src14_tab_text", f"SELECT CAST(conv_id AS VARCHAR) AS file, {_HEADER} AS part, 'u' || turn AS ref, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations c WHERE turn % 5 <> 4")
def tab_text(t):
    return _tab_files(t)[0].select("file", "part", "ref", "text")


@query("src14_bad_lines", "SELECT CAST(conv_id AS VARCHAR) AS file, count(*) AS n FROM conversations WHERE turn % 5 = 4 GROUP BY 1")
def bad_lines(t):
    return _tab_files(t)[1].groupBy("file").agg(F.count(F.lit(1)).alias("n"))


_DECODE = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_WS = r"[\s\x{a0}\x{feff}]+"


@query("src15_html_units", rf"""WITH p AS (SELECT page_id, string_split(regexp_replace(array_to_string(regexp_extract_all(regexp_replace(html, '<br>', '<strong>' || (page_id % 7 + 1) || '</strong>', 'g'),
      '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), chr(1)), '<strong>\s*(\d+)\s*</strong>', chr(1) || chr(2) || '\1' || chr(1), 'g'), chr(1)) AS a FROM pages),
    x AS (SELECT page_id, unnest(a) AS piece, unnest(range(len(a))) AS i FROM p),
    y AS (SELECT page_id, i, CASE WHEN starts_with(piece, chr(2)) THEN CAST(substr(piece, 2) AS BIGINT) END AS mark,
                 trim(regexp_replace({_DECODE.format("regexp_replace(regexp_replace(piece, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')")}, '{_WS}', ' ', 'g')) AS text FROM x),
    z AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i), 0) AS page FROM y)
    SELECT page_id, page, row_number() OVER (PARTITION BY page_id, page ORDER BY i) AS ordinal, text FROM z WHERE mark IS NULL AND text <> ''""")
def html_units(t):
    marked = t.pages.select("page_id", F.regexp_replace(F.col("html"), F.lit("<br>"), F.concat(F.lit("<strong>"), (F.col("page_id") % 7 + 1).cast("string"), F.lit("</strong>"))).alias("html"))
    return Ps.html_units(marked, "page_id", "html")


def _entity_files(t):
    plain = F.struct(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.concat(F.lit("ev-"), s("o_orderkey"))).alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").alias("books"))
    extra = F.struct(F.concat(F.lit("ev-"), s("o_orderkey")).alias("id"), F.lit(1).alias("earliest_yr"))
    docs = t.orders.select(F.concat(F.lit("ev-"), s("o_orderkey"), F.lit(".json")).alias("file"),
                           F.when(F.col("o_orderkey") % 11 == 0, F.to_json(extra)).otherwise(F.to_json(plain)).alias("content"))
    return Ps.entity_documents(docs, "id string, title string, books bigint")


@query("src16_entity_documents", "SELECT 'ev-' || o_orderkey || '.json' AS file, 'ev-' || o_orderkey AS id, o_orderstatus AS title, o_custkey AS books FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0")
def entity_documents(t):
    return _entity_files(t)[0]


@query("src16_entity_problems", """SELECT 'ev-' || o_orderkey || '.json' AS file, CASE WHEN o_orderkey % 11 = 0 THEN 'unknown key earliest_yr' ELSE 'id is not the file name' END AS problem
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0""")
def entity_problems(t):
    return _entity_files(t)[1]


@query("src17_alignment_json", "SELECT event_type AS edition, event_id AS verse_id, value AS start, value + 1 AS \"end\", user_id % 10 / 10 AS score FROM events")
def alignment_json(t):
    verse = F.struct(F.col("event_id").alias("verse_id"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"), (F.col("user_id") % 10 / 10).alias("score"))
    docs = t.events.select(F.to_json(F.struct(F.col("event_type").alias("edition"), F.lit(1).alias("book_id"), F.lit(1).alias("chapter"), F.lit(0.5).alias("mean_score"), F.array(verse).alias("verses"))).alias("content"))
    return Ps.alignment_json(docs)[0].select("edition", "verse_id", "start", "end", "score")


@query("src18_chapter_files", """SELECT printf('%02d_%s_%d.mp3', p_size, p_brand, p_partkey) AS file, CAST(p_size AS BIGINT) AS book_id, p_partkey AS chapter FROM part WHERE p_partkey % 4 <> 0
    UNION ALL SELECT printf('%02d_%s.mp3', p_size, p_brand), CAST(p_size AS BIGINT), 1 FROM part WHERE p_partkey % 4 = 0""")
def chapter_files(t):
    name = F.concat(F.lpad(s("p_size"), 2, "0"), F.lit("_"), "p_brand", F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("_"), s("p_partkey"))).otherwise(""), F.lit(".mp3"))
    return Ps.chapter_files(t.part.select(name.alias("file")), r"^(\d+)_[^_]+?(?:_(\d+))?\.mp3$")


@query("src18_book_files", """WITH f AS (SELECT DISTINCT printf('%03d.mp3', p_size) AS file, CAST(p_size AS BIGINT) AS book_id FROM part), c AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS book_id, p_partkey % 9 AS chapter FROM part)
    SELECT file, f.book_id, chapter FROM f JOIN c ON c.book_id = f.book_id WHERE NOT (f.book_id % 2 = 0 AND chapter = 3)""")
def book_files(t):
    """One file per book: every chapter there is but the excluded ones."""
    listing = t.part.select(F.concat(F.lpad(s("p_size"), 3, "0"), F.lit(".mp3")).alias("file")).distinct()
    chapters = t.part.select(F.col("p_size").cast("bigint").alias("book_id"), (F.col("p_partkey") % 9).alias("chapter")).distinct()
    return Ps.book_files(listing, r"^(\d+)\.mp3$", chapters, chapters.where("book_id % 2 = 0 AND chapter = 3"))


@query("fn18_spoken_keys", """SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'weadonay' WHEN 1 THEN 'weelohim' ELSE 'wename' || l_suppkey END AS spoken FROM lineitem""")
def spoken_keys(t):
    key = F.concat(F.lit("H306"), (F.col("l_partkey") % 3 + 8).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise(""))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", T.spoken_key(F.concat(F.lit("we/name"), s("l_suppkey")), key).alias("spoken"))


@query("src18_titled_files", """WITH c AS (SELECT o_custkey % 30 AS a, o_orderkey AS seq, o_custkey % 4 AS w, o_custkey % 5 AS seg FROM orders),
    x AS (SELECT seq, seg, unnest(range(a + 1, a + 1 + w + 1)) AS chapter FROM c)
    SELECT CAST(seg + 1 AS BIGINT) AS book_id, chapter, 'f' || min(seq) AS file, count(*) AS n_claims FROM x GROUP BY 1, 2""")
def titled_files(t):
    a = F.col("o_custkey") % 30 + 1
    title = F.concat(F.lpad(s("o_orderkey"), 9, "0"), F.lit(" - Name"), (F.col("o_custkey") % 5).cast("string"), F.lit("x Ch. "), a.cast("string"),
                     F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit(" - "), (a + F.col("o_custkey") % 4).cast("string"))).otherwise(""))
    titles = t.orders.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("f"), s("o_orderkey")).alias("file"), title.alias("title"))
    names = t.orders.select((F.col("o_custkey") % 5).alias("_s")).distinct().select(F.concat(F.lit("name"), s("_s"), F.lit("x")).alias("name"), (F.col("_s") + 1).alias("book_id"))
    return Ps.titled_files(titles, names, t.orders.select(F.lit(0).cast("bigint").alias("book_id"), F.lit(0).cast("bigint").alias("chapter")).limit(0))


@query("src19_unit_texts", """SELECT 'f' || (addr // 1000) AS file, edition, addr, text FROM texts WHERE NOT (chapter % 2 = 0 AND unit BETWEEN 2 AND 4)""", ("texts",))
def unit_texts(t):
    chapters = t.canon.select(F.col("book").alias("book_id"), "chapter").distinct().withColumn("file", F.concat(F.lit("f"), (F.col("book_id") * 1000 + F.col("chapter")).cast("string")))
    ex = chapters.where("chapter % 2 = 0").select((F.col("book_id") * 1000000 + F.col("chapter") * 1000 + 2).alias("ex_start"), (F.col("book_id") * 1000000 + F.col("chapter") * 1000 + 4).alias("ex_end"))
    return Ps.unit_texts(chapters, t.texts.select("edition", "addr", "text"), ex)


@query("src20_manifest", "SELECT page_id, sha256(html) AS sha256, page_id % 2 = 0 AS pin_ok FROM pages")
def manifest(t):
    pins = t.pages.select("page_id", F.sha2(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.col("url")), 256).alias("sha256"))
    return Ps.manifest(t.pages, "page_id", F.col("html"), pins)


@query("src21_licence_evidence", "SELECT page_id, contains(html, '&copy;') AS holds FROM pages")
def licence_evidence(t):
    return Ps.licence_evidence(t.pages, "page_id", "html", t.pages.select("page_id", F.lit("&copy;").alias("phrase")))


# --- text functions ---------------------------------------------------------------------------------

@query("fn01_normalize_text", rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '(?s)/f\s*\+.*?/f\*', '', 'g'), '([a-z])([.,;:!?])([A-Za-z])', '\1\2 \3', 'g'), '{_WS}', ' ', 'g')) AS text FROM documents""")
def normalize_text(t):
    return t.scanned_documents.select("doc_id", T.normalize_unit("text").alias("text"))


@query("fn02_text_artifacts", r"""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations)),
    wd AS (SELECT edition, addr, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM texts),
    sus AS (SELECT DISTINCT lower(word) AS low FROM wd WHERE regexp_matches(word, '^[a-z]') AND length(word) >= 7 AND lower(word) NOT IN (SELECT w FROM v)),
    cuts AS (SELECT low, unnest(range(3, length(low) - 2)) AS cut FROM sus),
    fix AS (SELECT low, min(cut) AS cut FROM cuts WHERE substr(low, 1, cut) IN (SELECT w FROM v) AND substr(low, cut + 1) IN (SELECT w FROM v) GROUP BY low)
    SELECT edition, addr, 'welded-words' AS kind, word || ' -> ' || substr(fix.low, 1, cut) || ' ' || substr(fix.low, cut + 1) AS detail FROM wd JOIN fix ON fix.low = lower(word) WHERE regexp_matches(word, '^[a-z]') AND length(word) >= 7
    UNION ALL SELECT edition, addr, 'welded-punctuation', array_to_string(regexp_extract_all(text, '\S*[a-z][.,;:!?][A-Za-z]\S*'), ' ') FROM texts WHERE regexp_matches(text, '[a-z][.,;:!?][A-Za-z]')
    UNION ALL SELECT edition, addr, 'markup-residue', array_to_string(regexp_extract_all(text, '/f\s*\+|/f\*|\\[a-z]+\*?'), ' ') FROM texts WHERE regexp_matches(text, '/f\s*\+|/f\*|\\[a-z]+\*?')""", ("texts",))
def text_artifacts(t):
    vocabulary = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).select(F.lower("w").alias("word"))
    return Pl.text_artifacts(t.texts, ["edition", "addr"], vocabulary)


_REMOVED = ["b", "a", "i", "strong"]


def _welds_sql() -> str:
    """Spans of one tag after the other become a mark; marks between word characters count and go."""
    steps, mark, word = ["x0 AS (SELECT page_id, translate(html, chr(57344), ' ') AS t, 0 AS n FROM pages)"], "chr(57344)", r"[\p{L}\p{N}]"
    for tag in _REMOVED:
        for pattern in (rf"(?s)<{tag}\b(?:[^>]*[^/>])?>.*?</{tag}>", rf"<{tag}\b[^>]*/>"):
            last = f"x{len(steps) - 1}"
            steps.append(f"""x{len(steps)} AS MATERIALIZED (SELECT page_id, array_to_string(p, '') AS t, n + len(list_filter(range(1, len(p)), lambda i: regexp_matches(p[i], '{word}$') AND regexp_matches(p[i + 1], '^{word}'))) AS n
                FROM (SELECT page_id, n, string_split(regexp_replace(t, '{pattern}', {mark}, 'g'), {mark}) AS p FROM {last}))""")
    return ", ".join(steps) + f", welds AS (SELECT page_id, n AS n_sites FROM x{len(steps) - 1})"


WELDS = _welds_sql()


@query("fn03_weld_sites", f"WITH {WELDS} SELECT * FROM welds")
def weld_sites(t):
    return t.pages.select("page_id", Ps.weld_sites(F.col("html"), _REMOVED).alias("n_sites"))


@query("fn04_strip_markup", f"SELECT page_id, replace({_DECODE.format(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', '', ', ', 'g', ')']))}, '¶', ' ') AS text FROM pages")
def strip_markup(t):
    return t.pages.select("page_id", T.strip_markup("html").alias("text"))


@query("fn06_consonantal", "SELECT doc_id, addr, position, surface AS bare, surface || chr(1462) AS vowels FROM words", ("words",))
def consonantal(t):
    pointed = F.concat("surface", F.lit("֑"), F.lit("ֶ"), F.lit("/"))
    return t.words.select("doc_id", "addr", "position", T.consonantal(pointed).alias("bare"),
                          T.accent_fold(F.regexp_replace(pointed, "/", ""), F.lit("hbo")).alias("vowels"))


@query("fn18_spoken_text", "SELECT conv_id, turn, regexp_replace(lower(strip_accents(text)), '[^a-z'' ]+', ' ', 'g') AS spoken FROM conversations")
def spoken_text(t):
    return t.conversations.select("conv_id", "turn", T.spoken_english("text").alias("spoken"))


@query("fn19_tidy_and_ids", "SELECT c_custkey, trim(c_mktsegment) AS tidy, c_custkey % 2 = 0 AS id_ok FROM customer")
def tidy_and_ids(t):
    d = t.customer.select("c_custkey", Ps.tidy(F.array(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))))[0].alias("tidy"),
                          F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("id-"), s("c_custkey"))).otherwise("Id ?").alias("_id"))
    return d.select("c_custkey", "tidy", F.col("_id").rlike("^[a-z0-9][a-z0-9-]*$").alias("id_ok"))


@query("fn20_edition_sets", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 0 END AS n_missing, 'alt' || o_custkey AS alternate FROM orders")
def edition_sets(t):
    full = F.array(*[F.lit(e) for e in Ps.ALL_EDITIONS])
    text = F.when(F.col("o_custkey") % 3 == 0, "TR+ NA28+Tyn+SBL+WH+Treg").otherwise("+".join(reversed(Ps.ALL_EDITIONS)))
    alt = F.concat(F.lit(" alt"), s("o_custkey"), F.lit(" (alt) word - gloss in: TR"))
    return t.orders.select("o_orderkey", F.size(F.array_except(full, Ps.edition_set(text))).alias("n_missing"), Ps.alternate_reading(alt).alias("alternate"))


def _maps(names):
    return {n: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in getattr(Mo, n).items()) + "}" for n in names}


_M = _maps(["NOUN_TYPE", "GENDER", "NUMBER", "STATE", "HEBREW_STEM", "ARAMAIC_STEM", "ASPECT", "PERSON"])
_CODE = """SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, substr('cgp', CAST(l_partkey % 3 + 1 AS INT), 1) AS nt, substr('bcfm', CAST(l_suppkey % 4 + 1 AS INT), 1) AS g, substr('spd', CAST(l_orderkey % 3 + 1 AS INT), 1) AS nu,
    substr('acd?', CAST(l_partkey % 4 + 1 AS INT), 1) AS st, substr('qNpPhHt', CAST(l_linenumber AS INT), 1) AS stem, substr('pqiwhjvac', CAST(l_partkey % 9 + 1 AS INT), 1) AS asp, l_linestatus = 'F' AS arc FROM lineitem"""


@query("fn09_morphology", f"""SELECT k, n, s, concat_ws(' · ', 'noun', {_M['NOUN_TYPE']}[nt], {_M['GENDER']}[g], {_M['NUMBER']}[nu], {_M['STATE']}[st]) || '  +  ' ||
      CASE WHEN asp IN ('a', 'c') THEN concat_ws(' · ', 'verb', CASE WHEN arc THEN {_M['ARAMAIC_STEM']}[stem] ELSE {_M['HEBREW_STEM']}[stem] END, {_M['ASPECT']}[asp])
      ELSE concat_ws(' · ', 'verb', CASE WHEN arc THEN {_M['ARAMAIC_STEM']}[stem] ELSE {_M['HEBREW_STEM']}[stem] END, {_M['ASPECT']}[asp], '3rd person', {_M['GENDER']}[g], {_M['NUMBER']}[nu]) END AS label FROM ({_CODE})""")
def morphology(t):
    def pick(letters, at):
        return F.substring(F.lit(letters), at.cast("int") + 1, F.lit(1))
    g, nu = pick("bcfm", F.col("l_suppkey") % 4), pick("spd", F.col("l_orderkey") % 3)
    code = F.concat(F.when(F.col("l_linestatus") == "F", "A").otherwise("H"), F.lit("N"), pick("cgp", F.col("l_partkey") % 3), g, nu, pick("acd?", F.col("l_partkey") % 4),
                    F.lit("/V"), pick("qNpPhHt", F.col("l_linenumber") - 1), pick("pqiwhjvac", F.col("l_partkey") % 9), F.lit("3"), g, nu)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), Mo.label(code, F.lit("hbo")).alias("label"))


# --- references -----------------------------------------------------------------------------------------

def _book_table(t):
    """Collections named by the part names, numbered in name order; every eighth has a single chapter."""
    from pyspark.sql import Window as W
    names = t.part.select("p_name").distinct()
    no = F.row_number().over(W.orderBy("p_name")).cast("bigint")     # the names are a fixed vocabulary of 64
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    d = names.select("p_name", no.alias("book_id"), camel.alias("osis_id"))
    return d.select("book_id", "osis_id", F.initcap("p_name").alias("name"), F.regexp_replace(F.initcap("p_name"), r"(\w{2})\w* (\w{2})\w*", "$1 $2").alias("abbreviation"),
                    F.when(F.col("book_id") % 8 == 0, 1).otherwise(40).cast("bigint").alias("chapter_count"), F.lit(None).cast("bigint").alias("last_chapter"),
                    (F.col("book_id") % 5 == 0).alias("has_prologue"), F.lit("chapter-verse").alias("numbering"))


_BOOKS = """bk AS MATERIALIZED (SELECT p_name, b, CASE WHEN b % 8 = 0 THEN 1 ELSE 40 END AS cc, b % 5 = 0 AS pro FROM (SELECT p_name, row_number() OVER (ORDER BY p_name) AS b FROM (SELECT DISTINCT p_name FROM part)))"""
# Seven spellings by line number; chapters run past the last one (40) so that errors occur.
_REFS = f"""{_BOOKS}, q AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_quantity::BIGINT AS c, l_partkey % 30 + 1 AS v, l_linenumber % 7 AS form, b, cc, pro, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN bk ON bk.p_name = part.p_name),
    r AS (SELECT *, CASE WHEN cc = 1 AND form = 1 AND c > 1 THEN 'single' WHEN form = 0 THEN 'book' WHEN c > cc THEN 'bad' WHEN form = 1 THEN 'chapter' ELSE 'unit' END AS kind FROM q),
    z AS (SELECT *, b * 1000000 + CASE WHEN kind = 'single' THEN 1000 + c WHEN kind = 'book' THEN CASE WHEN pro THEN 1000 ELSE 1001 END WHEN kind = 'chapter' THEN c * 1000 + 1 ELSE c * 1000 + v END AS s0 FROM r)"""


def _reference_strings(t):
    q = F.col("l_quantity").cast("bigint").cast("string")
    v = (F.col("l_partkey") % 30 + 1)
    vs = v.cast("string")
    name = F.col("p_name")
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    form = F.col("l_linenumber") % 7
    raw = (F.when(form == 0, F.upper(name)).when(form == 1, F.concat(name, F.lit(" "), q)).when(form == 2, F.concat(F.lit(" "), name, F.lit(". "), q, F.lit(" : "), vs))
           .when(form == 3, F.concat_ws(".", camel, q, vs)).when(form == 4, F.concat(name, F.lit(" "), q, F.lit(":"), vs, F.lit("-"), (v + 2).cast("string")))
           .when(form == 5, F.concat(name, F.lit(" "), q, F.lit(":"), vs, F.lit("–"), F.lit("40:2"))).otherwise(F.concat(name, F.lit(" "), q, F.lit(":"), vs, F.lit(" - "), name, F.lit(" "), q, F.lit(":"), (v + 1).cast("string"))))
    lines = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"))
    return lines.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), raw.alias("raw"))


_PARSED = """CASE WHEN kind = 'bad' OR (form = 5 AND cc = 1) THEN -1 WHEN form = 5 THEN least(s0, b * 1000000 + 40002) ELSE s0 END AS ref_start,
    CASE WHEN kind = 'bad' OR (form = 5 AND cc = 1) THEN -1 WHEN kind = 'book' THEN b * 1000000 + 999999 WHEN kind = 'chapter' THEN b * 1000000 + c * 1000 + 999
         WHEN form = 4 THEN s0 + 2 WHEN form = 5 THEN greatest(s0, b * 1000000 + 40002) WHEN form = 6 THEN s0 + 1 ELSE s0 END AS ref_end,
    CASE WHEN kind = 'bad' OR (form = 5 AND cc = 1) THEN 'chapter-range' ELSE '' END AS ref_error"""


@query("fn10_reference_parsing", f"WITH {_REFS} SELECT k, n, s, {_PARSED} FROM z")
def reference_parsing(t):
    d = R.parse_references(_reference_strings(t), "raw", _book_table(t))
    return d.select("k", "n", "s", "ref_start", "ref_end", "ref_error").fillna(-1, ["ref_start", "ref_end"]).fillna("", ["ref_error"])


@query("tx08_query_classification", f"WITH {_REFS}, p AS (SELECT {_PARSED} FROM z) SELECT CASE WHEN ref_error = '' THEN 'reference' ELSE 'text' END AS mode, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'text: item', count(*) FROM benchmark")
def query_classification(t):
    refs = R.parse_references(_reference_strings(t), "raw", _book_table(t)).select(F.when(F.col("ref_error").isNull(), "reference").otherwise("text").alias("mode"))
    free = R.parse_references(t.benchmark.select("text"), "text", _book_table(t)).select(F.when(F.col("ref_error").isNull(), "reference: item").otherwise("text: item").alias("mode"))
    return refs.unionByName(free).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("fn11_reference_lists", f"""WITH {_BOOKS}, q AS (SELECT p_partkey, b, cc, pro, p_size AS c FROM part JOIN bk ON bk.p_name = part.p_name)
    SELECT p_partkey, CAST(i AS BIGINT) AS item, CASE WHEN c > cc AND i = 0 THEN -1 WHEN c > cc AND i < 3 THEN -1 WHEN i = 3 THEN b * 1000000 + CASE WHEN pro THEN 1000 ELSE 1001 END ELSE b * 1000000 + c * 1000 + v END AS ref_start,
           CASE WHEN c > cc AND i < 3 THEN -1 WHEN i = 3 THEN b * 1000000 + 999999 ELSE b * 1000000 + c * 1000 + w END AS ref_end
    FROM q, (SELECT unnest([0, 1, 2, 3]) AS i, unnest([16, 18, 20, 0]) AS v, unnest([16, 18, 22, 0]) AS w)""")
def reference_lists(t):
    text = F.concat("p_name", F.lit(" "), s("p_size"), F.lit(":16, 18,20-22; "), "p_name")
    d = R.parse_reference_lists(t.part.select("p_partkey", text.alias("refs")), "p_partkey", "refs", _book_table(t))
    return d.select("p_partkey", "item", "ref_start", "ref_end").fillna(-1, ["ref_start", "ref_end"])


@query("fn12_book_names", f"WITH {_BOOKS} SELECT p_partkey, b AS book_id FROM part JOIN bk ON bk.p_name = part.p_name")
def book_names(t):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.regexp_replace(F.initcap("p_name"), r"(\w{2})\w* (\w{2})\w*", "$1. $2."))
    aliases = R.alias_table(_book_table(t)).select("key", "book_id")
    unique = aliases.groupBy("key").agg(F.max("book_id").alias("book_id"))
    return t.part.select("p_partkey", R.book_key(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.initcap("p_name"))).alias("key")).join(unique, "key").select("p_partkey", "book_id")


@query("fn13_range_formatting", f"""WITH {_REFS}, p AS (SELECT k, n, s, c, v, form, kind, b, cc, pro, s0, {_PARSED} FROM z),
    m AS (SELECT p.*, bk.p_name, array_to_string(list_transform(string_split(bk.p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nm FROM p JOIN bk ON bk.b = p.b WHERE ref_error = ''),
    d AS (SELECT *, (ref_start // 1000) % 1000 AS sc, ref_start % 1000 AS sv, (ref_end // 1000) % 1000 AS ec, ref_end % 1000 AS ev, replace(nm, ' ', '') AS os FROM m)
    SELECT k, n, s, CASE WHEN kind = 'book' THEN nm WHEN sv = 1 AND ev = 999 THEN nm || ' ' || sc WHEN sc <> ec THEN nm || ' ' || sc || ':' || sv || '–' || ec || ':' || ev
      WHEN sv = ev THEN nm || ' ' || sc || ':' || sv ELSE nm || ' ' || sc || ':' || sv || '–' || ev END AS label,
      CASE WHEN ref_start = ref_end THEN os || '.' || sc || '.' || sv WHEN sc = ec THEN os || '.' || sc || '.' || sv || '-' || ev ELSE os || '.' || sc || '.' || sv || '-' || ec || '.' || ev END AS slug FROM d""")
def range_formatting(t):
    books = _book_table(t)
    d = R.parse_references(_reference_strings(t), "raw", books).where("ref_error IS NULL")
    return R.format_ranges(d, "ref_start", "ref_end", books).select("k", "n", "s", "label", "slug")


@query("fn14_document_refs", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_suppkey % 9 = 0 THEN 'malformed' WHEN a IS NULL THEN 'no such address' ELSE '' END AS ref_error
    FROM (SELECT l.*, s.addr AS a FROM lineitem l LEFT JOIN space s ON s.addr = l.l_orderkey * 1000 + l.l_partkey % 8)""", ("space",))
def document_refs(t):
    ref = F.concat_ws(".", F.concat(F.lit("B"), F.expr("CAST(l_orderkey div 1000 AS STRING)")), F.expr("CAST(l_orderkey % 1000 AS STRING)"), (F.col("l_partkey") % 8).cast("string"))
    ref = F.when(F.col("l_suppkey") % 9 == 0, F.concat(ref, F.lit("-x"))).otherwise(F.concat(ref, F.lit("-"), ref))
    books = S.address_space(t.line_addresses).select(F.col("book").alias("book_id")).distinct().withColumn("osis_id", F.concat(F.lit("B"), s("book_id")))
    d = R.resolve_document_refs(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), ref.alias("ref")), "ref", books, S.address_space(t.line_addresses))
    return d.select("k", "n", "p", F.coalesce("ref_error", F.lit("")).alias("ref_error"))


# --- placement --------------------------------------------------------------------------------------------

@query("jn11_scheme_mapping", """WITH src AS (SELECT l_orderkey * 1000 + l_partkey % 9 AS source, l_suppkey AS s, l_linenumber AS n FROM lineitem),
    m AS (SELECT DISTINCT l_orderkey * 1000 + 8 AS source, l_orderkey * 1000 + 1 AS target FROM lineitem WHERE l_orderkey % 2 = 0)
    SELECT src.source, s, n, coalesce(m.target, x.addr, -1) AS addr, CASE WHEN m.target IS NOT NULL THEN 'map' WHEN x.addr IS NOT NULL THEN 'identity' ELSE 'unresolved' END AS how
    FROM src LEFT JOIN m ON m.source = src.source LEFT JOIN space x ON x.addr = src.source""", ("space",))
def scheme_mapping(t):
    refs = t.lineitem.select((F.col("l_orderkey") * 1000 + F.col("l_partkey") % 9).alias("source"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    m = t.lineitem.where("l_orderkey % 2 = 0").select((F.col("l_orderkey") * 1000 + 8).alias("source"), (F.col("l_orderkey") * 1000 + 1).alias("target")).distinct().withColumn("mapping", F.lit("full"))
    return Pl.resolve_scheme(refs, m, S.address_space(t.line_addresses), "source").select("source", "s", "n", "addr", "how").fillna(-1, ["addr"])


@query("jn12_offset_mapping", """SELECT edition, addr, CASE WHEN chapter % 2 = 0 AND unit BETWEEN 3 AND 9 THEN chapter + 100 ELSE chapter END AS chapter,
    CASE WHEN chapter % 2 = 0 AND unit BETWEEN 3 AND 9 THEN unit + 17 ELSE unit END AS unit FROM units""", ("units",))
def offset_mapping(t):
    ch = t.canon.where("chapter % 2 = 0").select("book", "chapter").distinct()
    offsets = ch.select("book", "chapter", F.lit(3).alias("from_unit"), F.lit(9).alias("to_unit"), (F.col("chapter") + 100).alias("to_chapter"), F.lit(20).alias("first_unit"))
    return Pl.apply_offsets(t.units.select("edition", "addr", "book", "chapter", "unit"), offsets).select("edition", "addr", "chapter", F.col("unit").cast("bigint").alias("unit"))


@query("jn13_unit_placement", """SELECT l_returnflag AS code, l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
    CASE WHEN l_linenumber = 7 THEN 'unplaced' WHEN l_linenumber = 6 OR l_returnflag <> 'N' THEN 'placed' ELSE 'excluded' END AS status,
    CASE WHEN l_linenumber = 7 THEN -1 WHEN l_linenumber = 6 THEN 99000000 + l_orderkey % 900 WHEN l_returnflag = 'A' THEN 71000000 + (l_orderkey % 900) * 1000 + l_linenumber
         WHEN l_returnflag = 'R' THEN 72000000 + (l_orderkey % 900) * 1000 + l_linenumber ELSE -1 END AS addr FROM lineitem""")
def unit_placement(t):
    u = t.lineitem.select(F.col("l_returnflag").alias("code"), (F.col("l_orderkey") % 900).alias("chapter"), F.col("l_linenumber").cast("bigint").alias("unit"),
                          F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    keys = u.select("code", "chapter", "unit").distinct()
    explicit = keys.where("unit = 6").withColumn("addr", 99_000_000 + F.col("chapter"))
    ident = keys.select("code").distinct().where("code <> 'N'").withColumn("book", F.when(F.col("code") == "A", 71).otherwise(72))
    return Pl.place_units(u, explicit, keys.where("unit = 7"), ident).select("code", "k", "n", "p", "status", "addr").fillna(-1, ["addr"])


@query("jn13_assembled_units", "SELECT edition, addr, string_agg(line, ' ' ORDER BY doc_id, line) AS line, count(*) AS n_sources FROM source_lines GROUP BY 1, 2", ("source_lines",))
def assembled_units(t):
    return Pl.assemble(t.source_lines, ["edition", "addr"], ["doc_id"], "line")


@query("jn14_banded_placement", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 100 WHEN 'HOUSEHOLD' THEN 200 ELSE -100000 END + c_custkey % 12 AS chapter,
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'unknown part' WHEN c_custkey % 12 = 0 THEN 'bad number' ELSE '' END AS error FROM customer""")
def banded_placement(t):
    bands = t.customer.select(F.col("c_mktsegment").alias("part")).distinct().where(F.col("part").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).withColumn(
        "offset", F.when(F.col("part") == "BUILDING", 0).when(F.col("part") == "MACHINERY", 100).otherwise(200).cast("bigint"))
    u = t.customer.select("c_custkey", F.col("c_mktsegment").alias("part"), (F.col("c_custkey") % 12).cast("string").alias("ref"))
    return Pl.banded(u, bands).select("c_custkey", F.coalesce("chapter", F.col("ref").cast("bigint") - 100000).alias("chapter"), F.coalesce("error", F.lit("")).alias("error"))


@query("wn06_welded_split", """WITH x AS (SELECT conv_id, turn, text, 'The first part. ' AS a FROM conversations)
    SELECT conv_id * 100 + turn AS id, CAST(i AS BIGINT) AS piece, CASE i WHEN 0 THEN 'head ' WHEN 1 THEN '@one@ ' || replace(text, '@', '') || ' ' WHEN 2 THEN '@two@ end' END AS text, CASE WHEN turn = 3 THEN 'anchor must occur exactly once' ELSE '' END AS error
    FROM x, (SELECT unnest([0, 1, 2]) AS i) WHERE turn <> 3
    UNION ALL SELECT conv_id * 100 + turn, CAST(i AS BIGINT), CASE i WHEN 0 THEN 'head ' WHEN 1 THEN '@one@ ' || replace(text, '@', '') || ' @one@ ' WHEN 2 THEN '@two@ end' END, 'anchor must occur exactly once' FROM x, (SELECT unnest([0, 1, 2]) AS i) WHERE turn = 3""")
def welded_split(t):
    clean = F.replace(F.col("text"), F.lit("@"), F.lit(""))
    text = F.concat(F.lit("head @one@ "), clean, F.when(F.col("turn") == 3, " @one@").otherwise(""), F.lit(" @two@ end"))
    u = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.alias("text"))
    anchors = u.select("id", F.posexplode(F.array(F.lit("@one@"), F.lit("@two@"))).alias("_p", "anchor")).select("id", (F.col("_p") + 1).alias("seq"), "anchor")
    return Pl.split_welded(u, anchors, "id").select("id", "piece", "text", F.coalesce("error", F.lit("")).alias("error"))


@query("jn31_followed_witnesses", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_suppkey IS NULL THEN 'unknown witness' ELSE '' END AS problem
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON s_suppkey = l_suppkey""")
def followed_witnesses(t):
    """Edition follows witness; a witness that is not listed is a problem row."""
    known = t.supplier.where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey")).withColumn("_hit", F.lit(True))
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(known, "l_suppkey", "left")
            .withColumn("problem", F.when(F.col("_hit"), "").otherwise("unknown witness")).drop("_hit"))


@query("ag36_grouped_readings", """SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey) AS readings, count(*) AS n FROM lineitem GROUP BY 1""")
def grouped_readings(t):
    from ..operators.timeline import ordered_list
    return t.lineitem.groupBy("l_orderkey").agg(ordered_list([s("l_linenumber"), F.lit(":"), s("l_partkey")], [F.col("l_linenumber"), F.col("l_partkey")]).alias("readings"),
                                                F.count(F.lit(1)).alias("n"))


@query("prj16_apparatus_scan", """SELECT p.req, l.l_linenumber AS position, l.l_partkey AS part FROM passages p JOIN lineitem l ON l.l_orderkey * 1000 + l.l_linenumber BETWEEN p.q_start AND p.q_end WHERE l.l_returnflag = 'A'""", ("passages",))
def apparatus_scan(t):
    from ..operators.passages import in_chapters
    rows = t.lineitem.where("l_returnflag = 'A'").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("addr"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"))
    return in_chapters(rows, t.passages).select("req", "position", "part")


@query("prj17_notes_for_ids", """SELECT c.conv_id, c.turn, c.role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS note_order FROM conversations c WHERE c.conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def notes_for_ids(t):
    from pyspark.sql import Window as W
    ids = t.labels.where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    order = W.partitionBy("conv_id").orderBy("turn")
    return (t.conversations.join(ids, "conv_id", "left_semi")
            .select("conv_id", "turn", "role", F.row_number().over(order).cast("bigint").alias("note_order")))


# --- function surface ---------------------------------------------------------------------------------------

@query("ud01_unicode_functions", "SELECT DISTINCT surface, nfc_normalize(surface) AS composed, lower(strip_accents(surface)) AS folded FROM words", ("words",))
def unicode_functions(t):
    """The Arrow functions run once per distinct word."""
    return t.words.select("surface").distinct().select("surface", T.nfc("surface").alias("composed"), T.nfd_fold("surface").alias("folded"))


@query("ud02_reference_table_function", """SELECT p_partkey, CAST(i AS BIGINT) AS item, p_name AS book_name, CAST(p_size AS BIGINT) AS chapter, CAST(v AS BIGINT) AS first_unit, CAST(w AS BIGINT) AS last_unit FROM part,
    (SELECT unnest([0, 1, 2]) AS i, unnest([16, 18, 20]) AS v, unnest([16, 18, 22]) AS w)""")
def reference_table_function(t):
    from ..functions import udtf
    udtf.register(t.spark)
    t.part.select("p_partkey", F.concat("p_name", F.lit(" "), s("p_size"), F.lit(":16, 18;20-22")).alias("refs")).createOrReplaceTempView("canonframe_refs")
    return t.spark.sql("SELECT p_partkey, r.item, r.book_name, r.chapter, r.first_unit, r.last_unit FROM canonframe_refs, LATERAL split_references(refs) r")


@query("ud04_transform_chain", """SELECT edition, count(*) AS n_units, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT edition, addr, string_agg(trim(line), ' ' ORDER BY doc_id, trim(line)) AS text FROM source_lines GROUP BY 1, 2) GROUP BY 1""", ("source_lines",))
def transform_chain(t):
    """Every operator is DataFrame -> DataFrame, so a job is a chain of ``transform`` calls."""
    return (t.source_lines.withColumn("line", F.trim("line"))
            .transform(Pl.assemble, ["edition", "addr"], ["doc_id"], "line")
            .transform(lambda d: d.groupBy("edition").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.length("line")).alias("n_chars"))))
