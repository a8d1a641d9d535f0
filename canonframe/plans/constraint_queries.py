"""Gates written as constraint specs: every table is read once for all of its rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as K, gates as G, structure as St
from .publish_queries import _sql
from .registry import query

STATUS = ["draft", "sources-located", "claims-checked", "expert-reviewed"]
RELATIONS = ["corroborates", "partially-corroborates", "consistent", "silent"]


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_POSITIONS = "(SELECT *, event_id * 1000 + ordinal + part % 2 AS verse, earliest - CASE WHEN source_id % 4 = 0 AND earliest = 1 THEN 1 ELSE 0 END AS first FROM positions)"


@query("qg26_timeline_rules", _sql([
    ("tradition is a known value", "SELECT count(*) FROM positions WHERE tradition NOT IN ('traditional', 'critical')"),
    ("dates is a known value", "SELECT count(*) FROM positions WHERE dates NOT IN ('event', 'composition')"),
    ("first is no year zero", f"SELECT count(*) FROM {_POSITIONS} WHERE first = 0"),
    ("latest is no year zero", "SELECT count(*) FROM positions WHERE latest = 0"),
    ("first to latest in order", f"SELECT count(*) FROM {_POSITIONS} WHERE first > latest"),
    ("event_id, ordinal unique", "SELECT count(*) FROM (SELECT 1 FROM positions GROUP BY event_id, ordinal HAVING count(*) <> 1)"),
    ("event has a cited position", "SELECT count(*) FROM (SELECT 1 FROM positions GROUP BY event_id HAVING max(source_id % 7) = 0)"),
    ("event_id exists", "SELECT count(*) FROM positions WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 2000)"),
    ("verse exists", f"SELECT count(*) FROM {_POSITIONS} WHERE verse NOT IN (SELECT addr FROM space)"),
    ("positions at least", "SELECT count(*) < 1000 FROM positions"),
]), ("positions", "space"))
def timeline_rules(t):
    """Enums, years, duplicates, citations, events and verses of all positions, from one scan of them."""
    rows = t.positions.select("*", (F.col("event_id") * 1000 + F.col("ordinal") + F.col("part") % 2).alias("verse"),
                              (F.col("earliest") - F.when((F.col("source_id") % 4 == 0) & (F.col("earliest") == 1), 1).otherwise(0)).alias("first"))
    return K.check(rows, [
        K.one_of("tradition", ["traditional", "critical"]), K.one_of("dates", ["event", "composition"]), *K.years("first", "latest"),
        K.unique("event_id", "ordinal"), K.Group("event has a cited position", ("event_id",), F.max(F.col("source_id") % 7) > 0),
        K.reference("event_id", t.orders.where("o_totalprice > 2000").select("o_orderkey")), K.reference("verse", t.space.select("addr")),
        K.Size("positions at least", 1000, 2**62)])


@query("qg26_text_types", _sql([
    ("events: amount is int", "SELECT count(*) FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL AND json_extract_string(props, '$.k') IS NOT NULL"),
    ("events: amount is present", "SELECT count(*) FROM events WHERE coalesce(trim(json_extract_string(props, '$.k')), '') = ''"),
    ("events: event_type is a known value", "SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view', 'error')"),
    ("events: event_id unique", "SELECT count(*) FROM (SELECT 1 FROM events GROUP BY event_id HAVING count(*) <> 1)"),
    ("suppliers: number is int", "SELECT count(*) FROM supplier"),
    ("suppliers: s_name unique", "SELECT count(*) FROM (SELECT 1 FROM supplier GROUP BY s_name HAVING count(*) <> 1)"),
    ("suppliers: s_nationkey exists", "SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)"),
]))
def text_types(t):
    """Types of values that arrive as text; names of suppliers hold no number, so each is a violation."""
    events = t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("amount"))
    suppliers = t.supplier.select("s_name", "s_nationkey", F.col("s_name").alias("number"))
    return K.check_all([
        ("events", events, [K.typed("amount", "int"), *K.required("amount"), K.one_of("event_type", ["click", "view", "error"]), K.unique("event_id")]),
        ("suppliers", suppliers, [K.typed("number", "int"), K.unique("s_name"),
                                  K.reference("s_nationkey", t.nation.where("n_regionkey <> 0").select("n_nationkey"))])])


_BOOKS = """be AS MATERIALIZED (SELECT e.event_id, e.axis, p.books, p.n, p.composition, p.traditional FROM timeline_events e JOIN
    (SELECT event_id, count(*) FILTER (part % 5 = 0) AS books, count(*) AS n, count(*) FILTER (dates = 'composition') AS composition,
            count(*) FILTER (tradition = 'traditional') AS traditional FROM positions GROUP BY 1) p ON p.event_id = e.event_id)"""


@query("qg27_book_rules", f"WITH {_BOOKS} " + _sql([
    ("books of compositions only", "SELECT count(*) FROM be WHERE (axis = 'composition') <> (books > 0)"),
    ("composition without books", "SELECT count(*) FROM be WHERE axis = 'composition' AND books = 0"),
    ("books on another axis", "SELECT count(*) FROM be WHERE axis <> 'composition' AND books > 0"),
    ("an own date on other axes", "SELECT count(*) FROM be WHERE axis <> 'composition' AND composition = n"),
    ("not only traditional", "SELECT count(*) FROM be WHERE traditional = n"),
    ("event_id unique", "SELECT count(*) FROM (SELECT 1 FROM be GROUP BY event_id HAVING count(*) <> 1)"),
]), ("positions", "timeline_events"))
def book_rules(t):
    """Books belong to compositions and to nothing else; other axes need a position that dates the event itself."""
    facts = t.positions.groupBy("event_id").agg(
        F.count_if(F.col("part") % 5 == 0).alias("books"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("dates") == "composition").alias("composition"), F.count_if(F.col("tradition") == "traditional").alias("traditional"))
    events = t.timeline_events.select("event_id", "axis").join(facts, "event_id")
    composed, books = F.col("axis") == "composition", F.col("books") > 0
    return K.check(events, [
        K.Row("books of compositions only", composed == books), K.Row("composition without books", ~composed | books),
        K.Row("books on another axis", composed | ~books), K.Row("an own date on other axes", composed | (F.col("composition") < F.col("n"))),
        K.Row("not only traditional", F.col("traditional") < F.col("n")), K.unique("event_id")])


@query("qg28_reference_rules", _sql([
    ("lines: source_id exists", "SELECT count(*) FROM positions WHERE source_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)"),
    ("lines: part exists", "SELECT count(*) FROM positions WHERE part NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)"),
    ("lines: ledger exists", "SELECT count(*) FROM positions WHERE tradition = 'critical' AND 'T-' || part % 60 NOT IN (SELECT 'T-' || p_size FROM part)"),
    ("lines: attested pair exists", "SELECT count(*) FROM positions p WHERE NOT EXISTS (SELECT 1 FROM attestations a WHERE a.artifact_id = p.part AND a.event_id = p.event_id AND a.relation <> 'silent')"),
    ("parts: p_partkey is cited", "SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)"),
]), ("positions", "attestations"))
def reference_rules(t):
    """Sources, artifacts, ledger ids and attested pairs of all positions from one scan; parts nobody cites."""
    lines = t.positions.withColumn("ledger", F.when(F.col("tradition") == "critical", F.concat(F.lit("T-"), (F.col("part") % 60).cast("string"))))
    known = t.attestations.where("relation <> 'silent'").select("artifact_id", "event_id")
    return K.check_all([
        ("lines", lines, [
            K.reference("source_id", t.supplier.where("s_nationkey < 20").select("s_suppkey")), K.reference("part", t.part.where("p_size > 2").select("p_partkey")),
            K.reference("ledger", t.part.select(F.concat(F.lit("T-"), F.col("p_size").cast("string"))), optional=True),
            K.Reference("attested pair exists", ("part", "event_id"), known)]),
        ("parts", t.part, [K.Reference("p_partkey is cited", ("p_partkey",), t.lineitem.where("l_quantity > 48").select("l_partkey"))])])


_ENVELOPE = """env AS MATERIALIZED (SELECT event_id, min(earliest) AS a, max(latest) AS b, min(earliest) FILTER (tradition = 'traditional') AS ta,
    max(latest) FILTER (tradition = 'traditional' AND source_id % 8 <> 0) AS tb FROM positions GROUP BY 1)"""


@query("qg29_schema_checks", f"WITH {_ENVELOPE} " + _sql([
    ("excerpts: text has at most 24 words", "SELECT count(*) FROM benchmark WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 24"),
    ("excerpts: item_id unique", "SELECT count(*) FROM (SELECT 1 FROM benchmark GROUP BY item_id HAVING count(*) <> 1)"),
    ("events: axis is a known value", "SELECT count(*) FROM timeline_events WHERE axis NOT IN ('narrative', 'composition')"),
    ("events: status is a known value", f"SELECT count(*) FROM timeline_events WHERE status NOT IN {_in(STATUS[:3])}"),
    ("events: year is no year zero", "SELECT count(*) FROM timeline_events WHERE year = 0"),
    ("events: event_id unique", "SELECT count(*) FROM (SELECT 1 FROM timeline_events GROUP BY event_id HAVING count(*) <> 1)"),
    ("events: title is present", "SELECT count(*) FROM timeline_events WHERE coalesce(trim(title), '') = ''"),
    ("events: custkey exists", "SELECT count(*) FROM timeline_events WHERE custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    ("envelopes: a is no year zero", "SELECT count(*) FROM env WHERE a = 0"),
    ("envelopes: b is no year zero", "SELECT count(*) FROM env WHERE b = 0"),
    ("envelopes: a to b in order", "SELECT count(*) FROM env WHERE a > b"),
    ("envelopes: ta is no year zero", "SELECT count(*) FROM env WHERE (ta IS NOT NULL OR tb IS NOT NULL) AND coalesce(ta, 0) = 0"),
    ("envelopes: tb is no year zero", "SELECT count(*) FROM env WHERE (ta IS NOT NULL OR tb IS NOT NULL) AND coalesce(tb, 0) = 0"),
    ("envelopes: ta to tb in order", "SELECT count(*) FROM env WHERE (ta IS NOT NULL OR tb IS NOT NULL) AND NOT coalesce(ta <= tb, false)"),
    ("attestations: relation is a known value", f"SELECT count(*) FROM attestations WHERE relation NOT IN {_in(RELATIONS)}"),
    ("attestations: artifact_id, event_id unique", "SELECT count(*) FROM (SELECT 1 FROM attestations GROUP BY artifact_id, event_id HAVING count(*) <> 1)"),
    ("links: subject_kind is a known value", "SELECT count(*) FROM links WHERE subject_kind NOT IN ('event', 'artifact', 'person')"),
    ("links: link_type is a known value", "SELECT count(*) FROM links WHERE link_type NOT IN ('describes', 'names')"),
    ("links: start exists", "SELECT count(*) FROM links WHERE start NOT IN (SELECT addr FROM space)"),
    ("links: end exists", 'SELECT count(*) FROM links WHERE "end" NOT IN (SELECT addr FROM space)'),
]), ("positions", "timeline_events", "attestations", "links", "space"))
def schema_checks(t):
    """The value checks, keys and references of five tables."""
    traditional = F.col("tradition") == "traditional"
    envelopes = t.positions.groupBy("event_id").agg(
        F.min("earliest").alias("a"), F.max("latest").alias("b"), F.min(F.when(traditional, F.col("earliest"))).alias("ta"),
        F.max(F.when(traditional & (F.col("source_id") % 8 != 0), F.col("latest"))).alias("tb"))
    year = K.Row("year is no year zero", F.col("year") != 0)
    return K.check_all([
        ("excerpts", t.benchmark, [K.words_at_most("text", 24), K.unique("item_id")]),
        ("events", t.timeline_events, [K.one_of("axis", ["narrative", "composition"]), K.one_of("status", STATUS[:3]), year, K.unique("event_id"), *K.required("title"),
                                       K.reference("custkey", t.customer.where("c_acctbal > 0").select("c_custkey"))]),
        ("envelopes", envelopes, [*K.years("a", "b"), *K.years("ta", "tb", optional=True)]),
        ("attestations", t.attestations, [K.one_of("relation", RELATIONS), K.unique("artifact_id", "event_id")]),
        ("links", t.links, [K.one_of("subject_kind", ["event", "artifact", "person"]), K.one_of("link_type", ["describes", "names"]),
                            K.reference("start", t.space.select("addr")), K.reference("end", t.space.select("addr"))])])


_WORKS = """w AS MATERIALIZED (SELECT p.p_partkey AS work, p.p_size % 3 = 0 AS described, p.p_size % 4 = 0 AS undated, p.p_type LIKE '%STEEL%' AS contents,
    coalesce(l.n, 0) AS composed, coalesce(l.printed, 0) AS printed FROM part p LEFT JOIN
    (SELECT part, count(*) FILTER (dates = 'composition') AS n, count(*) FILTER (source_id % 2 = 0) AS printed FROM positions GROUP BY 1) l ON l.part = p.p_partkey)"""


@query("qg31_work_constraints", f"WITH {_WORKS} " + _sql([
    ("works: dated xor undated", "SELECT count(*) FROM w WHERE (composed > 0) = undated"),
    ("works: described has no text", "SELECT count(*) FROM w WHERE described AND printed > 0"),
    ("works: described has contents", "SELECT count(*) FROM w WHERE described AND NOT contents"),
    ("works: others are printed", "SELECT count(*) FROM w WHERE NOT described AND printed = 0"),
    ("works: work unique", "SELECT count(*) FROM (SELECT 1 FROM w GROUP BY work HAVING count(*) <> 1)"),
    ("positions: critical ones lead", """SELECT count(*) FROM (SELECT 1 FROM positions GROUP BY part HAVING min(event_id * 8 + ordinal) FILTER (tradition = 'traditional') < max(event_id * 8 + ordinal) FILTER (tradition <> 'traditional'))"""),
    ("positions: no event twice", "SELECT count(*) FROM (SELECT 1 FROM positions GROUP BY part, event_id HAVING count(*) > 1)"),
    ("positions: codes exist", "SELECT count(*) FROM positions WHERE tradition = 'traditional' AND source_id % 30 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"),
]), ("positions",))
def work_constraints(t):
    """The five rules of works; positions of a work are read once for order, repeated events and codes."""
    used = t.positions.groupBy(F.col("part").alias("work")).agg(F.count_if(F.col("dates") == "composition").alias("composed"),
                                                               F.count_if(F.col("source_id") % 2 == 0).alias("printed"))
    works = t.part.select(F.col("p_partkey").alias("work"), (F.col("p_size") % 3 == 0).alias("described"), (F.col("p_size") % 4 == 0).alias("undated"),
                          F.col("p_type").contains("STEEL").alias("contents")).join(used, "work", "left").fillna(0, ["composed", "printed"])
    described, printed = F.col("described"), F.col("printed") > 0
    place, traditional = F.col("event_id") * 8 + F.col("ordinal"), F.col("tradition") == "traditional"
    codes = t.positions.withColumn("code", F.when(traditional, F.col("source_id") % 30)).withColumn("place", place)
    first, last = F.min(F.when(traditional, F.col("place"))), F.max(F.when(~traditional, F.col("place")))
    return K.check_all([
        ("works", works, [K.Row("dated xor undated", (F.col("composed") > 0) != F.col("undated")), K.Row("described has no text", ~(described & printed)),
                          K.Row("described has contents", ~described | F.col("contents")), K.Row("others are printed", described | printed), K.unique("work")]),
        ("positions", codes, [K.Group("critical ones lead", ("part",), F.coalesce(first > last, F.lit(True))),
                              K.Group("no event twice", ("part", "event_id"), F.count(F.lit(1)) == 1),
                              K.Reference("codes exist", ("code",), t.nation.where("n_regionkey < 3").select("n_nationkey"), optional=True)])])


_UNITS = "(SELECT l_orderkey AS parent, l_orderkey * 1000 + l_linenumber AS s, l_orderkey * 1000 + l_linenumber + CAST(l_quantity AS BIGINT) % 3 AS e FROM lineitem)"


@query("qg32_structure_rules", _sql([
    ("inside parent", f"SELECT count(*) FROM {_UNITS} u LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 2000) ON o_orderkey = parent WHERE o_orderkey IS NULL OR e > o_orderkey * 1000 + 7"),
    ("siblings apart", f"""SELECT count(*) FROM (SELECT parent, s, count(*) AS n FROM {_UNITS} GROUP BY 1, 2) a WHERE n > 1
        OR EXISTS (SELECT 1 FROM {_UNITS} b WHERE b.parent = a.parent AND b.s < a.s AND b.e >= a.s)"""),
    ("initials", """SELECT count(*) FROM (SELECT doc_id * 1000 + n AS addr, lower(line[1]) AS initial FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents) WHERE line <> '') d
        LEFT JOIN (SELECT addr, arg_min(search_form, position)[1] AS found FROM words GROUP BY 1) w ON w.addr = d.addr WHERE d.initial IS DISTINCT FROM w.found"""),
]), ("words",))
def structure_rules(t):
    """Lines inside their orders and apart from each other; the first letter of every line against its first word."""
    start = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    units = t.lineitem.select(F.col("l_orderkey").alias("parent"), start.alias("start"), (start + F.col("l_quantity").cast("bigint") % 3).alias("end"))
    key = F.col("o_orderkey")
    parents = t.orders.where("o_totalprice > 2000").select(key.alias("parent"), (key * 1000 + 1).alias("p_start"), (key * 1000 + 7).alias("p_end"))
    lines = t.scanned_documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where("line <> ''")
    declared = lines.select((F.col("doc_id") * 1000 + F.col("p") + 1).alias("addr"), F.lower(F.substring("line", 1, 1)).alias("initial"))
    return G.run([("inside parent", St.outside_parents(units, parents)), ("siblings apart", St.overlapping_siblings(units)),
                  ("initials", St.initial_breaks(declared, t.words))])
