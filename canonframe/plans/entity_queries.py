"""Entity documents of all eight kinds, made from the given tables with planted faults: problems, details, review sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import timeline as Tl
from ..sources import entities as E
from .publish_queries import s
from .registry import query

SIX = ["artifacts", "events", "issues", "persons", "investigations", "works"]
TITLE = {"artifacts": "name", "persons": "name", "events": "title", "issues": "title", "investigations": "title", "works": "title"}


def _id(prefix, column):
    return F.concat(F.lit(f"{prefix}-"), s(column))


def _status(column):
    return F.element_at(F.array(*[F.lit(x) for x in E.STATUSES]), (F.col(column) % 4 + 1).cast("int"))


def _cite(key, locator=None):
    return F.array(F.struct(_id("src", key).alias("source"), (locator if locator is not None else F.lit(None).cast("string")).alias("locator")))


def _file(df: DataFrame, file, *fields) -> DataFrame:
    return df.select(F.concat(file, F.lit(".json")).alias("file"), F.to_json(F.struct(*fields)).alias("content"))


def _events(t):
    part, supplier = F.col("part"), F.col("source_id")
    row = F.struct("ordinal", "part", "source_id", "earliest", "latest", F.struct(
        F.concat(F.lit("p-"), s("ordinal")).alias("id"), F.lit("l").alias("label"), F.when(part % 17 == 0, "guess").otherwise(F.col("tradition")).alias("tradition"),
        "earliest", "latest", F.lit("s").alias("summary"),
        F.array(F.struct(F.when(supplier % 9 != 0, _id("src", "part")).alias("source"), s("ordinal").alias("locator"))).alias("citations")).alias("p"))
    lines = t.positions.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["p"]).alias("positions"))
    nothing = F.array().cast(lines.schema["positions"].dataType)
    orders = t.orders.join(lines, F.col("event_id") == F.col("o_orderkey"), "left")
    return _file(orders, _id("ev", "o_orderkey"), _id("ev", "o_orderkey").alias("id"), F.concat(F.lit("Event "), s("o_orderkey")).alias("title"),
                 F.when(F.col("o_custkey") % 13 == 0, "sideways").otherwise("canon").alias("axis"), F.lit("political").alias("category"), F.lit("firm").alias("confidence"),
                 _status("o_custkey").alias("status"), F.col("o_orderpriority").alias("summary"),
                 F.array(F.struct(F.concat(F.lit("B."), s("o_custkey"), F.lit(".1")).alias("ref"), F.lit("names").alias("link"))).alias("verses"),
                 F.coalesce("positions", nothing).alias("positions"))


def _artifacts(t):
    size = F.col("p_size")
    made = F.when(size % 2 == 0, F.struct((-size - 1).alias("earliest"), F.when(size % 8 != 0, -size).alias("latest")))
    return _file(t.part, _id("art", "p_partkey"), _id("art", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(size % 10 == 0, "teapot").otherwise("seal").alias("kind"),
                 _status("p_size").alias("status"), made.alias("made"), F.lit("l").alias("language"), F.col("p_type").alias("summary"), _cite("p_size", F.col("p_brand")).alias("citations"),
                 F.array(F.struct(F.concat(F.lit("A."), s("p_size"), F.lit(".2")).alias("ref"), F.lit("dates").alias("link"))).alias("verses"))


def _persons(t):
    key = F.col("c_custkey")
    attested = F.array(F.struct(_id("art", "c_nationkey").alias("artifact"), F.lit("silent").alias("relation"), F.lit("n").alias("note"), _cite("c_nationkey").alias("citations")))
    return _file(t.customer, _id("per", "c_custkey"), _id("per", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.lit("s").alias("summary"),
                 _status("c_custkey").alias("status"), _cite("c_custkey").alias("citations"), F.array(F.col("c_name"), F.when(key % 11 == 0, " ").otherwise("x")).alias("also_known_as"),
                 attested.alias("attestations"))


def _issues(t):
    view = F.struct(F.lit("l").alias("label"), F.lit("t").alias("text"), _cite("s_nationkey", F.col("s_name")).alias("citations"))
    views = F.array(view, view)
    return _file(t.supplier, _id("is", "s_suppkey"), _id("is", "s_suppkey").alias("id"), F.lit("textual").alias("kind"), F.col("s_name").alias("title"), F.lit("s").alias("summary"),
                 _status("s_suppkey").alias("status"), _cite("s_suppkey").alias("citations"),
                 F.when(F.col("s_nationkey") % 5 == 0, F.slice(views, 1, 0)).otherwise(views).alias("views"))


def _investigations(t):
    witness = F.struct(F.lit("A").alias("siglum"), F.lit("n").alias("name"), F.lit("r").alias("reading"), F.lit("t").alias("translation"), F.lit("l").alias("language"),
                       _cite("n_nationkey").alias("citations"))
    different = F.struct(F.when(F.col("n_regionkey") == 1, "other").otherwise("lexical").alias("kind"), F.lit("t").alias("text"))
    return _file(t.nation, _id("inv", "n_nationkey"), _id("inv", "n_nationkey").alias("id"), F.col("n_name").alias("title"), _status("n_nationkey").alias("status"), F.lit("Gen.1.1").alias("ref"),
                 F.lit("s").alias("summary"), F.array(witness).alias("witnesses"), F.array(different).alias("differences"))


def _works(t):
    item = F.col("item_id")
    return _file(t.benchmark, _id("wo", "item_id"), F.when(item % 9 == 0, "other").otherwise(_id("wo", "item_id")).alias("id"), F.concat(F.lit("Work "), s("item_id")).alias("title"),
                 F.lit("described").alias("canon"), _status("item_id").alias("status"), F.lit("s").alias("summary"), _cite("item_id").alias("citations"),
                 F.lit("l").alias("original_language"), F.lit("c").alias("contents"), F.array(F.struct(F.col("text"), _cite("item_id").alias("citations"))).alias("excerpts"),
                 F.array(F.struct(F.lit("ev-1").alias("event"), F.when(item % 7 == 0, " ").otherwise("n").alias("note"))).alias("events"))


def _eras(t):
    era = F.struct(_id("era", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(-9).alias("start"), F.when(F.col("r_regionkey") != 2, -3).alias("end"),
                   F.lit("s").alias("summary"), _cite("r_regionkey").alias("citations"))
    return _file(t.region, _id("eras", "r_regionkey"), F.array(era).alias("era"))


def _sources(t):
    """Fifty sources a file."""
    group = F.expr("p_partkey div 50")
    kind = F.when((F.col("p_partkey") % 50 == 7) & (group % 4 == 1), "scroll").otherwise("book")
    source = F.struct("p_partkey", F.struct(_id("src", "p_partkey").alias("id"), kind.alias("kind"), F.concat_ws(" ", "p_name", s("p_partkey")).alias("title")).alias("v"))
    files = t.part.groupBy(group.alias("g")).agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: x["v"]).alias("source"))
    return _file(files, _id("sources", "g"), F.col("source"))


FILES = {"sources": _sources, "eras": _eras, "artifacts": _artifacts, "events": _events, "issues": _issues, "persons": _persons, "investigations": _investigations, "works": _works}

_SQL = f"""pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ordinal, part, source_id, earliest, latest) - 1 AS i FROM positions),
    faults AS MATERIALIZED (
      SELECT 'events' AS kind, 'ev-' || o_orderkey || '.json' AS file, 'axis' AS path, 'unknown value sideways' AS problem FROM orders WHERE o_custkey % 13 = 0
      UNION ALL SELECT 'events', 'ev-' || o_orderkey || '.json', 'positions', 'needs an entry' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'events', 'ev-' || event_id || '.json', 'positions[' || i || '].tradition', 'unknown value guess' FROM pos JOIN orders ON o_orderkey = event_id WHERE part % 17 = 0
      UNION ALL SELECT 'events', 'ev-' || event_id || '.json', 'positions[' || i || '].citations[0].source', 'missing' FROM pos JOIN orders ON o_orderkey = event_id WHERE source_id % 9 = 0
      UNION ALL SELECT 'artifacts', 'art-' || p_partkey || '.json', 'kind', 'unknown value teapot' FROM part WHERE p_size % 10 = 0
      UNION ALL SELECT 'artifacts', 'art-' || p_partkey || '.json', 'made.latest', 'missing' FROM part WHERE p_size % 8 = 0
      UNION ALL SELECT 'persons', 'per-' || c_custkey || '.json', 'also_known_as[1]', 'wrong type or empty' FROM customer WHERE c_custkey % 11 = 0
      UNION ALL SELECT 'issues', 'is-' || s_suppkey || '.json', 'views', 'needs an entry' FROM supplier WHERE s_nationkey % 5 = 0
      UNION ALL SELECT 'investigations', 'inv-' || n_nationkey || '.json', 'differences[0].kind', 'unknown value other' FROM nation WHERE n_regionkey = 1
      UNION ALL SELECT 'works', 'wo-' || item_id || '.json', 'id', 'is not the file name' FROM benchmark WHERE item_id % 9 = 0
      UNION ALL SELECT 'works', 'wo-' || item_id || '.json', 'events[0].note', 'empty' FROM benchmark WHERE item_id % 7 = 0
      UNION ALL SELECT 'eras', 'eras-' || r_regionkey || '.json', 'era[0].end', 'missing' FROM region WHERE r_regionkey = 2
      UNION ALL SELECT 'sources', 'sources-' || p_partkey // 50 || '.json', 'source[' || (SELECT count(*) FROM part q WHERE q.p_partkey // 50 = p.p_partkey // 50 AND q.p_partkey < p.p_partkey) || '].kind', 'unknown value scroll'
        FROM part p WHERE p_partkey % 50 = 7 AND (p_partkey // 50) % 4 = 1)"""


@query("src16_nested_problems", f"WITH {_SQL} SELECT * FROM faults", ("positions",))
def nested_problems(t):
    return reduce(DataFrame.unionByName, [E.problems(make(t), E.KINDS[kind]) for kind, make in FILES.items()])


def _status_sql(key: str) -> str:
    return f"(['draft', 'sources-located', 'claims-checked', 'expert-reviewed'])[{key} % 4 + 1]"


_GOOD = f"""ent AS MATERIALIZED (SELECT * FROM (
      SELECT 'artifacts' AS kind, 'art-' || p_partkey AS id, p_name AS title, {_status_sql('p_size')} AS status FROM part
      UNION ALL SELECT 'events', 'ev-' || o_orderkey, 'Event ' || o_orderkey, {_status_sql('o_custkey')} FROM orders
      UNION ALL SELECT 'issues', 'is-' || s_suppkey, s_name, {_status_sql('s_suppkey')} FROM supplier
      UNION ALL SELECT 'persons', 'per-' || c_custkey, c_name, {_status_sql('c_custkey')} FROM customer
      UNION ALL SELECT 'investigations', 'inv-' || n_nationkey, n_name, {_status_sql('n_nationkey')} FROM nation
      UNION ALL SELECT 'works', 'wo-' || item_id, 'Work ' || item_id, {_status_sql('item_id')} FROM benchmark) e
      WHERE NOT EXISTS (SELECT 1 FROM faults f WHERE f.kind = e.kind AND f.file = e.id || '.json')),
    src AS MATERIALIZED (SELECT 'src-' || p_partkey AS source, p_name || ' ' || p_partkey AS title FROM part
      WHERE 'sources-' || p_partkey // 50 || '.json' NOT IN (SELECT file FROM faults WHERE kind = 'sources')),
    cit AS MATERIALIZED (SELECT c.kind, c.id, c.o, c.path, coalesce(s.title, c.source || ' (unknown)') || coalesce(', ' || c.locator, '') AS label FROM (
      SELECT 'artifacts' AS kind, 'art-' || p_partkey AS id, 0 AS o, 'citations[0]' AS path, 'src-' || p_size AS source, p_brand AS locator FROM part
      UNION ALL SELECT 'events', 'ev-' || event_id, i, 'positions[' || i || '].citations[0]', 'src-' || part, '' || ordinal FROM pos
      UNION ALL SELECT 'issues', 'is-' || s_suppkey, 0, 'citations[0]', 'src-' || s_suppkey, NULL FROM supplier
      UNION ALL SELECT 'issues', 'is-' || s_suppkey, v + 1, 'views[' || v || '].citations[0]', 'src-' || s_nationkey, s_name FROM supplier, (SELECT unnest([0, 1]) AS v)
      UNION ALL SELECT 'persons', 'per-' || c_custkey, 0, 'citations[0]', 'src-' || c_custkey, NULL FROM customer
      UNION ALL SELECT 'persons', 'per-' || c_custkey, 1, 'attestations[0].citations[0]', 'src-' || c_nationkey, NULL FROM customer
      UNION ALL SELECT 'investigations', 'inv-' || n_nationkey, 0, 'witnesses[0].citations[0]', 'src-' || n_nationkey, NULL FROM nation
      UNION ALL SELECT 'works', 'wo-' || item_id, 0, 'citations[0]', 'src-' || item_id, NULL FROM benchmark
      UNION ALL SELECT 'works', 'wo-' || item_id, 1, 'excerpts[0].citations[0]', 'src-' || item_id, NULL FROM benchmark) c LEFT JOIN src s ON s.source = c.source),
    ver AS MATERIALIZED (SELECT 'artifacts' AS kind, 'art-' || p_partkey AS id, 'dates' AS link, 'A.' || p_size || '.2' AS ref FROM part
      UNION ALL SELECT 'events', 'ev-' || o_orderkey, 'names', 'B.' || o_custkey || '.1' FROM orders)"""


def _assembled(t, source_line, verse_line, sep):
    """The six kinds' faultless documents, each with its sources and verses of every depth in order, from one pass over the files."""
    docs = {kind: E.documents(FILES[kind](t), E.KINDS[kind]) for kind in SIX}
    known = E.documents(FILES["sources"](t), E.KINDS["sources"]).select(F.inline("doc.source")).select(F.col("id").alias("source"), F.col("title").alias("_title"))
    label = F.concat(F.coalesce("_title", F.concat("source", F.lit(" (unknown)"))), F.coalesce(F.concat(F.lit(", "), "locator"), F.lit("")))
    parts = []
    for name, d in docs.items():
        schema = E.KINDS[name].schema
        verses = E.gather(F.col("doc"), schema, "verses")
        text = F.lit(None).cast("string") if verses is None else F.nullif(F.array_join(F.transform(verses, lambda v: verse_line(v["entry"])), sep), F.lit(""))
        parts.append(d.select("kind", F.col("doc.id").alias("id"), F.col(f"doc.{TITLE[name]}").alias("title"), F.col("doc.status").alias("status"), text.alias("verses"),
                              F.posexplode_outer(E.gather(F.col("doc"), schema, "citations")).alias("ordinal", "_e"))
                     .select("kind", "id", "title", "status", "verses", "ordinal", "_e.path", "_e.entry.*"))
    cited = reduce(DataFrame.unionByName, parts).join(known, "source", "left").withColumn("label", label)
    lines = Tl.ordered_list(source_line, [F.col("ordinal")], sep)
    return cited.groupBy("kind", "id", "title", "status", "verses").agg(F.nullif(lines, F.lit("")).alias("sources"))


@query("gr10_all_kinds", f"""WITH {_SQL}, {_GOOD}
    SELECT e.*, coalesce((SELECT string_agg(path || '=' || label, '|' ORDER BY o) FROM cit c WHERE c.kind = e.kind AND c.id = e.id), '') AS sources,
           coalesce((SELECT string_agg(link || ' ' || ref, '|') FROM ver v WHERE v.kind = e.kind AND v.id = e.id), '') AS verses FROM ent e""", ("positions",))
def all_kinds(t):
    out = _assembled(t, [F.col("path"), F.lit("="), F.col("label")], lambda v: F.concat(v["link"], F.lit(" "), v["ref"]), "|")
    return out.fillna("", ["sources", "verses"])


@query("snk04_all_kinds", f"""WITH {_SQL}, {_GOOD}
    SELECT e.kind, e.id, concat_ws(chr(10), '- [ ] **' || title || '** - `' || kind || '/' || id || '.json` (' || status || ')',
      (SELECT string_agg('  - Source: ' || label, chr(10) ORDER BY o) FROM cit c WHERE c.kind = e.kind AND c.id = e.id),
      (SELECT string_agg('  - Verse (' || link || '): ' || ref, chr(10)) FROM ver v WHERE v.kind = e.kind AND v.id = e.id)) AS sheet
    FROM ent e WHERE status IN ('draft', 'sources-located')""", ("positions",))
def all_sheets(t):
    """One checklist text for every unchecked document of the six kinds."""
    out = _assembled(t, [F.lit("  - Source: "), F.col("label")], lambda v: F.concat(F.lit("  - Verse ("), v["link"], F.lit("): "), v["ref"]), "\n").where(F.col("status").isin(Tl.UNCHECKED))
    head = F.concat(F.lit("- [ ] **"), "title", F.lit("** - `"), "kind", F.lit("/"), "id", F.lit(".json` ("), "status", F.lit(")"))
    return out.select("kind", "id", F.concat_ws("\n", head, "sources", "verses").alias("sheet"))
