"""Timelines: envelopes, grades, eras, windows, passage notes, details, strips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import space as S, timeline as Tl
from ..functions import text as T
from .registry import query

_ENV = """env AS (SELECT p.event_id,
    coalesce(min(earliest) FILTER (k AND tradition <> 'traditional'), min(earliest) FILTER (k AND tradition = 'traditional')) AS earliest,
    coalesce(max(latest) FILTER (k AND tradition <> 'traditional'), max(latest) FILTER (k AND tradition = 'traditional')) AS latest,
    min(earliest) FILTER (k AND tradition = 'traditional') AS trad_earliest, max(latest) FILTER (k AND tradition = 'traditional') AS trad_latest
    FROM (SELECT p.*, p.dates = 'event' OR coalesce(e.axis = 'composition', false) AS k FROM positions p LEFT JOIN timeline_events e ON e.event_id = p.event_id) p GROUP BY 1)"""
_ERAS = """eras AS (SELECT 'era-' || r_regionkey AS era_id, CAST(r_regionkey AS BIGINT) * 2 - 5 AS "start", CAST(r_regionkey AS BIGINT) * 2 - 4 AS "end" FROM region WHERE r_regionkey <> 2)"""
NONE = -10**6


def _envelopes(t):
    p = t.positions.join(t.timeline_events.select("event_id", "axis"), "event_id", "left")
    return Tl.envelope(p, F.coalesce(F.col("axis") == "composition", F.lit(False)))


def _eras(t):
    """Eras from the regions, with a gap where region 2 would be."""
    k = F.col("r_regionkey").cast("bigint")
    return t.region.where("r_regionkey <> 2").select(F.concat(F.lit("era-"), k.cast("string")).alias("era_id"),
                                                     (k * 2 - 5).alias("start"), (k * 2 - 4).alias("end"))


def _filled(df, cols):
    return df.fillna(NONE, cols)


@query("ag18_date_envelope", f"WITH {_ENV} SELECT event_id, coalesce(earliest, {NONE}) AS earliest, coalesce(latest, {NONE}) AS latest, coalesce(trad_earliest, {NONE}) AS trad_earliest, coalesce(trad_latest, {NONE}) AS trad_latest FROM env",
       ("positions", "timeline_events"))
def date_envelope(t):
    return _filled(_envelopes(t), ["earliest", "latest", "trad_earliest", "trad_latest"])


_EVID = "list_position(['corroborates', 'partially-corroborates', 'consistent', 'silent'], relation)"


@query("ag19_evidence_grade", f"""
    SELECT p.p_partkey AS artifact_id, coalesce((['corroborates', 'partially-corroborates', 'consistent', 'silent'])[min({_EVID})], 'none') AS evidence,
           coalesce(bool_or(relation = 'in-tension'), false) AS has_tension FROM part p LEFT JOIN attestations a ON a.artifact_id = p.p_partkey GROUP BY 1""", ("attestations",))
def evidence_grade(t):
    return Tl.evidence(t.attestations, "artifact_id", t.part.select(F.col("p_partkey").alias("artifact_id")))


@query("ag24_by_era", f"WITH {_ERAS} SELECT e.event_id, coalesce((SELECT arg_min(era_id, (\"start\", era_id)) FROM eras WHERE e.year BETWEEN \"start\" AND \"end\"), 'unplaced') AS era FROM timeline_events e", ("timeline_events",))
def by_era(t):
    return Tl.by_era(t.timeline_events, _eras(t), "year").select("event_id", F.coalesce("era_id", F.lit("unplaced")).alias("era"))


@query("ag25_busiest_era", f"WITH {_ERAS} SELECT era_id, n FROM (SELECT era_id, \"start\", count(*) AS n FROM eras JOIN timeline_events e ON e.year BETWEEN \"start\" AND \"end\" GROUP BY 1, 2) ORDER BY n DESC, \"start\" LIMIT 1", ("timeline_events",))
def busiest_era(t):
    return Tl.busiest_era(t.timeline_events, _eras(t), "year")


@query("gr07_window_query", f"WITH {_ENV}, {_ERAS} SELECT w.era_id, e.event_id FROM eras w JOIN env e ON e.earliest <= w.\"end\" AND e.latest >= w.\"start\"", ("positions", "timeline_events"))
def window_query(t):
    windows = _eras(t).select("era_id", F.col("start").alias("from_year"), F.col("end").alias("to_year"))
    return Tl.in_window(_envelopes(t).where("earliest IS NOT NULL"), windows).select("era_id", "event_id")


@query("tk06_year_order", f"WITH {_ENV} SELECT event_id, coalesce(earliest, {NONE}) AS earliest, row_number() OVER (ORDER BY earliest DESC NULLS LAST, event_id) AS rank FROM env ORDER BY earliest DESC NULLS LAST, event_id LIMIT 200", ("positions", "timeline_events"))
def year_order(t):
    """Undated entries come last in either direction."""
    from pyspark.sql import Window as W
    top = _envelopes(t).orderBy(F.desc_nulls_last("earliest"), "event_id").limit(200)
    order = W.orderBy(F.desc_nulls_last("earliest"), "event_id")      # the 200 reported rows
    return _filled(top.select("event_id", "earliest", F.row_number().over(order).cast("bigint").alias("rank")), ["earliest"])


@query("tk07_enumerated_order", """
    SELECT event_id, string_agg(tradition || ':' || ordinal || ':' || part, '|' ORDER BY list_position(['archaeological', 'critical', 'chronological', 'traditional'], tradition), ordinal, part)
      FILTER (tradition <> 'traditional') AS scholarly, count(*) FILTER (tradition = 'traditional') AS n_traditional FROM positions GROUP BY 1 HAVING count(*) FILTER (tradition <> 'traditional') > 0""", ("positions",))
def enumerated_order(t):
    trad = F.col("tradition") == "traditional"
    n = t.positions.groupBy("event_id").agg(F.count_if(trad).alias("n_traditional"))
    scholarly = t.positions.where(~trad).groupBy("event_id").agg(Tl.ordered_list(
        [F.col("tradition"), F.lit(":"), F.col("ordinal").cast("string"), F.lit(":"), F.col("part").cast("string")],
        [Tl.rank_in("tradition", Tl.TRADITION_ORDER), F.col("ordinal"), F.col("part")]).alias("scholarly"))
    return scholarly.join(n, "event_id")


@query("jn16_subject_citations", """
    SELECT p.event_id, count(*) AS n_citations, count(DISTINCT s.s_suppkey) AS n_sources, min(s.s_name) AS first_source FROM positions p JOIN supplier s ON s.s_suppkey = p.source_id GROUP BY 1""", ("positions",))
def subject_citations(t):
    per = t.positions.groupBy("event_id", F.col("source_id").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("_n"))
    return (per.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").groupBy("event_id")
            .agg(F.sum("_n").alias("n_citations"), F.count(F.lit(1)).alias("n_sources"), F.min("s_name").alias("first_source")))


_HITS = """hits AS MATERIALIZED (SELECT p.req, p.q_start, p.q_end, l.subject_kind, l.subject_id, l.start, l."end", l.link_type, greatest(l.start, p.q_start) AS anchor, least(l."end", p.q_end) AS hi
    FROM passages p JOIN links l ON l.start <= p.q_end AND l."end" >= p.q_start)"""
_REL = """rel AS MATERIALIZED (SELECT a.req, a.subject_id AS artifact_id, a.start, a."end",
    arg_min(t.relation, list_position(['in-tension', 'corroborates', 'partially-corroborates', 'consistent', 'silent'], t.relation)) AS relation
    FROM (SELECT DISTINCT req, subject_id, start, "end", anchor, hi FROM nn WHERE subject_kind = 'artifact') a JOIN attestations t ON t.artifact_id = a.subject_id
    JOIN timeline_events e ON e.event_id = t.event_id AND e.axis <> 'canon'
    JOIN nn o ON o.req = a.req AND o.subject_kind = 'event' AND o.subject_id = t.event_id AND greatest(o.start, a.anchor) <= least(o."end", a.hi) GROUP BY 1, 2, 3, 4)"""


@query("gr06_clamped_anchor", f"WITH {_HITS} SELECT req, subject_kind, subject_id, start, \"end\", link_type, anchor, hi AS clamped_end FROM hits", ("links", "passages"))
def clamped_anchor(t):
    return Tl.links_in(t.passages, t.links).select("req", "subject_kind", "subject_id", "start", "end", "link_type", "anchor", "clamped_end")


@query("gr08_passage_entities", f"""WITH {_HITS} SELECT DISTINCT req, CASE subject_kind WHEN 'argument' THEN 'event' ELSE subject_kind END AS subject_kind, subject_id FROM hits
    WHERE subject_kind <> 'argument' OR subject_id IN (SELECT event_id FROM positions)""", ("links", "passages", "positions"))
def passage_entities(t):
    return Tl.entities(t.passages, t.links, t.positions)


@query("jn21_relation_strength", f"WITH {_HITS}, nn AS (SELECT * FROM hits WHERE link_type <> 'names'), {_REL} SELECT req, artifact_id, start AS a_start, \"end\" AS a_end, relation FROM rel",
       ("links", "passages", "attestations", "timeline_events"))
def relation_strength(t):
    hits = Tl.links_in(t.passages, t.links.where("link_type <> 'names'"))
    rel = (t.attestations.join(t.timeline_events.where("axis <> 'canon'").select("event_id"), "event_id")
           .select("artifact_id", F.lit("event").alias("rel_kind"), F.col("event_id").alias("rel_id"), "relation"))
    return Tl.strongest_relations(hits, rel)


_RESTATED = """restated AS (SELECT DISTINCT a.req, a.subject_id, a.anchor FROM nn a JOIN attestations t ON t.artifact_id = a.subject_id
    JOIN timeline_events e ON e.event_id = t.event_id AND e.axis = 'canon'
    JOIN nn o ON o.req = a.req AND o.subject_kind = 'event' AND o.subject_id = t.event_id AND a.anchor BETWEEN o.start AND o."end" WHERE a.subject_kind = 'artifact')"""
_NOTES = f"""WITH {_HITS}, nn AS (SELECT * FROM hits WHERE link_type <> 'names'), {_REL}, {_RESTATED},
    first AS (SELECT req, subject_kind, subject_id, anchor, min((start, "end", link_type)) AS f FROM nn
              WHERE subject_kind <> 'artifact' OR (req, subject_id, anchor) NOT IN (SELECT (req, subject_id, anchor) FROM restated) GROUP BY 1, 2, 3, 4)"""


@query("gr09_margin_notes", f"""{_NOTES}, ff AS (SELECT req, subject_kind, subject_id, anchor, f[1] AS start, f[2] AS "end", f[3] AS link_type FROM first)
    SELECT ff.*, coalesce(r.relation, '') AS relation FROM ff LEFT JOIN rel r ON ff.subject_kind = 'artifact' AND r.req = ff.req AND r.artifact_id = ff.subject_id AND r.start = ff.start AND r."end" = ff."end" """,
       ("links", "passages", "attestations", "timeline_events"))
def margin_notes(t):
    return Tl.margin_notes(t.passages, t.links, t.attestations, t.timeline_events).fillna("", ["relation"])


@query("jn22_redundant_notes", f"{_NOTES} SELECT req, subject_id, anchor FROM nn WHERE subject_kind = 'artifact' EXCEPT SELECT req, subject_id, anchor FROM first WHERE subject_kind = 'artifact'",
       ("links", "passages", "attestations", "timeline_events"))
def redundant_notes(t):
    named = t.links.where("link_type <> 'names'")
    every = Tl.links_in(t.passages, named).where("subject_kind = 'artifact'").select("req", "subject_id", "anchor")
    kept = Tl.margin_notes(t.passages, t.links, t.attestations, t.timeline_events).where("subject_kind = 'artifact'")
    return every.distinct().join(kept.select("req", "subject_id", "anchor"), ["req", "subject_id", "anchor"], "left_anti")


@query("wn15_anchor_dedupe", f"WITH {_HITS} SELECT req, subject_kind, subject_id, anchor, count(*) AS n_links, min(start) AS first_start FROM hits GROUP BY 1, 2, 3, 4", ("links", "passages"))
def anchor_dedupe(t):
    return (Tl.links_in(t.passages, t.links).groupBy("req", "subject_kind", "subject_id", "anchor")
            .agg(F.count(F.lit(1)).alias("n_links"), F.min("start").alias("first_start")))


@query("jn27_range_notes", """
    SELECT p.req, l.subject_id, greatest(l.start, p.q_start) AS anchor, l.link_type FROM passages p JOIN links l ON l.start <= p.q_end AND l."end" >= p.q_start
    WHERE l.subject_kind = 'issue' AND l.link_type <> 'names'""", ("links", "passages"))
def range_notes(t):
    own = t.links.where("subject_kind = 'issue' AND link_type <> 'names'")
    return Tl.links_in(t.passages, own).select("req", "subject_id", "anchor", "link_type")


@query("gr10_entity_details", f"""WITH {_ENV},
    p AS (SELECT event_id, string_agg(ordinal || ':' || tradition || ':' || dates || ':' || part, '|' ORDER BY ordinal, part, source_id) AS positions, count(*) AS n_positions FROM positions GROUP BY 1),
    a AS (SELECT event_id, string_agg(artifact_id || '=' || relation, '|' ORDER BY artifact_id) AS attestations FROM attestations GROUP BY 1),
    l AS (SELECT subject_id, string_agg(start || '-' || "end", '|' ORDER BY start, "end", link_type) AS verses FROM links WHERE subject_kind = 'event' GROUP BY 1)
    SELECT e.event_id, e.title, e.axis, e.status, coalesce(env.earliest, {NONE}) AS earliest, coalesce(p.n_positions, 0) AS n_positions, coalesce(p.positions, '') AS positions,
           coalesce(a.attestations, '') AS attestations, coalesce(l.verses, '') AS verses
    FROM timeline_events e LEFT JOIN env ON env.event_id = e.event_id LEFT JOIN p ON p.event_id = e.event_id LEFT JOIN a ON a.event_id = e.event_id LEFT JOIN l ON l.subject_id = e.event_id""",
       ("positions", "timeline_events", "attestations", "links"))
def entity_details(t):
    """Every entity assembled bottom-up in one pass."""
    def s(c):
        return F.col(c).cast("string")
    p = t.positions.groupBy("event_id").agg(Tl.ordered_list(
        [s("ordinal"), F.lit(":"), F.col("tradition"), F.lit(":"), F.col("dates"), F.lit(":"), s("part")],
        [F.col("ordinal"), F.col("part"), F.col("source_id")]).alias("positions"), F.count(F.lit(1)).alias("n_positions"))
    a = t.attestations.groupBy("event_id").agg(Tl.ordered_list(
        [s("artifact_id"), F.lit("="), F.col("relation")], [F.col("artifact_id")]).alias("attestations"))
    v = (t.links.where("subject_kind = 'event'").groupBy(F.col("subject_id").alias("event_id"))
         .agg(Tl.ordered_list([s("start"), F.lit("-"), s("end")], [F.col("start"), F.col("end"), F.col("link_type")]).alias("verses")))
    out = t.timeline_events.select("event_id", "title", "axis", "status")
    for part in (_envelopes(t).select("event_id", "earliest"), p, a, v):
        out = out.join(part, "event_id", "left")
    return out.fillna("", ["positions", "attestations", "verses"]).fillna(0, ["n_positions"]).fillna(NONE, ["earliest"])


@query("gr11_investigations_for_addresses", """
    SELECT DISTINCT e.addr, i.event_id FROM edge_hits e JOIN (SELECT event_id, event_id * 1000 + 1 AS s, event_id * 1000 + 2005 AS t FROM timeline_events WHERE axis = 'composition') i
    ON e.addr BETWEEN i.s AND i.t""", ("edge_hits", "timeline_events"))
def investigations_for_addresses(t):
    inv = t.timeline_events.where("axis = 'composition'").select("event_id", (F.col("event_id") * 1000 + 1).alias("s"), (F.col("event_id") * 1000 + 2005).alias("t"))
    targets = t.edges.select("dst_start", "dst_end").distinct()
    addrs = S.expand_ranges(targets, t.space, "dst_start", "dst_end", S.LINK_SPAN).select("addr").distinct()
    return S.points_in_ranges(addrs, inv, "addr", ("s", "t")).select("addr", "event_id")


@query("ag31_entity_summaries", """
    SELECT e.event_id, coalesce((SELECT min(start) FROM links l WHERE l.subject_kind = 'event' AND l.subject_id = e.event_id), -1) AS first_verse,
           (SELECT count(*) FROM positions p WHERE p.event_id = e.event_id) AS n_positions, (SELECT count(*) FROM attestations a WHERE a.event_id = e.event_id) AS n_attestations,
           coalesce((SELECT min(earliest) FROM positions p WHERE p.event_id = e.event_id), 0) AS first_year,
           coalesce((SELECT string_agg(DISTINCT CAST(start // 1000000 AS VARCHAR), ',' ORDER BY CAST(start // 1000000 AS VARCHAR)) FROM links l WHERE l.subject_kind = 'event' AND l.subject_id = e.event_id), '') AS books,
           (SELECT count(DISTINCT source_id) FROM positions p WHERE p.event_id = e.event_id) AS n_witnesses,
           (SELECT count(*) FROM attestations a WHERE a.event_id = e.event_id AND a.relation IN ('in-tension', 'silent')) AS n_differences
    FROM timeline_events e""", ("timeline_events", "links", "positions", "attestations"))
def entity_summaries(t):
    books = F.array_join(F.array_sort(F.collect_set(F.expr("CAST(start div 1000000 AS STRING)"))), ",")
    first = t.links.where("subject_kind = 'event'").groupBy(F.col("subject_id").alias("event_id")).agg(F.min("start").alias("first_verse"), books.alias("books"))
    n_p = t.positions.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_positions"), F.min("earliest").alias("first_year"), F.countDistinct("source_id").alias("n_witnesses"))
    n_a = t.attestations.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_attestations"), F.count_if(F.col("relation").isin("in-tension", "silent")).alias("n_differences"))
    out = t.timeline_events.select("event_id")
    for part in (first, n_p, n_a):
        out = out.join(part, "event_id", "left")
    return out.fillna(-1, ["first_verse"]).fillna("", ["books"]).fillna(0, ["n_positions", "n_attestations", "first_year", "n_witnesses", "n_differences"])


@query("prj13_unchecked_entities", """
    SELECT event_id, status, status IN ('draft', 'sources-located') AS unchecked, EXISTS (SELECT 1 FROM attestations a WHERE a.event_id = e.event_id AND a.relation <> 'silent') AS sourced FROM timeline_events e""", ("timeline_events", "attestations"))
def unchecked_entities(t):
    sourced = t.attestations.groupBy("event_id").agg(F.max(F.col("relation") != "silent").alias("sourced"))
    return (t.timeline_events.select("event_id", "status", F.col("status").isin(Tl.UNCHECKED).alias("unchecked"))
            .join(sourced, "event_id", "left").withColumn("sourced", F.coalesce("sourced", F.lit(False))))


@query("fn16_year_arithmetic", """
    SELECT event_id, earliest, latest, CAST(abs(latest - earliest) - CASE WHEN (earliest < 0) <> (latest < 0) THEN 1 ELSE 0 END AS BIGINT) AS span,
           CASE WHEN earliest = latest THEN abs(earliest) || CASE WHEN earliest < 0 THEN ' BCE' ELSE ' CE' END
                WHEN (earliest < 0) = (latest < 0) THEN abs(earliest) || '–' || abs(latest) || CASE WHEN latest < 0 THEN ' BCE' ELSE ' CE' END
                ELSE abs(earliest) || CASE WHEN earliest < 0 THEN ' BCE' ELSE ' CE' END || '–' || abs(latest) || CASE WHEN latest < 0 THEN ' BCE' ELSE ' CE' END END AS label,
           ordinal, part FROM positions""", ("positions",))
def year_arithmetic(t):
    return t.positions.select("event_id", "earliest", "latest", Tl.span_years("earliest", "latest").alias("span"),
                              Tl.range_label("earliest", "latest").alias("label"), "ordinal", "part")


@query("fn15_first_sentence", """
    SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE rtrim(CASE WHEN regexp_extract(substr(s, 1, 180), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(substr(s, 1, 180), '(?s)^(.+) [^ ]*$', 1) ELSE substr(s, 1, 180) END) || '…' END AS gist
    FROM (SELECT doc_id, CASE WHEN regexp_matches(trim(text), '[.!?]["''”’)]*\\s') THEN regexp_extract(trim(text), '(?s)^(.*?[.!?]["''”’)]*)\\s', 1) ELSE trim(text) END AS s FROM documents)""")
def first_sentence(t):
    return t.documents.select("doc_id", T.first_sentence("text").alias("gist"))


def _lanes_sql(bars: str, order: str, left: str, right: str) -> str:
    """First fit as a recursion over the bars of a strip that carries the ends of its lanes."""
    return f"""bars AS MATERIALIZED ({bars}), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY custkey, axis ORDER BY {order}) AS n FROM bars),
    r AS (SELECT custkey, axis, event_id, n, 0 AS lane, [{right}] AS ends FROM o WHERE n = 1
      UNION ALL SELECT custkey, axis, event_id, n, lane, ends[1:lane] || [claim_end] || ends[lane + 2:] FROM (
        SELECT o.custkey, o.axis, o.event_id, o.n, o.{right} AS claim_end, r.ends, coalesce(list_position(list_transform(r.ends, lambda e: e < o.{left}), true) - 1, len(r.ends)) AS lane
        FROM r JOIN o ON o.custkey = r.custkey AND o.axis = r.axis AND o.n = r.n + 1))"""


_BARS = "SELECT t.custkey, t.axis, event_id, env.earliest, env.latest, trad_earliest, trad_latest FROM env JOIN timeline_events t USING (event_id) WHERE env.earliest IS NOT NULL"


@query("wn11_lane_packing", f"""WITH RECURSIVE {_ENV}, {_lanes_sql(_BARS, 'earliest, latest, event_id', 'earliest', 'latest')}
    SELECT o.custkey, o.axis, o.event_id, o.earliest, o.latest, CAST(r.lane AS BIGINT) AS lane, r.lane >= 3 AS hidden FROM o JOIN r USING (custkey, axis, event_id)""", ("positions", "timeline_events"))
def lane_packing(t):
    """Bars of one strip per customer and axis; lanes beyond 3 are hidden."""
    bars = _envelopes(t).where("earliest IS NOT NULL").join(t.timeline_events, "event_id").select("custkey", "axis", "event_id", "earliest", "latest")
    laid = Tl.lay_out(bars, ["custkey", "axis"], "earliest", "latest", ["earliest", "latest", "event_id"])
    return Tl.limit_rows(laid, 3)


SCALE, LABEL = 4.0, 14.0


def _years(a, b):
    return f"({b} - {a} - CASE WHEN {a} < 0 AND {b} >= 0 THEN 1 WHEN {a} >= 0 AND {b} < 0 THEN -1 ELSE 0 END)"


_CLAIMS = f"""SELECT *, event_id % 5 = 0 AS asked, {_years('(-5)', 'earliest')} * {SCALE} AS bar_left, greatest({_years('earliest', 'latest')} * {SCALE}, 8.0) AS bar_width,
      {_years('(-5)', 'least(earliest, trad_earliest)')} * {SCALE} AS claim_left,
      greatest({_years('(-5)', 'earliest')} * {SCALE} + greatest({_years('earliest', 'latest')} * {SCALE}, {LABEL}, 8.0), {_years('(-5)', 'greatest(latest, trad_latest)')} * {SCALE}) AS claim_right
    FROM ({_BARS}) WHERE earliest <= 3 AND latest >= -5"""


@query("wn11_strip_layout", f"""WITH RECURSIVE {_ENV}, {_lanes_sql(_CLAIMS, '(CASE WHEN asked THEN 0 ELSE 1 END), earliest, latest, event_id', 'claim_left', 'claim_right')}
    SELECT o.custkey, o.axis, o.event_id, CAST(bar_left AS DOUBLE) AS bar_left, CAST(bar_width AS DOUBLE) AS bar_width, CAST(claim_right AS DOUBLE) AS claim_right, CAST(r.lane AS BIGINT) AS lane, r.lane >= 3 AS hidden
    FROM o JOIN r USING (custkey, axis, event_id)""", ("positions", "timeline_events"))
def strip_layout(t):
    """Bars between the years -5 and 3 with labels and traditional envelopes; every fifth entry is asked for and packed first."""
    bars = _envelopes(t).where("earliest IS NOT NULL").join(t.timeline_events.select("event_id", "custkey", "axis"), "event_id")
    claims = Tl.strip_claims(bars, F.lit(-5), F.lit(3), SCALE, reserve=LABEL).withColumn("asked", F.col("event_id") % 5 == 0)
    laid = Tl.lay_out(claims, ["custkey", "axis"], "claim_left", "claim_right", ["earliest", "latest", "event_id"], first="asked")
    return Tl.limit_rows(laid, 3).select("custkey", "axis", "event_id", "bar_left", "bar_width", "claim_right", "lane", "hidden")


@query("wn14_diversity_gate", """
    WITH s AS (SELECT c_nationkey % 5 AS series, CAST(o_orderdate AS DATE) AS day, arg_min(o_orderpriority, o_orderkey) AS genre, arg_min(o_orderstatus, o_orderkey) AS kind,
               arg_min(o_custkey % 7, o_orderkey) AS book FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    w AS (SELECT series, day, count(*) OVER x AS k, len(list_distinct(list(genre) OVER x)) AS n_genre, len(list_distinct(list(kind) OVER x)) AS n_kind, len(list_distinct(list(book) OVER x)) AS n_book FROM s
          WINDOW x AS (PARTITION BY series ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT series, strftime(day, '%Y-%m-%d') AS day, n_book, n_genre, n_kind, n_book < 7 OR n_genre < 5 OR n_kind < 3 AS fails FROM w WHERE k = 30""")
def diversity_gate(t):
    s = (t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
         .groupBy((F.col("c_nationkey") % 5).alias("series"), F.col("o_orderdate").cast("date").alias("day"))
         .agg(F.min_by("o_orderpriority", "o_orderkey").alias("genre"), F.min_by("o_orderstatus", "o_orderkey").alias("kind"),
              F.min_by(F.col("o_custkey") % 7, "o_orderkey").alias("book")))
    out = Tl.diversity_gate(s, ["series"], "day", {"book": 7, "genre": 5, "kind": 3})
    return out.select("series", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_book", "n_genre", "n_kind", "fails")


@query("wn14_consecutive_days", """
    WITH d AS (SELECT DISTINCT c_nationkey AS series, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS day FROM orders JOIN customer ON c_custkey = o_custkey),
    i AS (SELECT series, day, day - row_number() OVER (PARTITION BY series ORDER BY day) AS island FROM d)
    SELECT series, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, count(*) >= 60 AS long_enough FROM i GROUP BY series, island""")
def consecutive_days(t):
    """Runs of days without a gap per series, and whether a run has the 60 days asked for."""
    days = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("series"), F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("start")).distinct()
    runs = S.merge_ranges(days.withColumn("end", F.col("start")), partition=["series"])
    n = F.col("end") - F.col("start") + 1
    return runs.select("series", F.col("start").alias("first_day"), F.col("end").alias("last_day"), n.alias("n_days"), (n >= 60).alias("long_enough"))
