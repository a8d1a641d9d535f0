"""The table bridge of ``views.py`` restated as SQL, for the oracles."""

from __future__ import annotations

_TOK = r"[\p{L}\p{N}]+"


def year_sql(col: str) -> str:
    return f"(CASE WHEN year({col}) >= 1998 THEN year({col}) - 1997 ELSE year({col}) - 1998 END)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "space": ((), """
        SELECT addr, addr // 1000000 AS book, (addr // 1000) % 1000 AS chapter, addr % 1000 AS unit,
               row_number() OVER (ORDER BY addr) - 1 AS pos
        FROM (SELECT DISTINCT l_orderkey * 1000 + l_linenumber AS addr FROM lineitem)"""),
    "edges": (("space",), """
        SELECT e.edge_id, e.src, a.addr AS dst_start, b.addr AS dst_end, e.votes, e.r1, e.r2
        FROM (SELECT *, least(r1 + span, n - 1) AS r2
              FROM (SELECT l_orderkey * 1000 + l_linenumber AS src, n,
                     (l_partkey * 37 + l_suppkey) % n AS r1,
                     CAST(l_quantity AS BIGINT) % 7 AS span, CAST(l_quantity AS BIGINT) - 5 AS votes,
                     concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                               CAST(round(l_extendedprice * 100) AS BIGINT)) AS edge_id
                    FROM lineitem, (SELECT count(*) AS n FROM space))) e
        JOIN space a ON a.pos = e.r1
        JOIN space b ON b.pos = e.r2"""),
    "edge_hits": (("edges",), """
        SELECT x.edge_id, x.votes, s.addr
        FROM (SELECT edge_id, votes, unnest(range(r1, least(r2, r1 + 399) + 1)) AS p FROM edges) x JOIN space s ON s.pos = x.p"""),
    "edge_reach": (("edges",), """
        SELECT x.edge_id, x.votes, s.addr
        FROM (SELECT edge_id, votes, unnest(range(r1, r2 + 1)) AS p FROM edges) x JOIN space s ON s.pos = x.p"""),
    "heat": (("edge_hits",), """
        SELECT addr, count(*) AS inbound_count, CAST(sum(greatest(votes, 1)) AS BIGINT) AS weighted_score
        FROM edge_hits GROUP BY addr"""),
    "passages": ((), """
        SELECT o_orderkey AS req, o_orderkey * 1000 + 1 AS q_start, o_orderkey * 1000 + 999 AS q_end FROM orders"""),
    "editions": ((), """
        SELECT source AS edition, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS edition_no,
               CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 4 WHEN 1 THEN 'OT' WHEN 2 THEN 'NT' ELSE 'all' END AS scope,
               CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 5 <> 4 AS licensed
        FROM (SELECT DISTINCT source FROM documents)"""),
    "source_lines": ((), """
        SELECT doc_id, source AS edition, lang, line_no,
               ((doc_id // 24) // 4 + 1) * 1000000 + ((doc_id // 24) % 4 + 1) * 1000 + line_no AS addr, line
        FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"""),
    "units": (("source_lines",), """
        SELECT edition, addr, string_agg(line, ' ' ORDER BY doc_id) AS text,
               addr // 1000000 AS book, (addr // 1000) % 1000 AS chapter, addr % 1000 AS unit
        FROM source_lines GROUP BY edition, addr"""),
    "texts": (("units",), "SELECT * FROM units WHERE length(text) >= 20"),
    "omissions": (("units",), """
        SELECT edition, addr, book, chapter, unit,
               CASE WHEN unit = 1 THEN 'critical-text' WHEN length(text) = 0 THEN 'unexplained' ELSE 'versification' END AS kind,
               text AS reason FROM units WHERE length(text) < 20"""),
    "canon": (("source_lines",), """
        SELECT DISTINCT addr, addr // 1000000 AS book, (addr // 1000) % 1000 AS chapter, addr % 1000 AS unit FROM source_lines"""),
    "books": ((), """
        SELECT book, CASE book % 3 WHEN 1 THEN 'OT' WHEN 2 THEN 'NT' ELSE 'DC' END AS testament,
               CASE WHEN book % 3 = 1 THEN 'hebrew' WHEN book % 3 = 2 THEN 'nt' WHEN book % 2 = 0 THEN 'deuterocanon' ELSE 'apostolic' END AS canon,
               'Book ' || book AS name
        FROM (SELECT DISTINCT (doc_id // 24) // 4 + 1 AS book FROM documents)"""),
    "words": ((), f"""
        SELECT doc_id * 1000 + line_no AS addr, position, surface,
               lower(strip_accents(surface)) AS search_form, lang AS language, doc_id
        FROM (SELECT doc_id, lang, line_no, unnest(t) AS surface, unnest(range(1, len(t) + 1)) AS position
              FROM (SELECT doc_id, lang, line_no, regexp_extract_all(line, '{_TOK}') AS t
                    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)))"""),
    "lexicon": ((), f"""
        SELECT lower(strip_accents(surface)) AS headword, min(item_id) AS entry_no, min(surface) AS gloss, count(*) AS n_uses
        FROM (SELECT item_id, unnest(regexp_extract_all(text, '{_TOK}')) AS surface FROM benchmark) GROUP BY 1"""),
    "original_words": (("words", "lexicon"), """
        SELECT w.*, lower(w.surface) AS lemma, coalesce('H' || l.entry_no, '') AS strongs,
               (CASE WHEN regexp_matches(w.surface, '^\\p{Lu}') THEN 'P' ELSE 'C' END) || length(w.surface) AS morph
        FROM words w LEFT JOIN lexicon l ON l.headword = w.search_form"""),
    "word_requests": (("lexicon",), """
        SELECT query || '|' || coalesce(language, '') || '|' || coalesce(morph, '') AS request, query, language, morph,
               CASE WHEN regexp_matches(u, '^[HAG]?[0-9]{1,5}[A-Z]?$') THEN (CASE WHEN regexp_matches(u, '^[0-9]') THEN 'H' ELSE substr(u, 1, 1) END)
                    || CAST(regexp_extract(u, '[0-9]+') AS BIGINT) || lower(regexp_extract(u, '([A-Z]?)$', 1)) END AS key
        FROM (SELECT *, upper(replace(query, ' ', '')) AS u FROM (
          SELECT DISTINCT substr(headword, 1, 3) AS query, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS VARCHAR) AS morph FROM lexicon
          UNION SELECT substr(headword, 1, 2), lang, NULL FROM lexicon, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
          UNION SELECT lower(gloss), NULL, 'P' FROM lexicon
          UNION SELECT 'h ' || entry_no, NULL, NULL FROM lexicon))"""),
    "request_kinds": (("original_words", "word_requests"), """
        SELECT DISTINCT r.request, k.* FROM word_requests r JOIN (SELECT DISTINCT strongs, lemma, search_form, language, morph FROM original_words) k
        ON (CASE WHEN r.key IS NOT NULL THEN k.strongs = r.key ELSE k.lemma = r.query OR starts_with(k.search_form, lower(strip_accents(r.query))) END)
        AND (r.language IS NULL OR k.language = r.language) AND starts_with(k.morph, coalesce(r.morph, ''))"""),
    "lexicon2": ((), f"""
        SELECT lower(strip_accents(surface)) AS headword, min(conv_id) AS entry_no, max(surface) AS gloss, count(*) AS n_uses
        FROM (SELECT conv_id, unnest(regexp_extract_all(text, '{_TOK}')) AS surface FROM conversations) GROUP BY 1"""),
    "positions": ((), f"""
        SELECT event_id, ordinal, part, source_id, tradition, dates, earliest,
               CASE WHEN earliest < 0 AND earliest + w >= 0 THEN earliest + w + 1 ELSE earliest + w END AS latest
        FROM (SELECT l_orderkey AS event_id, CAST(l_linenumber AS BIGINT) AS ordinal, l_partkey AS part, l_suppkey AS source_id,
                     CASE l_returnflag WHEN 'R' THEN 'traditional' WHEN 'A' THEN 'archaeological' ELSE 'critical' END AS tradition,
                     CASE l_linestatus WHEN 'F' THEN 'event' ELSE 'composition' END AS dates,
                     {year_sql('l_shipdate')} AS earliest, CAST(l_quantity AS BIGINT) % 3 AS w FROM lineitem)"""),
    "timeline_events": ((), f"""
        SELECT o_orderkey AS event_id,
               CASE o_orderstatus WHEN 'P' THEN 'composition' WHEN 'F' THEN 'canon' ELSE 'narrative' END AS axis,
               'Event ' || o_orderkey AS title,
               CASE o_custkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'sources-located' WHEN 2 THEN 'claims-checked' ELSE 'expert-reviewed' END AS status,
               {year_sql('o_orderdate')} AS year, o_custkey AS custkey FROM orders"""),
    "attestations": ((), """
        SELECT DISTINCT l_partkey AS artifact_id, l_orderkey AS event_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'corroborates' WHEN '2-HIGH' THEN 'partially-corroborates'
                    WHEN '3-MEDIUM' THEN 'consistent' WHEN '5-LOW' THEN 'silent' ELSE 'in-tension' END AS relation
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""),
    "links": ((), """
        SELECT kind AS subject_kind,
               CASE kind WHEN 'artifact' THEN l_partkey WHEN 'person' THEN l_suppkey ELSE l_orderkey END AS subject_id,
               start, start + CAST(l_quantity AS BIGINT) % 3 + CASE WHEN l_tax > 0.07 THEN 1000 ELSE 0 END AS "end",
               CASE WHEN l_discount < 0.02 THEN 'names' WHEN l_discount < 0.06 THEN 'describes' ELSE 'background' END AS link_type
        FROM (SELECT *, l_orderkey * 1000 + l_linenumber AS start,
                     (['event', 'argument', 'artifact', 'issue', 'person'])[month(l_shipdate) % 5 + 1] AS kind FROM lineitem)"""),
}


def complete(sql: str, names: tuple[str, ...]) -> str:
    """Put the named CTEs and what they need in front of ``sql``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
