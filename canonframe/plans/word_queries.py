"""Words, forms, concordance, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage as C, distinct as D, originals as O, space as S, words as Wd
from ..session import cut_lineage
from .registry import query

_BOOK = "(addr // 1000) // 100"


@query("jn03_interlinear", """
    SELECT w.addr, w.position, w.surface, coalesce(a.gloss, b.gloss, '') AS gloss,
           CASE WHEN a.gloss IS NOT NULL THEN 'primary' WHEN b.gloss IS NOT NULL THEN 'secondary' ELSE 'none' END AS matched
    FROM words w LEFT JOIN lexicon a ON a.headword = w.search_form LEFT JOIN lexicon2 b ON b.headword = w.search_form""", ("words", "lexicon", "lexicon2"))
def interlinear(t):
    return (Wd.interlinear(t.words, t.lexicon, t.lexicon2)
            .select("addr", "position", "surface", F.coalesce("gloss", F.lit("")).alias("gloss"), "matched"))


@query("jn04_two_pass_match", """
    WITH e AS (SELECT surface AS headword, lower(strip_accents(surface)) AS search_headword, min(item_id) AS entry_key, min(item_id || ':' || surface) AS gloss
               FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS surface FROM benchmark) GROUP BY 1),
    k AS (SELECT DISTINCT surface FROM words),
    h AS (SELECT search_headword, arg_min(gloss, (entry_key, headword)) AS gloss, min((entry_key, headword)) AS k FROM e GROUP BY 1)
    SELECT k.surface, coalesce(e.gloss, h.gloss, '') AS gloss FROM k LEFT JOIN e ON e.headword = k.surface
    LEFT JOIN h ON h.search_headword = lower(strip_accents(k.surface))""", ("words",))
def two_pass_match(t):
    toks = t.benchmark.select("item_id", F.explode(T.tokens("text")).alias("headword"))
    entries = (toks.groupBy("headword").agg(F.min("item_id").alias("item_id"),
                                            F.min(F.concat(F.col("item_id").cast("string"), F.lit(":"), F.col("headword"))).alias("gloss"))
               .withColumn("search_headword", T.fold("headword")).withColumn("entry_key", F.struct("item_id", "headword")))
    keys = t.words.select("surface").distinct()
    return (Wd.two_pass_match(keys, entries, "surface", T.fold("surface"))
            .select("surface", F.coalesce("gloss", F.lit("")).alias("gloss")))


@query("ag02_concordance_headline", """
    WITH c AS (SELECT search_form, language, surface, count(*) AS n FROM words GROUP BY 1, 2, 3)
    SELECT search_form, CAST(sum(n) AS BIGINT) AS total, arg_min(language, (-n, language, surface)) AS language, arg_min(surface, (-n, language, surface)) AS surface
    FROM c GROUP BY 1""", ("words",))
def concordance_headline(t):
    return Wd.headlines(t.words, "search_form", ["language", "surface"])


_FORMS = """c AS (SELECT search_form, surface, language AS morph, count(*) AS n FROM words GROUP BY 1, 2, 3),
    f AS (SELECT search_form, morph, strip_accents(surface) AS form, CAST(sum(n) AS BIGINT) AS count, arg_min(surface, (-n, surface)) AS surface,
                 count(*) AS n_variants, string_agg(surface || ':' || n, '|' ORDER BY n DESC, surface) AS variants FROM c GROUP BY 1, 2, 3)"""


def _forms(t):
    words = t.words.withColumnRenamed("language", "morph")
    return Wd.group_forms(Wd.spellings(words, "search_form"), "search_form", T.strip_marks("surface"))


@query("ag03_inflected_forms", f"WITH {_FORMS} SELECT search_form, morph, count, surface, n_variants, variants FROM f", ("words",))
def inflected_forms(t):
    joined = F.array_join(F.transform("variants", lambda v: F.concat(v["surface"], F.lit(":"), v["count"].cast("string"))), "|")
    return _forms(t).withColumn("variants", joined)


@query("tk04_capped_forms", f"""WITH {_FORMS} SELECT * FROM (SELECT search_form, surface, morph, count,
    row_number() OVER (PARTITION BY search_form ORDER BY count DESC, surface, morph) AS rank, count(*) OVER (PARTITION BY search_form) AS n_forms,
    count(*) OVER (PARTITION BY search_form) > 3 AS truncated FROM f) WHERE rank <= 3""", ("words",))
def capped_forms(t):
    return Wd.capped_forms(_forms(t).drop("variants", "n_variants"), "search_form", 3).select(
        "search_form", "surface", "morph", "count", "rank", "n_forms", "truncated")


@query("ag04_distribution", f"SELECT search_form, {_BOOK} AS book, count(*) AS n_words, count(DISTINCT addr) AS n_addresses FROM words GROUP BY 1, 2", ("words",))
def distribution(t):
    return Wd.distribution(t.words, "search_form", F.expr("(addr div 1000) div 100"))


@query("ag05_distinct_addresses", "SELECT search_form, count(DISTINCT addr) AS n_addresses FROM words GROUP BY 1", ("words",))
def distinct_addresses(t):
    return t.words.select("search_form", "addr").distinct().groupBy("search_form").agg(F.count(F.lit(1)).alias("n_addresses"))


@query("ag05_distinct_levels", """WITH b AS (SELECT language, (addr // 1000) // 100 AS book, search_form FROM words),
    l AS (SELECT 'book,language' AS level, concat_ws(',', CAST(book AS VARCHAR), coalesce(language, '')) AS key, count(DISTINCT search_form) AS n FROM b GROUP BY book, language
      UNION ALL SELECT 'book', CAST(book AS VARCHAR), count(DISTINCT search_form) FROM b GROUP BY book
      UNION ALL SELECT 'language', coalesce(language, ''), count(DISTINCT search_form) FROM b GROUP BY language
      UNION ALL SELECT '', '', count(DISTINCT search_form) FROM b)
    SELECT level, key, n, true AS within FROM l""", ("words",))
def distinct_levels(t):
    """Distinct forms of every book, language, both and the whole: exact, and whether the stored sketches' estimate keeps four standard errors."""
    words = t.words.select("language", F.expr("(addr div 1000) div 100").alias("book"), "search_form")
    sets = [["book", "language"], ["book"], ["language"], []]
    stored = cut_lineage(D.sketches(words, ["book", "language"], "search_form"))
    n = F.col("n")
    return (D.exact(words, sets, "search_form").join(D.levels(stored, sets), ["level", "key"])
            .select("level", "key", "n", (F.abs(F.col("estimate") - n) <= 4 * D.error() * n + 1).alias("within")))


_SUGGESTED = """g AS (SELECT request, lemma, strongs, language, CAST(sum(n) AS BIGINT) AS count, min(surface) AS surface FROM request_kinds JOIN
      (SELECT strongs, lemma, search_form, language, morph, count(*) AS n, min(surface) AS surface FROM original_words GROUP BY ALL) USING (strongs, lemma, search_form, language, morph)
      GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY count DESC, lemma, strongs, language) AS rank, count(*) OVER (PARTITION BY request) AS total FROM g)"""


@query("ag06_lemma_suggestions", f"WITH {_SUGGESTED} SELECT * FROM top WHERE rank <= 20", ("request_kinds",))
def lemma_suggestions(t):
    return O.suggestions(t.original_words, t.word_requests)


@query("prj09_prefix_filter", "SELECT r.request, w.search_form, count(*) AS n FROM word_requests r JOIN words w ON starts_with(w.search_form, lower(strip_accents(r.query))) GROUP BY 1, 2",
       ("words", "word_requests"))
def prefix_filter(t):
    """How often each form that begins with a request's text occurs."""
    counts = cut_lineage(t.words.groupBy("search_form").agg(F.count(F.lit(1)).alias("n")))
    asked = t.word_requests.select("request", T.fold("query").alias("prefix"))
    ranks, intervals = O.rank_intervals(counts.select(F.col("search_form").alias("form")), asked.select("prefix"))
    begun = S.points_in_ranges(ranks, intervals, "rank", ("low", "high")).select("prefix", F.col("form").alias("search_form"))
    return asked.join(begun, "prefix").join(counts, "search_form").select("request", "search_form", "n")


# Numbered dictionary over lineitem: number = part, homonym letter from the return flag, corpus key from line status.
_NUMBERED = """kw AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE (CASE l_linestatus WHEN 'F' THEN 'H' ELSE 'A' END) || l_partkey
        || (CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN 'a' ELSE 'b' END) END AS strongs FROM lineitem),
    en AS (SELECT 'H' || p_partkey || h AS entry_key, p_partkey AS number, nullif(h, '') AS homonym, p_name AS headword FROM part, (SELECT unnest(['', 'a', 'b', 'c']) AS h)),
    n AS (SELECT 'H' || substr(strongs, 2) AS entry_key, count(*) AS n FROM kw WHERE strongs IS NOT NULL GROUP BY 1)"""


def _numbered(t):
    words = t.lineitem.select(F.when(F.col("l_linenumber") != 7, F.concat(
        F.when(F.col("l_linestatus") == "F", "H").otherwise("A"), F.col("l_partkey").cast("string"),
        F.when(F.col("l_returnflag") == "R", "").when(F.col("l_returnflag") == "A", "a").otherwise("b"))).alias("strongs"))
    entries = t.part.select("p_partkey", "p_name", F.explode(F.array(F.lit(""), F.lit("a"), F.lit("b"), F.lit("c"))).alias("_h")).select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string"), F.col("_h")).alias("entry_key"), F.col("p_partkey").alias("number"),
        F.nullif("_h", F.lit("")).alias("homonym"), F.col("p_name").alias("headword"))
    return words, entries


@query("ag07_homonym_family", f"""WITH {_NUMBERED} SELECT e.entry_key, e.number, coalesce(n.n, 0) AS n,
    row_number() OVER (PARTITION BY e.number ORDER BY e.homonym IS NOT NULL, e.homonym) AS member_no FROM en e LEFT JOIN n ON n.entry_key = e.entry_key""")
def homonym_family(t):
    words, entries = _numbered(t)
    return Wd.families(entries, words).select("entry_key", "number", "n", "member_no")


@query("ag08_key_resolution", f"""WITH {_NUMBERED}, a AS (SELECT number, count(*) AS m FROM en JOIN n USING (entry_key) GROUP BY 1),
    q AS (SELECT DISTINCT (CASE l_linenumber % 4 WHEN 0 THEN 'h' WHEN 1 THEN 'A ' WHEN 2 THEN 'G' ELSE '' END) || l_partkey || (CASE WHEN l_linenumber > 4 THEN ' a' ELSE '' END) AS raw,
          (CASE l_linenumber % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'A' WHEN 2 THEN 'G' ELSE 'H' END) || l_partkey || (CASE WHEN l_linenumber > 4 THEN 'a' ELSE '' END) AS key, l_partkey AS number FROM lineitem)
    SELECT q.raw, q.key, CASE WHEN q.key IN (SELECT strongs FROM kw WHERE strongs IS NOT NULL) THEN 'exact' WHEN a.m > 0 AND q.key NOT LIKE 'G%' THEN 'family' ELSE 'none' END AS kind,
           CASE WHEN q.key IN (SELECT strongs FROM kw WHERE strongs IS NOT NULL) OR q.key LIKE 'G%' THEN 0 ELSE coalesce(a.m, 0) END AS n_members
    FROM q LEFT JOIN a ON a.number = q.number""")
def key_resolution(t):
    words, entries = _numbered(t)
    raw = F.concat(F.when(F.col("l_linenumber") % 4 == 0, "h").when(F.col("l_linenumber") % 4 == 1, "A ")
                   .when(F.col("l_linenumber") % 4 == 2, "G").otherwise(""), F.col("l_partkey").cast("string"),
                   F.when(F.col("l_linenumber") > 4, " a").otherwise(""))
    return Wd.resolve_keys(t.lineitem.select(raw.alias("raw")).distinct(), entries, words)


@query("fn07_head_lemma_key", """
    SELECT l_orderkey AS k, l_linenumber AS n, (CASE l_linestatus WHEN 'F' THEN 'A' ELSE 'H' END) || l_partkey || (CASE l_returnflag WHEN 'R' THEN 'a' ELSE '' END) AS key, l_suppkey AS s FROM lineitem""")
def head_lemma_key(t):
    lemma = F.concat(F.lit("c/d/"), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", " a").otherwise(""))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
                             Wd.head_lemma_key(lemma, F.when(F.col("l_linestatus") == "F", "arc").otherwise("hbo")).alias("key"),
                             F.col("l_suppkey").alias("s"))


@query("fn08_dictionary_key", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '' ELSE 'H' || p_partkey || (CASE WHEN p_size > 25 THEN 'c' ELSE '' END) END AS key FROM part""")
def dictionary_key(t):
    raw = F.concat(F.when(F.col("p_size") % 3 == 0, " a").when(F.col("p_size") % 3 == 1, "H0").otherwise("G"),
                   F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, "C ").otherwise(""))
    return t.part.select("p_partkey", F.coalesce(Wd.lexicon_key(raw), F.lit("")).alias("key"))


@query("jn20_dictionary_merge", """
    SELECT coalesce(b.headword, i.headword) AS entry_key, CASE WHEN coalesce(i.gloss, '') <> '' THEN i.gloss ELSE coalesce(b.gloss, '') END AS gloss,
           coalesce('uses ' || b.n_uses, '') AS meaning,
           CASE WHEN b.headword IS NULL THEN 'index' WHEN i.headword IS NULL THEN 'base' ELSE 'base+index' END AS provenance
    FROM lexicon b FULL OUTER JOIN lexicon2 i ON i.headword = b.headword""", ("lexicon", "lexicon2"))
def dictionary_merge(t):
    base = t.lexicon.select(F.col("headword").alias("entry_key"), "headword", "gloss", F.concat(F.lit("uses "), F.col("n_uses").cast("string")).alias("meaning"))
    index = t.lexicon2.select(F.col("headword").alias("entry_key"), "headword", "gloss")
    return Wd.merge_dictionaries(base, index).select("entry_key", "gloss", "meaning", "provenance")


@query("ag20_dictionary_coverage", """
    WITH c AS (SELECT search_form, count(*) AS n, search_form IN (SELECT headword FROM lexicon) AS hit FROM words GROUP BY 1)
    SELECT count(*) AS n_keys, count(*) FILTER (hit) AS keys_found, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n) FILTER (hit) AS BIGINT) AS tokens_found,
           round(count(*) FILTER (hit) * 100 / count(*), 4) AS key_pct, round(CAST(sum(n) FILTER (hit) AS DOUBLE) * 100 / CAST(sum(n) AS DOUBLE), 4) AS token_pct FROM c""", ("words", "lexicon"))
def dictionary_coverage(t):
    return Wd.dictionary_coverage(t.words, t.lexicon)


@query("tk08_worst_unresolved", """
    SELECT search_form AS headword, count(*) AS n FROM words WHERE search_form NOT IN (SELECT headword FROM lexicon) GROUP BY 1 ORDER BY n DESC, headword LIMIT 20""", ("words", "lexicon"))
def worst_unresolved(t):
    return Wd.worst_unresolved(t.words, t.lexicon)


@query("wn01_first_match", """
    SELECT language, addr, position, surface FROM (SELECT language, addr, position, surface, row_number() OVER (PARTITION BY language, addr ORDER BY position) AS rn
    FROM words WHERE search_form IN (SELECT headword FROM lexicon)) WHERE rn = 1""", ("words", "lexicon"))
def first_match(t):
    """The first word of every address that the dictionary has."""
    known = t.lexicon.select(F.col("headword").alias("search_form"))
    hits = t.words.join(known, "search_form", "left_semi").select("language", "addr", "position", "surface")
    return Wd.first_match(hits, ["language", "addr"])


@query("wn03_word_positions", """
    SELECT edition, addr, doc_id, src_pos, row_number() OVER (PARTITION BY edition, addr ORDER BY doc_id, src_pos) AS position, surface
    FROM (SELECT edition, addr, doc_id, unnest(t) AS surface, unnest(range(1, len(t) + 1)) AS src_pos
          FROM (SELECT edition, addr, doc_id, regexp_extract_all(line, '[\\p{L}\\p{N}]+') AS t FROM source_lines))""", ("source_lines",))
def word_positions(t):
    """One word sequence per address, continued across the source units that meet there.

    The offset of a source unit is the word count of the units before it, so
    only unit lengths are ordered, never the words.
    """
    from pyspark.sql import Window as W
    units = t.source_lines.select("edition", "addr", "doc_id", T.tokens("line").alias("_t"))
    before = F.coalesce(F.sum(F.size("_t")).over(W.partitionBy("edition", "addr").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (units.withColumn("_off", before).select("edition", "addr", "doc_id", "_off", F.posexplode("_t").alias("_p", "surface"))
            .select("edition", "addr", "doc_id", (F.col("_p") + 1).cast("bigint").alias("src_pos"),
                    (F.col("_off") + F.col("_p") + 1).cast("bigint").alias("position"), "surface"))


@query("ag32_language_composition", """
    SELECT addr // 100000 AS scope, language, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY addr // 100000), 4) AS pct
    FROM words GROUP BY 1, 2""", ("words",))
def language_composition(t):
    from pyspark.sql import Window as W
    cells = t.words.groupBy(F.expr("addr div 100000").alias("scope"), "language").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy("scope")), 4))


@query("st06_concordance_keys", "SELECT DISTINCT coalesce(nullif(search_form, 'the'), surface) AS key FROM words", ("words",))
def concordance_keys(t):
    key = F.coalesce(F.nullif("search_form", F.lit("the")), F.col("surface"))
    return t.words.select(key.alias("key")).where(F.col("key").isNotNull() & (F.col("key") != "")).distinct()


_ORIGINAL = """h AS MATERIALIZED (SELECT request, addr, min(position) AS position, count(*) AS n_words, arg_min((surface, strongs, lemma, search_form, language, morph), position) AS f
      FROM original_words JOIN request_kinds USING (strongs, lemma, search_form, language, morph) GROUP BY 1, 2)"""


@query("tx06_original_search", f"""WITH {_ORIGINAL} SELECT request, addr, position, n_words, f.surface, f.strongs, f.lemma, f.search_form, f.language, f.morph FROM
    (SELECT request, addr, position, n_words, {{'surface': f[1], 'strongs': f[2], 'lemma': f[3], 'search_form': f[4], 'language': f[5], 'morph': f[6]}} AS f FROM h)""", ("request_kinds",))
def original_search(t):
    """Every request's addresses with the first word that matches at each."""
    return O.search(t.original_words, t.word_requests)


@query("tx06_original_page", f"""WITH {_ORIGINAL} SELECT * FROM (SELECT request, addr, position, row_number() OVER (PARTITION BY request ORDER BY addr) AS rank FROM h) WHERE rank BETWEEN 11 AND 20""",
       ("request_kinds",))
def original_page(t):
    return O.page(O.search(t.original_words, t.word_requests), 10, 10).select("request", "addr", "position", "rank")


@query("tx06_original_totals", f"WITH {_ORIGINAL} SELECT request, count(*) AS total FROM h GROUP BY 1", ("request_kinds",))
def original_totals(t):
    return O.totals(O.search(t.original_words, t.word_requests), F.expr("(addr div 1000) div 100"))[0]


@query("tx06_original_distribution", f"WITH {_ORIGINAL} SELECT request, {_BOOK} AS book, count(*) AS n FROM h GROUP BY 1, 2", ("request_kinds",))
def original_distribution(t):
    return O.totals(O.search(t.original_words, t.word_requests), F.expr("(addr div 1000) div 100"))[1]


@query("tx07_suggestion_glosses", f"""WITH {_SUGGESTED}, e AS (SELECT 'H' || entry_no AS strongs, arg_min(headword, headword) AS headword, arg_min(gloss, headword) AS gloss FROM lexicon GROUP BY 1)
    SELECT top.*, coalesce(e.headword, '') AS headword, coalesce(e.gloss, '') AS gloss FROM top LEFT JOIN e ON e.strongs = top.strongs WHERE rank <= 5""", ("request_kinds", "lexicon"))
def suggestion_glosses(t):
    entries = (t.lexicon.groupBy(F.concat(F.lit("H"), F.col("entry_no").cast("string")).alias("strongs"))
               .agg(F.min("headword").alias("headword"), F.min_by("gloss", "headword").alias("gloss")))
    return O.suggestions(t.original_words, t.word_requests, 5).join(entries, "strongs", "left").fillna("", ["headword", "gloss"])


@query("tx09_occurrences", """
    SELECT r.request, w.addr, w.position, w.surface, w.morph, w.language FROM word_requests r JOIN original_words w ON w.strongs = r.key""", ("original_words", "word_requests"))
def occurrences(t):
    """Every occurrence of the dictionary numbers asked for."""
    keys = O.parse_requests(t.word_requests).where("key is not null").select("request", F.col("key").alias("strongs"))
    return t.original_words.join(keys, "strongs").select("request", "addr", "position", "surface", "morph", "language")


@query("fn05_search_folding", "SELECT addr, position, search_form FROM words WHERE surface <> search_form", ("words",))
def search_folding(t):
    return t.words.where("surface <> search_form").select("addr", "position", "search_form")
