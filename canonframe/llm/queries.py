"""The registered queries of this package; ``ORACLES`` holds SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import linked_classes
    return linked_classes(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .pieces import digests
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_token_output")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .huffman import read_tokens, write_tokens
    path = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, digest_only=True)


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _url_rules_sql() -> str:
    """The rules as SQL: longest first."""
    def fits(rule):
        host, path = rule.split("/", 1)
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"
    ranked = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ranked)
    verdict = " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in ranked)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS r
              FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN instr(r, '/') > 0 THEN substr(r, instr(r, '/')) ELSE '' END AS path FROM rest)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""


@query("op6_url_rules", _url_rules_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import Rule, judge
    return judge(table(spark, sf_dir, "pages"), [Rule(v, t) for v, t in URL_RULES])


# fixed values of the contract: one query in a hundred, ten answers
@query("op10_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, search
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_licences")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source tree: thousand / hundred / ten / file; every tenth file is its directory's LICENSE."""
    from pyspark.sql import functions as F
    from .licences import scan
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"),
                       F.expr("cast(doc_id div 10 as string)"), name)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")


TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 60}},
               "required": ["query", "limit"], "additionalProperties": False},
    "fetch": {"properties": {"id": {"type": "integer"}, "fresh": {"type": "boolean"}}, "required": ["id", "fresh"]},
    "convert": {"properties": {"unit": {"type": "string", "enum": ["km", "mi"]}, "value": {"type": "number"}}, "required": ["unit"]},
}


# Assistant turns are calls, the turns after them results; which tool and arguments follow from the text's words.
_TOOL_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, len(string_split(text, ' ')) AS n, string_split(text, ' ')[1] AS w FROM conversations),
raw AS (SELECT conv_id, concat('c', conv_id, '-', turn) AS call_id, turn, n, w, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'fetch' ELSE 'convert' END AS name,
        CASE WHEN turn >= 2 THEN concat('c', conv_id, '-', turn - 2) END AS ref FROM t WHERE role = 'assistant'),
args AS (SELECT *, n % 17 = 0 AS broken,
  CASE name WHEN 'search' THEN concat('{"limit":', n, ',"query":', to_json(w), '}') WHEN 'fetch' THEN concat('{"fresh":', CASE WHEN n % 2 = 0 THEN 'true' ELSE 'null' END, ',"id":', conv_id, '}')
       ELSE concat('{"unit":"', CASE n % 4 WHEN 0 THEN 'km' WHEN 1 THEN 'mi' ELSE 'ft' END, '","value":', n, '.5}') END AS canonical FROM raw),
lev AS (SELECT a.conv_id, a.call_id, 0 AS level FROM args a LEFT JOIN args b ON a.conv_id = b.conv_id AND a.ref = b.call_id WHERE b.call_id IS NULL
        UNION ALL SELECT a.conv_id, a.call_id, l.level + 1 FROM args a JOIN lev l ON a.conv_id = l.conv_id AND a.ref = l.call_id),
calls AS (SELECT a.conv_id, a.call_id, a.turn AS call_turn, lev.level, concat_ws('; ',
    CASE WHEN a.broken THEN 'arguments are not an object' WHEN a.name = 'search' AND a.n > 60 THEN 'limit is beyond its maximum'
         WHEN a.name = 'fetch' AND a.n % 2 = 1 THEN 'fresh is not boolean' WHEN a.name = 'convert' AND a.n % 4 > 1 THEN 'unit is not allowed' END,
    CASE WHEN a.ref IS NOT NULL AND b.call_id IS NULL THEN concat('refers to unknown ', a.ref) END) AS problems,
    concat('{"arguments":', CASE WHEN a.broken THEN 'null' ELSE a.canonical END, ',"id":"', a.call_id, '","name":"', a.name, '"}') AS call_json
  FROM args a JOIN lev ON a.call_id = lev.call_id AND a.conv_id = lev.conv_id LEFT JOIN args b ON a.conv_id = b.conv_id AND a.ref = b.call_id),
results AS (SELECT conv_id, concat('c', conv_id, '-', turn - 1) AS call_id, turn AS result_turn,
  concat('{"content":', to_json(text), ',"id":"c', conv_id, '-', turn - 1, '"}') AS result_json FROM t WHERE role = 'user' AND turn > 0)
SELECT r.conv_id, r.call_id, call_turn, level, result_turn, CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'answered' END AS status, problems, call_json, result_json
FROM results r LEFT JOIN calls c ON r.conv_id = c.conv_id AND r.call_id = c.call_id
UNION ALL SELECT conv_id, call_id, call_turn, level, NULL, 'unanswered', problems, call_json, NULL FROM calls c
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id)"""


@query("op7_tool_calls", _TOOL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as tool use: assistant turns call, the user turn after each answers."""
    from pyspark.sql import functions as F
    from .toolcalls import link
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.size(F.split("text", " ")).alias("n"),
                                                         F.element_at(F.split("text", " "), 1).alias("w"))
    number = F.col("n").cast("string")
    conv = F.col("conv_id").cast("string")
    query_json = F.regexp_replace(F.to_json(F.struct(F.col("w").alias("query"))), r"\}$", "")
    arguments = (F.when(F.expr("n % 3 = 0"), F.concat(query_json, F.lit(', "limit" : '), number, F.lit(" }")))
                 .when(F.expr("n % 3 = 1"), F.concat(F.lit('{ "id": '), conv, F.lit(', "fresh": '), F.when(F.expr("n % 2 = 0"), "true").otherwise("null"), F.lit("}")))
                 .otherwise(F.concat(F.lit('{"value": '), number, F.lit('.50, "unit": "'),
                                     F.when(F.expr("n % 4 = 0"), "km").when(F.expr("n % 4 = 1"), "mi").otherwise("ft"), F.lit('"}'))))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string")).alias("call_id"), "turn",
        F.when(F.expr("n % 3 = 0"), "search").when(F.expr("n % 3 = 1"), "fetch").otherwise("convert").alias("name"),
        F.when(F.expr("n % 17 = 0"), F.regexp_replace(arguments, r"\}$", "")).otherwise(arguments).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(F.concat(F.lit("c"), conv, F.lit("-"), (F.col("turn") - 2).cast("string")))).alias("after"))
    results = turns.where("role = 'user' and turn > 0").select(
        "conv_id", F.concat(F.lit("c"), conv, F.lit("-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return link(calls, results, TOOLS)


# Levels by recursion; crc32 bit by bit (e >= 0: a byte is taken in, else one bit leaves).
_MANIFEST_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, source, text, row_number() OVER () AS rn, concat_ws('', coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'),
    coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head FROM documents),
h AS (SELECT *, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(head, coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-'))) AS cut,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END) % 2 = 1 AS even FROM t),
l AS (SELECT *, coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n, CASE WHEN even THEN cut ELSE leaf END AS tampered FROM h),
up(k, tree, idx, n, h) AS (SELECT 0, tree, idx, n, leaf FROM l
    UNION ALL SELECT k + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY k, tree, idx // 3, n),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top(k, idx, n, h) AS (SELECT 0, idx, n, h FROM s
    UNION ALL SELECT k + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY k, idx // 3, n),
runs AS (SELECT k, tree, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM up WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT k, NULL, idx // 3, list(h ORDER BY idx) FROM top WHERE n > 1 GROUP BY ALL),
f(rn, k, tree, idx, n, h, p) AS (SELECT rn, 0, tree, idx, n, tampered, '' FROM l
    UNION ALL SELECT f.rn, f.k + 1, f.tree, f.idx // 3, (f.n + 2) // 3,
      sha256(array_to_string(list_concat(hs[:f.idx % 3], [f.h], hs[f.idx % 3 + 2:]), '')), f.p || array_to_string(list_concat(hs[:f.idx % 3], hs[f.idx % 3 + 2:]), '')
      FROM f JOIN runs r ON r.k = f.k AND r.tree = f.tree AND r.run = f.idx // 3 WHERE f.n > 1),
g(rn, k, idx, n, h, p) AS (SELECT f.rn, 0, s.idx, s.n, f.h, f.p FROM f JOIN s ON s.tree = f.tree WHERE f.n = 1
    UNION ALL SELECT g.rn, g.k + 1, g.idx // 3, (g.n + 2) // 3,
      sha256(array_to_string(list_concat(hs[:g.idx % 3], [g.h], hs[g.idx % 3 + 2:]), '')), g.p || array_to_string(list_concat(hs[:g.idx % 3], hs[g.idx % 3 + 2:]), '')
      FROM g JOIN runs r ON r.k = g.k AND r.tree IS NULL AND r.run = g.idx // 3 WHERE g.n > 1),
a AS (SELECT h FROM top WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, a.h AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = a.h AS verified
FROM l JOIN s ON s.tree = l.tree JOIN g ON g.rn = l.rn AND g.n = 1 CROSS JOIN a"""


@query("op11_merkle_manifest", _MANIFEST_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every document whose decimal doc_id has an even crc32 is checked without its line feeds."""
    from pyspark.sql import functions as F
    from .merkle import fold, leaf, proof, proofs
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, leaf(*columns[:-1], F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf(*columns))
    found = proofs(table(spark, sf_dir, "documents").withColumn("tampered", changed), columns, keep=("tampered",))
    return (found.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round as a table of (cluster, components); the smaller number wins ties."""
    def assigned(r: int) -> str:
        return (f"SELECT rn, c.c AS cluster, list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{r} c "
                "QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, cluster) = 1")
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({assigned(r)}),
s{r} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (rn) CROSS JOIN range(1, 65) AS g(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS cv FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.cv, c.cv) AS cv FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.c)""")
    steps = ",\n".join(steps)
    return f"""
WITH w AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS rn FROM w),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v AS cv FROM v ORDER BY c LIMIT {k}),
{steps},
f AS MATERIALIZED ({assigned(rounds)})
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM f JOIN v USING (rn) JOIN c{rounds} c ON c.c = f.cluster"""


@query("op13_centroids", _clusters_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster, integer_vectors, report
    return report(*cluster(integer_vectors(table(spark, sf_dir, "embeddings")), 40, 5, "2:"))


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import without_repeats
    return without_repeats(table(spark, sf_dir, "documents"))
