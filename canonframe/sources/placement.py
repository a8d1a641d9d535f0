"""Source numbering to addresses, welds, artifacts: exceptions first, nothing silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T


def resolve_scheme(refs: DataFrame, scheme_map: DataFrame, space: DataFrame, source: str) -> DataFrame:
    """Address by scheme map, else by identity where that address is real, else unresolved.

    ``refs`` has the packed ``source`` address; ``scheme_map``: source, target, mapping.
    """
    m = scheme_map.select(F.col("source").alias(source), F.col("target").alias("_t"), "mapping")
    ident = space.select(F.col("addr").alias(source)).withColumn("_real", F.lit(True))
    return (refs.join(m, source, "left").join(ident, source, "left")
            .withColumn("addr", F.coalesce("_t", F.when(F.col("_real"), F.col(source))))
            .withColumn("how", F.when(F.col("_t").isNotNull(), "map").when(F.col("_real"), "identity").otherwise("unresolved"))
            .drop("_t", "_real"))


def apply_offsets(units: DataFrame, offsets: DataFrame) -> DataFrame:
    """Unit in [from, to] of a chapter -> canonical chapter and first + delta; others unchanged.

    ``offsets``: book, chapter, from_unit, to_unit, to_chapter, first_unit.  The
    equi-join is on the chapter, the ranges are a filter on its few entries.
    """
    o = offsets.select("book", "chapter", "from_unit", "to_unit", "to_chapter", "first_unit")
    hit = (F.col("unit") >= F.col("from_unit")) & (F.col("unit") <= F.col("to_unit"))
    u = units.alias("u").join(o.alias("o"), [F.col("u.book") == F.col("o.book"), F.col("u.chapter") == F.col("o.chapter"), hit], "left")
    cols = [F.col(f"u.{c}") for c in units.columns if c not in ("chapter", "unit")]
    return u.select(*cols, F.col("u.chapter").alias("src_chapter"), F.col("u.unit").alias("src_unit"),
                    F.coalesce("o.to_chapter", "u.chapter").alias("chapter"),
                    F.coalesce(F.col("o.first_unit") + F.col("u.unit") - F.col("o.from_unit"), F.col("u.unit")).alias("unit"))


def place_units(units: DataFrame, explicit: DataFrame, unplaced: DataFrame, identity: DataFrame) -> DataFrame:
    """placed / excluded / unplaced per source unit: reviewed unplaced list, explicit table, identity book."""
    keys = ["code", "chapter", "unit"]
    e = explicit.select(*keys, F.col("addr").alias("_e"))
    n = unplaced.select(*keys).withColumn("_un", F.lit(True))
    i = identity.select("code", F.col("book").alias("_book"))
    d = units.join(n, keys, "left").join(e, keys, "left").join(i, "code", "left")
    addr = F.when(F.col("_un"), F.lit(None)).otherwise(
        F.coalesce("_e", F.col("_book") * 1_000_000 + F.col("chapter") * 1_000 + F.col("unit")))
    status = (F.when(F.col("_un"), "unplaced").when(F.col("_e").isNotNull() | F.col("_book").isNotNull(), "placed").otherwise("excluded"))
    return d.withColumn("addr", addr.cast("bigint")).withColumn("status", status).drop("_un", "_e", "_book")


def assemble(placed: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Units that meet on one address are joined in source order."""
    entry = F.struct(*order, text)
    return placed.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s[text]), " ").alias(text),
        F.count(F.lit(1)).alias("n_sources"))


def banded(units: DataFrame, bands: DataFrame) -> DataFrame:
    """Labelled parts to chapter numbers (part -> +100, +200); an unknown part is an error row."""
    d = units.join(bands, "part", "left")
    n = F.regexp_extract("ref", r"^(\d+)", 1).try_cast("bigint")
    return (d.withColumn("chapter", F.col("offset") + n)
            .withColumn("error", F.when(F.col("offset").isNull(), "unknown part").when(F.coalesce(n, F.lit(0)) < 1, "bad number"))
            .drop("offset"))


def split_welded(units: DataFrame, anchors: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cut a text at ordered anchors: key, piece, text, error.

    ``anchors``: key, seq (from 1), anchor.  Every anchor must occur once, in
    order, and leave no empty piece.
    """
    j = units.join(anchors, key)
    at = F.expr(f"locate(anchor, `{text}`)").cast("bigint")
    again = F.expr(f"locate(anchor, `{text}`, locate(anchor, `{text}`) + 1)")
    j = j.select(key, text, "seq", at.alias("_at"), again.alias("_again"))
    order = W.partitionBy(key).orderBy("seq")
    j = j.withColumn("_next", F.lead("_at").over(order))
    bad = (F.when((F.col("_at") == 0) | (F.col("_again") > 0), "anchor must occur exactly once")
           .when(F.col("_next") <= F.col("_at"), "anchors out of order"))
    j = j.withColumn("_bad", bad)
    stop = F.coalesce("_next", F.length(text) + 1)
    tails = j.select(key, F.col("seq").cast("bigint").alias("piece"), F.col(text).substr(F.col("_at").cast("int"), F.greatest((stop - F.col("_at")).cast("int"), F.lit(0))).alias("text"), "_bad")
    heads = j.where("seq = 1").select(key, F.lit(0).cast("bigint").alias("piece"), F.col(text).substr(F.lit(1), F.greatest((F.col("_at") - 1).cast("int"), F.lit(0))).alias("text"), F.lit(None).cast("string").alias("_bad"))
    rows = heads.unionByName(tails)
    errors = j.groupBy(key).agg(F.min("_bad").alias("error"))
    rows = rows.drop("_bad").join(errors, key)
    return rows.withColumn("error", F.coalesce("error", F.when(F.trim("text") == "", "empty piece")))


# What a leaked note or marker looks like.
RESIDUE = r"(/f\s*\+|/f\*|\\[a-z]+\*?)"
WELDED = r"(\S*[a-z][.,;:!?][A-Za-z]\S*)"


def text_artifacts(units: DataFrame, keys: list[str], vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(keys, kind, detail) of empty texts, markup residue, welded punctuation and welded words.

    Welded words are decided once per distinct unknown word: a lower-case word
    of 7 or more letters that is unknown while both halves (3 or more letters)
    are known; the shortest head wins.
    """
    u = units.select(*keys, F.col(text).alias("_x"))
    empty = u.where(F.trim("_x") == "").select(*keys, F.lit("empty").alias("kind"), F.lit("text is empty").alias("detail"))
    full = u.where(F.trim("_x") != "")

    def pattern(name: str, pat: str) -> DataFrame:
        found = F.regexp_extract_all("_x", F.lit(pat), 1)
        return full.select(*keys, F.lit(name).alias("kind"), F.array_join(found, " ").alias("detail")).where("detail <> ''")
    words = full.select(*keys, F.explode(F.regexp_extract_all("_x", F.lit("([A-Za-z]+)"), 1)).alias("word"))
    words = words.where(F.col("word").rlike("^[a-z]") & (F.length("word") >= 7))
    known = vocabulary.select(F.col("word").alias("_w")).distinct()
    suspects = words.select(F.lower("word").alias("low")).distinct().join(known, F.col("low") == F.col("_w"), "left_anti")
    cuts = suspects.select("low", F.explode(F.sequence(F.lit(3), F.length("low") - 3)).alias("cut")).select(
        "low", "cut", F.expr("substring(low, 1, cut)").alias("head"), F.expr("substring(low, cut + 1)").alias("tail"))
    welded = (cuts.join(known.withColumnRenamed("_w", "head"), "head", "left_semi").join(known.withColumnRenamed("_w", "tail"), "tail", "left_semi")
              .groupBy("low").agg(F.min(F.struct("cut", "head", "tail")).alias("_s"))
              .select("low", F.concat(F.col("_s.head"), F.lit(" "), F.col("_s.tail")).alias("_fix")))
    hits = words.withColumn("low", F.lower("word")).join(welded, "low").select(
        *keys, F.lit("welded-words").alias("kind"), F.concat("word", F.lit(" -> "), "_fix").alias("detail"))
    return empty.unionByName(pattern("markup-residue", RESIDUE)).unionByName(pattern("welded-punctuation", WELDED)).unionByName(hits)
