"""Who prints what: coverage, omissions, gaps, censuses, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def grid(books: DataFrame, editions: DataFrame) -> DataFrame:
    """Every collection with every edition: the two dimension tables, not the texts.

    The editions come as one scalar subquery and are exploded over the collections; nothing goes through the driver.
    """
    names = editions.select(F.array_sort(F.collect_set("edition"))).scalar()
    return books.withColumn("_editions", names).withColumn("edition", F.explode("_editions")).drop("_editions")


def coverage_matrix(texts: DataFrame, editions: DataFrame, books: DataFrame) -> DataFrame:
    """Every edition x every collection -> printed / out_of_scope."""
    printed = texts.select("edition", "book").distinct().withColumn("_hit", F.lit(True))
    return (grid(books.select("book"), editions).join(printed, ["edition", "book"], "left")
            .select("edition", "book", F.when(F.col("_hit"), "printed").otherwise("out_of_scope").alias("status")))


def in_scope(scope: Column, testament: Column) -> Column:
    """Collections outside the two testaments are in scope of every edition."""
    return (testament == "DC") | (scope == "all") | (scope == testament)


def available(texts: DataFrame, omissions: DataFrame) -> DataFrame:
    """(edition, addr) with text or a recorded omission."""
    return texts.select("edition", "addr").union(omissions.select("edition", "addr")).distinct()


def unexplained_gaps(canon: DataFrame, texts: DataFrame, omissions: DataFrame, editions: DataFrame,
                     books: DataFrame) -> DataFrame:
    """(edition, addr) in a printed, in-scope collection with neither text nor omission.

    Works on one set of editions per address instead of the edition x address
    product: the sets are bounded by the number of editions.
    """
    printed = (texts.select("edition", "book").distinct()
               .join(editions.select("edition", "scope"), "edition").join(books.select("book", "testament"), "book")
               .where(in_scope(F.col("scope"), F.col("testament"))))
    expected = printed.groupBy("book").agg(F.collect_set("edition").alias("_want"))
    have = (texts.select("edition", "addr").unionByName(omissions.select("edition", "addr"))
            .groupBy("addr").agg(F.collect_set("edition").alias("_have")))
    rows = canon.join(expected, "book").join(have, "addr", "left")
    missing = F.array_except("_want", F.coalesce("_have", F.array().cast("array<string>")))
    return rows.select("addr", "book", F.explode(missing).alias("edition"))


# Fixed values of the omission kinds.
OMISSION_KINDS = ("critical-text", "versification", "coverage", "unexplained")


def classify_omission(testament: Column, reviewed: Column, scheme: Column, default_scheme: str = "org") -> Column:
    """Why an address has no text: outside collection, reviewed list, own numbering, else unexplained."""
    return (F.when(testament == "DC", "versification").when(reviewed, "critical-text")
            .when((F.coalesce(scheme, F.lit(default_scheme)) != default_scheme) & (testament == "OT"), "versification")
            .otherwise("unexplained"))


def omission_index(omissions: DataFrame, texts: DataFrame, editions: DataFrame) -> DataFrame:
    """One row per (address, kind): who omits it, and the first edition that does print it."""
    named = omissions.join(editions.select("edition", "edition_no", "licensed"), "edition").where("licensed")
    grouped = named.groupBy("addr", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("edition_no", "edition"))),
                                 lambda s: s["edition"]), ",").alias("omitted_by"),
        F.min("reason").alias("reason"))
    wanted = omissions.select("addr").distinct()
    printers = (texts.join(wanted, "addr", "left_semi").join(editions.where("licensed"), "edition")
                .groupBy("addr").agg(F.min_by("edition", "edition_no").alias("printed_by")))
    return grouped.join(printers, "addr", "left")


def census(texts: DataFrame, omissions: DataFrame, editions: DataFrame) -> DataFrame:
    """Printed, omitted and distinct collections per edition, aggregated apart and joined."""
    zero = F.lit(0).cast("bigint")
    printed = texts.groupBy("edition").agg(F.count(F.lit(1)).alias("printed"), F.countDistinct("book").alias("books"))
    omitted = omissions.groupBy("edition").agg(F.count(F.lit(1)).alias("omitted"))
    return (editions.select("edition").join(printed, "edition", "left").join(omitted, "edition", "left")
            .select("edition", F.coalesce("printed", zero).alias("printed"),
                    F.coalesce("omitted", zero).alias("omitted"), F.coalesce("books", zero).alias("books")))


def two_way_difference(found: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on one side only: ``unexpected`` (found, not reviewed) and ``missing`` (reviewed, not found)."""
    f, r = found.select(*keys).distinct(), reviewed.select(*keys).distinct()
    return (f.join(r, keys, "left_anti").withColumn("side", F.lit("unexpected"))
            .unionByName(r.join(f, keys, "left_anti").withColumn("side", F.lit("missing"))))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken_sequences(df: DataFrame, keys: list[str], position: str, first: int = 1) -> DataFrame:
    """Groups whose positions are not first..first+n-1 without gap or repeat.

    The distinct count is taken over an already deduplicated pair, so a group
    with most of the rows is reduced before it meets in one task.
    """
    pairs = df.groupBy(*keys, position).agg(F.count(F.lit(1)).alias("_c"))
    stats = pairs.groupBy(*keys).agg(F.min(position).alias("lo"), F.max(position).alias("hi"),
                                     F.count(F.lit(1)).alias("n_distinct"), F.sum("_c").alias("n"))
    return stats.where((F.col("lo") != first) | (F.col("hi") != F.col("n") + first - 1)
                       | (F.col("n_distinct") != F.col("n")))


def first_wins(df: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(kept, collisions): the first row per key in source order, and every later one for the report."""
    ranked = df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.where("nth = 1").drop("nth"), ranked.where("nth > 1")


def build_space(reference: DataFrame, extras: DataFrame, outside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(space, rejected extras).  An extra must be new and inside an existing chapter."""
    base = reference.select("addr").distinct()
    chapters = base.select(F.expr("addr div 1000").alias("_ch")).distinct()
    ex = extras.select("addr").distinct().withColumn("_ch", F.expr("addr div 1000"))
    present = ex.join(base, "addr", "left_semi").select("addr", F.lit("already present").alias("reason"))
    new = ex.join(base, "addr", "left_anti")
    homeless = new.join(chapters, "_ch", "left_anti").select("addr", F.lit("no such chapter").alias("reason"))
    good = new.join(chapters, "_ch", "left_semi").select("addr")
    return base.union(good).union(outside.select("addr")).distinct(), present.unionByName(homeless)
