"""Set-at-a-time passage reads: the request key is a DataFrame of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import space as S


def in_ranges(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Units inside each requested range."""
    return S.points_in_ranges(units, requests, "addr", ("q_start", "q_end"))


def in_chapters(units: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for ranges known to lie within one chapter: join on the chapter key, then trim."""
    u = units.withColumn("_ch", F.expr("addr div 1000"))
    r = requests.withColumn("_ch", F.expr("q_start div 1000"))
    return u.join(r, "_ch").where(F.col("addr").between(F.col("q_start"), F.col("q_end"))).drop("_ch")


def opening(units: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The first ``limit`` units per key."""
    order = W.partitionBy(*key).orderBy("addr")
    return (units.withColumn("rank", F.row_number().over(order).cast("bigint"))
            .where(F.col("rank") <= limit))


def pages(positioned: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """(req, addr): the rows of each asked page; ``requests`` is req, offset, limit.

    Offsets start at 0 and limits lie between 1 and ``most``, whatever is asked.  Rows are found by their position, so a
    late page costs no more than the first.
    """
    start = F.greatest(F.col("offset"), F.lit(0).cast("bigint"))
    size = F.least(F.greatest(F.col("limit"), F.lit(1).cast("bigint")), F.lit(most).cast("bigint"))
    wanted = requests.select("req", F.explode(F.sequence(start, start + size - 1)).alias("pos"))
    return wanted.join(positioned.select("pos", "addr"), "pos").select("req", "addr")


def with_chapter_headings(items: DataFrame, partition: list[str], chapter: str, order: list[str]) -> DataFrame:
    """Flag the first item of every run of one chapter."""
    prev = F.lag(chapter).over(W.partitionBy(*partition).orderBy(*order))
    return items.withColumn("heading", prev.isNull() | (prev != F.col(chapter)))


def chapter_summary(space: DataFrame) -> DataFrame:
    return space.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n_units"),
                                                F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"))


def book_flags(space: DataFrame) -> DataFrame:
    """Per collection: prologue slot present, last chapter, distinct chapters."""
    return space.groupBy("book").agg(
        F.coalesce(F.bool_or((F.col("chapter") == 1) & (F.col("unit") == 0)), F.lit(False)).alias("has_prologue"),
        F.max("chapter").alias("last_chapter"), F.min("chapter").alias("first_chapter"),
        F.countDistinct("chapter").alias("n_chapters"), F.count(F.lit(1)).alias("n_units"))
