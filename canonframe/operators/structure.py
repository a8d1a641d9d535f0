"""Structure rules of divided texts: units inside their parents, siblings apart, initials as declared.

Each function returns the violating rows.  Ranges are inclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import space as S


def outside_parents(units: DataFrame, parents: DataFrame) -> DataFrame:
    """Units that lack a parent, are reversed or reach beyond their parent.

    ``units``: parent, start, end; ``parents``: parent, p_start, p_end, one row a parent.
    """
    inside = (F.col("start") >= F.col("p_start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("p_end"))
    return units.join(parents.select("parent", "p_start", "p_end"), "parent", "left").where(~F.coalesce(inside, F.lit(False)))


def overlapping_siblings(units: DataFrame, block: int = 4096) -> DataFrame:
    """(parent, start, n): places where a unit begins although one of the same parent before it is open, or where ``n`` > 1 begin.

    One ordered sweep per block of places; the greatest open end is carried from block to block, so a parent may hold any number of units.
    """
    places = units.where("start IS NOT NULL AND end IS NOT NULL").groupBy("parent", "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
    # a place is asked before its own units open: even order asks, odd order opens
    sweep = (places.select("parent", (F.col("start") * 2).alias("at"), F.lit(None).cast("bigint").alias("opened"), "start", "n")
             .unionByName(places.select("parent", (F.col("start") * 2 + 1).alias("at"), F.col("end").cast("bigint").alias("opened"), "start", F.lit(0).cast("bigint").alias("n"))))
    swept = S.running(sweep, "at", F.expr(f"floor(start / {block})"), {"open_end": ("max", "opened")}, ["parent"])
    return swept.where((F.col("n") > 0) & ((F.col("n") > 1) | F.coalesce(F.col("open_end") >= F.col("start"), F.lit(False)))).select("parent", "start", "n")


def initial_breaks(declared: DataFrame, words: DataFrame) -> DataFrame:
    """(addr, initial, found): units whose first word does not begin with the declared initial; found is null without a word.

    ``declared``: addr, initial; ``words``: addr, position, search_form.  First words are folded before the join.
    """
    first = words.groupBy("addr").agg(F.substring(F.min_by("search_form", "position"), 1, 1).alias("found"))
    return declared.select("addr", "initial").join(first, "addr", "left").where(~F.col("initial").eqNullSafe(F.col("found")))
