"""Distinct counts at several levels from stored, mergeable sketches.

``sketches`` reads the table once and keeps one small HyperLogLog sketch for
every group of the finest keys; ``roll_up`` merges stored sketches to any
coarser keys without reading the table again.  The relative standard error is
about ``error(lg)``; exact counts need the folded pairs of ``exact``.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, functions as F

LG = 12


def error(lg: int = LG) -> float:
    return 1.04 / sqrt(2 ** lg)


def sketches(df: DataFrame, keys: list[str], value: str, lg: int = LG) -> DataFrame:
    """(*keys, sketch); NULL values are not counted."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, lg).alias("sketch"))


def roll_up(stored: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, sketch) of coarser keys; no keys make one sketch of everything."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def add(stored: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The stored sketches with those of new rows merged in; values seen before count once."""
    return roll_up(stored.unionByName(more), keys)


def levels(stored: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """(level, key, estimate) for all levels in one pass over the stored sketches; level is the keys' names, key their values."""
    columns = list(dict.fromkeys(c for keys in key_sets for c in keys))
    out = (stored.groupingSets([[F.col(c) for c in keys] for keys in key_sets], *[F.col(c) for c in columns])
           .agg(F.grouping_id().alias("_set"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")))
    return out.select(*_named(key_sets, columns), "estimate")


def exact(df: DataFrame, key_sets: list[list[str]], value: str) -> DataFrame:
    """(level, key, n): exact counts of all levels.  Pairs are folded once per level, map-side first."""
    columns = list(dict.fromkeys(c for keys in key_sets for c in keys))
    pairs = df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value))
    sets = [[F.col(c) for c in keys] + [F.col("_value")] for keys in key_sets]
    folded = pairs.groupingSets(sets, *[F.col(c) for c in columns], F.col("_value")).agg(F.shiftright(F.grouping_id(), 1).alias("_set"))
    named = folded.select(*_named(key_sets, columns))
    return named.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def _named(key_sets: list[list[str]], columns: list[str]):
    """Level and key of a row by its grouping id: a bit for every column, the first highest, set where the level leaves it out."""
    level = key = F.lit(None).cast("string")
    for keys in key_sets:
        here = F.col("_set") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        level = F.when(here, F.lit(",".join(keys))).otherwise(level)
        key = F.when(here, F.array_join(F.array(*[F.col(c).cast("string") for c in keys]), ",", "") if keys else F.lit("")).otherwise(key)
    return level.alias("level"), key.alias("key")
