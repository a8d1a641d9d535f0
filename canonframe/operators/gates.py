"""Bulk quality gates: every gate is a count of violations, nothing is repaired.

A gate is ``(name, DataFrame of violating rows)``; ``run`` counts them all in
one plan and ``failed`` keeps the ones that must stop a build.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

Gate = tuple[str, DataFrame]


def run(gates: list[Gate]) -> DataFrame:
    """(gate, violations) for all gates, the passing ones included."""
    counted = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations") for name, df in gates]
    return reduce(DataFrame.unionByName, counted)


def failed(report: DataFrame) -> DataFrame:
    return report.where("violations > 0")


def count_band(df: DataFrame, low: int, high: int) -> DataFrame:
    """One row when the number of rows is outside [low, high]."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.where(~F.col("n").between(low, high))


def equal_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.agg(F.count(F.lit(1)).alias("n")).withColumn("_m", right.select(F.count(F.lit(1))).scalar())
    return a.where("n <> _m")


def orphans(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    return df.join(known.select(F.col(known_column).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def not_in(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule does not hold (NULL counts as not holding)."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def differs(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two ways to compute the same table."""
    r = right.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values]).withColumn("_right", F.lit(True))
    j = left.select(*keys, *values).withColumn("_left", F.lit(True)).join(r, keys, "full_outer")
    bad = F.col("_left").isNull() | F.col("_right").isNull()
    for v in values:
        bad = bad | ~F.col(v).eqNullSafe(F.col(f"_r_{v}"))
    return j.where(bad)
