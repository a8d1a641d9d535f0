import random

import pytest
from pyspark.sql import functions as F

from canonframe.operators import constraints as K


def report(df):
    return {r["gate"]: r["violations"] for r in df.collect()}


EVENT = "id string, axis string, books string, earliest int, latest int, era string, note string"


def spec(spark):
    eras = spark.createDataFrame([("stone",), ("bronze",), (None,)], "era string")
    return [K.one_of("axis", ["narrative", "composition", "canon"]), *K.required("id", "note"), *K.years("earliest", "latest"),
            K.only_with("books", F.col("axis") == "composition", "books of compositions"), K.unique("id"),
            K.reference("era", eras), K.Size("rows", 1, 1000), K.words_at_most("note", 3),
            K.Group("an axis has one era at most", ("axis",), F.count_distinct("era") <= 1)]


GOOD = ("a", "narrative", None, -5, 7, "stone", "one two")

MUTATIONS = {
    "axis is a known value": ("b", "sideways", None, 1, 2, "stone", "x"),
    "id is present": (" ", "narrative", None, 1, 2, "stone", "x"),
    "note is present": ("b", "narrative", None, 1, 2, "stone", None),
    "earliest is no year zero": ("b", "narrative", None, 0, 2, "stone", "x"),
    "latest is no year zero": ("b", "narrative", None, -2, 0, "stone", "x"),
    "earliest to latest in order": ("b", "narrative", None, 3, 2, "stone", "x"),
    "books of compositions": ("b", "narrative", "Gen", 1, 2, "stone", "x"),
    "id unique": ("a", "narrative", None, 1, 2, "stone", "x"),
    "era exists": ("b", "composition", "Gen", 1, 2, "iron", "x"),
    "note has at most 3 words": ("b", "narrative", None, 1, 2, "stone", " one\ttwo  three\nfour "),
    "an axis has one era at most": ("b", "narrative", None, 1, 2, "bronze", "x"),
}


def test_every_rule_finds_its_planted_violation_alone(spark):
    rules = spec(spark)
    clean = report(K.check(spark.createDataFrame([GOOD], EVENT), rules))
    assert clean == {r.name: 0 for r in rules}
    for name, row in MUTATIONS.items():
        got = report(K.check(spark.createDataFrame([GOOD, row], EVENT), rules))
        broken = {k for k, v in got.items() if v}
        also = {"note has at most 3 words"} if row[6] is None else set()            # a missing note has no words to count
        assert broken == {name} | also, (name, got)


def test_a_composition_without_books_and_missing_years(spark):
    got = report(K.check(spark.createDataFrame([("b", "composition", None, None, 4, None, "x")], EVENT), spec(spark)))
    assert got["books of compositions"] == 1 and got["earliest is no year zero"] == 1 and got["latest is no year zero"] == 0
    assert got["earliest to latest in order"] == 1 and got["era exists"] == 1
    free = [*K.years("earliest", "latest", optional=True), K.reference("era", spark.createDataFrame([("x",)], "e string"), optional=True)]
    rows = [(None, None, None, None, None, None, None), (None, None, None, 4, None, None, None)]
    assert report(K.check(spark.createDataFrame(rows, EVENT), free)) == {
        "earliest is no year zero": 0, "latest is no year zero": 1, "earliest to latest in order": 1, "era exists": 0}


def test_empty_tables(spark):
    rules = spec(spark)
    got = report(K.check(spark.createDataFrame([], EVENT), rules))
    assert got == {r.name: int(r.name == "rows") for r in rules}
    nothing = spark.createDataFrame([], "era string")
    assert report(K.check(spark.createDataFrame([GOOD], EVENT), [K.reference("era", nothing)])) == {"era exists": 1}
    assert report(K.check(spark.createDataFrame([], EVENT), [K.one_of("axis", ["a"]), K.Size("rows", 0, 0)])) == {"axis is a known value": 0, "rows": 0}


def test_types_and_a_report_of_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("12345678901234",)], "n string")
    rules = [K.typed("n", "int"), *K.required("n")]
    assert report(K.check(df, rules)) == {"n is int": 2, "n is present": 1}
    assert {(r["n"], tuple(r["broken"])) for r in K.broken_rows(df, rules).collect()} == {
        ("x", ("n is int",)), ("12345678901234", ("n is int",)), (None, ("n is present",))}
    with pytest.raises(ValueError):
        K.check(df, [K.typed("n", "int"), K.typed("n", "int")])


def test_keys_shared_by_rules_and_a_hot_value_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, *range(40)]), rng.choice([None, "p", "q", "r"]), rng.randrange(-3, 30)) for _ in range(3000)]
    pairs = {(a, b) for a, b, _ in rows[:300]}
    rules = [K.unique("a", "b"), K.unique("b", "v"), K.Group("sum of a small", ("a",), F.sum("v") < 900),
             K.Group("a is least", ("a",), F.min("a") == F.max("a")),
             K.reference("a", spark.createDataFrame([(i,) for i in range(0, 40, 2)], "x long")),
             K.Reference("a again", ("a",), spark.createDataFrame([(i,) for i in range(10)], "x long"), True),
             K.Reference("pair", ("b", "a"), spark.createDataFrame([(b, a) for a, b in pairs], "y string, x long")), K.Row("v", F.col("v") >= 0)]
    got = report(K.check(spark.createDataFrame(rows, "a long, b string, v long").repartition(7), rules))

    def groups(f):
        out = {}
        for r in rows:
            out.setdefault(f(r), []).append(r)
        return out
    whole = {p for p in pairs if None not in p}
    assert got == {
        "a, b unique": sum(len(g) > 1 for g in groups(lambda r: r[:2]).values()), "b, v unique": sum(len(g) > 1 for g in groups(lambda r: r[1:]).values()),
        "sum of a small": sum(sum(r[2] for r in g) >= 900 for g in groups(lambda r: r[0]).values()), "a is least": int(any(r[0] is None for r in rows)),
        "a exists": sum(r[0] is None or r[0] % 2 == 1 for r in rows), "a again": sum(r[0] is not None and r[0] >= 10 for r in rows),
        "pair": sum(r[:2] not in whole for r in rows), "v": sum(r[2] < 0 for r in rows)}


def test_one_scan_a_table(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "id % 3 AS v").write.parquet(str(tmp_path / "t"))
    df, known = spark.read.parquet(str(tmp_path / "t")), spark.range(5).toDF("x")
    out = K.check(df, [K.unique("id"), K.Group("g", ("k", "v"), F.count(F.lit(1)) > 1), K.Group("h", ("v",), F.max("k") == 6), K.reference("k", known),
                       K.Row("v", F.col("v") < 2), K.Size("n", 1, 99)])
    assert report(out) == {"id unique": 0, "g": 0, "h": 0, "k exists": 28, "v": 33, "n": 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan
