import random

from canonframe.operators import distinct as D, structure as St


def test_units_outside_their_parents(spark):
    parents = spark.createDataFrame([("a", 10, 20), ("b", 30, 40)], "parent string, p_start long, p_end long")
    units = [("a", 10, 20), ("a", 15, 15), ("a", 9, 12), ("a", 18, 21), ("a", 16, 14), ("c", 30, 31), ("b", None, 35), (None, 30, 31)]
    got = St.outside_parents(spark.createDataFrame(units, "parent string, start long, end long"), parents).collect()
    assert sorted((r["parent"] or "", r["start"] or 0, r["end"]) for r in got) == sorted((p or "", s or 0, e) for p, s, e in units[2:])
    assert St.outside_parents(spark.createDataFrame([], "parent string, start long, end long"), parents).count() == 0


def test_overlapping_siblings_against_brute_force(spark):
    rng = random.Random(8)
    units = [(rng.choice(["hot", "hot", "x", "y"]), s := rng.randrange(-200, 4000), s + rng.choice([0, 0, 1, 3, 300])) for _ in range(500)]
    units += [("one", 5, 9000), ("one", 8999, 8999), ("one", 9001, 9001), ("z", 1, 2), ("z", 3, 3), ("z", 2**40, 2**40 + 1)]
    want = set()
    for p, s, _ in units:
        n = sum(q == p and t == s for q, t, _ in units)
        if n > 1 or any(q == p and t < s <= e for q, t, e in units):
            want.add((p, s, n))
    df = spark.createDataFrame(units, "parent string, start long, end long")
    for block in (7, 4096):
        assert {(r["parent"], r["start"], r["n"]) for r in St.overlapping_siblings(df, block).collect()} == want
    assert ("one", 8999, 1) in want and ("one", 9001, 1) not in want and St.overlapping_siblings(df.limit(0)).count() == 0


def test_initials_are_read_from_words(spark):
    declared = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "addr long, initial string")
    words = spark.createDataFrame([(1, 2, "zeta"), (1, 1, "alpha"), (2, 1, "gamma")], "addr long, position long, search_form string")
    assert {(r["addr"], r["found"]) for r in St.initial_breaks(declared, words).collect()} == {(2, "g"), (3, None)}


def test_sketches_roll_up_within_their_error(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "q", None]), rng.randrange(4), rng.choice([None, rng.randrange(60_000)])) for _ in range(80_000)]
    df = spark.createDataFrame(rows, "book string, part int, v long").repartition(6)
    sets = [["book", "part"], ["part"], ["book"], []]
    exact = {(r["level"], r["key"]): r["n"] for r in D.exact(df, sets, "v").collect()}

    def seen(f):
        out = {}
        for r in rows:
            if r[2] is not None:
                out.setdefault(f(r), set()).add(r[2])
        return {k: len(v) for k, v in out.items()}
    want = {("book,part", f"{k[0] or ''},{k[1]}"): n for k, n in seen(lambda r: r[:2]).items()}
    want |= {("part", str(k)): n for k, n in seen(lambda r: r[1]).items()} | {("book", k or ""): n for k, n in seen(lambda r: r[0]).items()}
    want[("", "")] = len({r[2] for r in rows if r[2] is not None})
    assert exact == want
    stored = D.sketches(df, ["book", "part"], "v")
    got = {(r["level"], r["key"]): r["estimate"] for r in D.levels(stored, sets).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - n) <= 4 * D.error() * n + 1 for k, n in want.items())
    small = D.sketches(df.where("v < 100"), ["part"], "v")
    assert all(abs(r["e"] - r["n"]) <= 1 for r in small.selectExpr("part", "hll_sketch_estimate(sketch) AS e").join(
        df.where("v < 100").groupBy("part").agg({"v": "count"}).selectExpr("part"), "part").join(
        df.where("v < 100").selectExpr("part", "v").distinct().groupBy("part").count().withColumnRenamed("count", "n"), "part").collect())


def test_sketches_of_new_rows_are_merged(spark):
    a, b = spark.range(3000).selectExpr("id % 2 AS k", "id"), spark.range(2000, 5000).selectExpr("id % 2 AS k", "id")
    both = D.add(D.sketches(a, ["k"], "id"), D.sketches(b, ["k"], "id"), ["k"])
    for r in both.selectExpr("k", "hll_sketch_estimate(sketch) AS e").collect():
        assert abs(r["e"] - 2500) <= 4 * D.error() * 2500
