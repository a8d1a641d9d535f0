"""Interval primitives against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canonframe.functions import address as A
from canonframe.operators import space as S
from canonframe.plans.views import Tables


def make_space(spark, addrs):
    return S.global_position(S.address_space(spark.createDataFrame([(a,) for a in addrs], "addr long")), "addr")


def test_addresses(spark):
    df = spark.createDataFrame([(1, 1, 1), (43, 3, 16), (19, 119, 176), (66, 22, 21), (1, 0, 1), (1, 1000, 1), (1, 1, 1000)], "b long, c long, v long")
    got = [r[0] for r in df.select(A.pack_checked("b", "c", "v")).collect()]
    assert got == [1001001, 43003016, 19119176, 66022021, None, None, None]
    r = spark.createDataFrame([(43003016,)], "a long").select(A.book_of("a"), A.chapter_of("a"), A.unit_of("a")).first()
    assert tuple(r) == (43, 3, 16)


@pytest.mark.parametrize("salt", [1, 3])
def test_overlap_join_is_exact(spark, salt):
    rnd = random.Random(salt)

    def point():
        return rnd.choice([rnd.randrange(1000, 1100), rnd.randrange(10**6, 10**8)])
    left = [(i, *sorted((point(), point()))) for i in range(150)]
    right = [(i, p, p + rnd.choice([0, 1, 5, 40, 1000, 10**6])) for i in range(150) for p in [point()]]
    a, b = spark.createDataFrame(left, "ia long, s long, e long"), spark.createDataFrame(right, "ib long, s2 long, e2 long")
    got = [tuple(r) for r in S.overlap_join(a, b, ("s", "e"), ("s2", "e2"), salt).select("ia", "ib").collect()]
    want = {(x[0], y[0]) for x in left for y in right if x[1] <= y[2] and x[2] >= y[1]}
    assert len(got) == len(want) and set(got) == want
    assert S.overlap_join(b, a, ("s2", "e2"), ("s", "e")).count() == len(want)


def test_overlap_join_of_one_very_wide_range(spark):
    """No width is promised: a range wider than all others keeps its pairs, and few copies are emitted."""
    left = spark.createDataFrame([(1, 1000, 9000), (2, 1000, 1003), (3, 0, 2**50)], "ia long, s long, e long")
    right = spark.createDataFrame([(1, 8500, 8500), (2, 1001, 1002), (3, 10**9, 10**9 + 3)], "ib long, s2 long, e2 long")
    got = {tuple(r) for r in S.overlap_join(left, right, ("s", "e"), ("s2", "e2")).select("ia", "ib").collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (3, 1), (3, 2), (3, 3)}
    narrow = spark.range(1000).select(F.col("id").alias("ia"), (F.col("id") * 50).alias("s"), (F.col("id") * 50 + 3).alias("e"))
    points = spark.range(1000).select(F.col("id").alias("ib"), (F.col("id") * 50 + 1).alias("s2"))
    joined = S.overlap_join(points, narrow, ("s2", "s2"), ("s", "e"))
    assert joined.count() == 1000
    levels = points.withColumn("there", S._occupied(narrow, "s", "e"))
    assert levels.select(F.explode(S._bins(F.col("there"), "s2", "s2"))).count() == 1000   # one occupied level, one bin per point


def test_empty_sides_of_an_overlap_join(spark):
    a = spark.createDataFrame([(1, 2, 3)], "ia long, s long, e long")
    b = a.select(F.col("ia").alias("ib"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert S.overlap_join(x, y, ("s", "e"), ("s2", "e2")).count() == 0


def test_hot_overlap_key(spark):
    """A third of all rows on one address stays exact."""
    left = spark.range(300).select(F.col("id").alias("ia"), F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") * 10).alias("s"))
    right = spark.range(90).select(F.col("id").alias("ib"), (F.col("id") * 10).alias("s2"), (F.col("id") * 10 + 9).alias("e2"))
    assert S.points_in_ranges(left, right, "s", ("s2", "e2"), salt=4).count() == 100 + sum(1 for i in range(90) if i % 3)


def test_positions_with_and_without_lead(spark):
    rnd = random.Random(1)
    keys = sorted(rnd.sample(range(10**10), 400))
    rows = S.global_position(spark.createDataFrame([(k,) for k in keys], "k long"), "k", total="n").collect()
    assert all(keys[r.pos] == r.k and r.n == 400 for r in rows)
    pairs = [(rnd.randrange(3), k) for k in keys]
    ordered = sorted(pairs)
    rows = S.global_position(spark.createDataFrame(pairs, "c long, k long"), "k", ["c"]).collect()
    assert all(ordered[r.pos] == (r.c, r.k) for r in rows)


def test_expansion_walks_real_addresses(spark):
    """Genesis 1:31 to 2:3 is four addresses, 972 numbers apart."""
    addrs = [1001000 + v for v in range(1, 32)] + [1002000 + v for v in range(1, 26)]
    space = make_space(spark, addrs)
    ranges = spark.createDataFrame([(1, 1001031, 1002003, 4), (2, 1001005, 1001002, -3), (3, 1001099, 1002001, 9)], "id long, start long, end long, votes long")
    got = sorted((r.id, r.addr) for r in S.expand_ranges(ranges, space).collect())
    assert got == [(1, 1001031), (1, 1002001), (1, 1002002), (1, 1002003), (2, 1001005)]
    bad = S.unresolved_ranges(ranges, space).select("id", "bad").collect()
    assert [tuple(r) for r in bad] == [(3, "start")]


def test_expansion_cap_and_both_tallies(spark):
    space = make_space(spark, [b * 1000000 + 1000 + u for b in (1, 2) for u in range(1, 301)])
    ranges = spark.createDataFrame([(1001001, 2001300, -5), (1001001, 2001300, 7), (1001010, 1001012, 3), (2001299, 2001300, 0)], "start long, end long, votes long")
    w = F.greatest(F.col("votes"), F.lit(1))
    a = {tuple(r) for r in S.tally_ranges(ranges, space, w, max_span=S.LINK_SPAN).collect()}
    b = {tuple(r) for r in S.tally_ranges_by_deltas(ranges, space, w, max_span=S.LINK_SPAN).collect()}
    assert a == b and len(a) == 402            # 400 of the wide ranges, and two beyond the cap
    assert (1001010, 3, 11) in a and (2001300, 1, 1) in a and (2001101, 1, 1) not in a
    whole = {tuple(r) for r in S.tally_ranges(ranges, space, w).collect()}
    assert len(whole) == 600 and whole == {tuple(r) for r in S.tally_ranges_by_deltas(ranges, space, w).collect()}
    assert S.expand_ranges(ranges, space).count() == 600 * 2 + 3 + 2   # nothing is cut by default
    report = S.range_report(ranges, space, max_span=S.LINK_SPAN).select("bad", "lost").collect()
    assert sorted(tuple(r) for r in report) == [("truncated", 200), ("truncated", 200)]


def test_merge_ranges(spark):
    rnd = random.Random(4)
    rows = [(k, s, s + rnd.choice([0, 1, 30, 900])) for k in (1, 2) for s in [rnd.randrange(0, 4 * 10**6) for _ in range(100)]] + [(1, 10, 20), (1, 21, 25), (2, 10, 20), (2, 22, 25)]
    got = sorted((r.k, r.s, r.e) for r in S.merge_ranges(spark.createDataFrame(rows, "k long, s long, e long"), "s", "e", ["k"]).collect())
    want = []
    for k in (1, 2):
        out = []
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if out and s <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want += [(k, s, e) for s, e in out]
    assert got == sorted(want)


def test_running_across_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, rnd.randrange(100)])) for i in rnd.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k long, v long")
    out = S.running(df, "k", F.expr("k div 100"), {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}).orderBy("k").collect()
    s, m, last = 0, None, None
    for r, (k, v) in zip(out, sorted(rows)):
        if v is not None:
            s, m, last = s + v, v if m is None else max(m, v), v
        assert (r.k, r.s, r.m, r.l) == (k, s, m, last)


def test_asof_before_first_is_null(spark):
    probes = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (2, 50)], "u long, t long")
    marks = spark.createDataFrame([(1, 10, 7), (1, 60, 8), (2, 51, 9)], "u long, t long, v long")
    got = {(r.u, r.t): r.v for r in S.asof_join(probes, marks, "t", "t", "v", ["u"], 20, "v").collect()}
    assert got == {(1, 5): None, (1, 10): 7, (1, 99): 8, (2, 50): None}


def test_sparse_neighbours(spark):
    df = spark.createDataFrame([(69, c) for c in range(10, 17)] + [(1, 49), (1, 50)], "book long, chapter long")
    got = {(r.book, r.chapter): (r.prev, r.next) for r in S.neighbours(df).collect()}
    assert got[(69, 10)] == (None, 11) and got[(69, 16)] == (15, None) and got[(1, 50)] == (49, None)


def test_space_and_positions_in_one_exchange(spark):
    """The same positions as before, whatever repeats; addresses alone are exchanged, once."""
    rnd = random.Random(8)
    addrs = [rnd.choice([rnd.randrange(2000), rnd.randrange(10**6, 4 * 10**6), 10**9 + rnd.randrange(3 * 10**9)]) for _ in range(900)]
    df = spark.createDataFrame([(a,) for a in addrs + addrs[:300] + [None, None]], "addr long")
    got = S.numbered_space(df)
    assert sorted(map(tuple, got.select("addr", "book", "chapter", "unit", "pos").collect())) == [
        (a, a // 10**6, a // 1000 % 1000, a % 1000, i) for i, a in enumerate(sorted(set(addrs)))]
    assert got.schema.simpleString() == make_space(spark, addrs).schema.simpleString()


def test_addresses_near_meets_both_ends_in_one_join(spark):
    n = 3 * S.LIST + 5
    space = spark.range(n).select((F.col("id") * 7 + 1).alias("addr"), F.col("id").alias("pos"))
    rows = [(i, at, k) for i, (at, k) in enumerate((at, k) for at in (-1, 0, 3, S.LIST - 1, S.LIST, 2 * S.LIST, n - 1, n, None) for k in (-6, -4, 0, 6, None))] * 2
    asked = spark.createDataFrame(rows, "i long, at long, k long")
    got = S.addresses_near(asked, space, F.col("at"), F.col("k"), 6)
    assert sorted(map(tuple, got.select("i", "first", "last").collect())) == sorted(
        (i, at * 7 + 1, (at + k) * 7 + 1) for i, at, k in rows if None not in (at, k) and 0 <= at < n and 0 <= at + k < n)
    assert got.columns == ["i", "at", "k", "first", "last"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_edges_of_odd_lines(spark, tmp_path):
    """Edges against the plain reading: null quantities reach to the last address, null keys have no edge, repeats stay."""
    rows = [(o, n, p, s, q, 1.5) for o, n, p, s, q in (
        (1, 1, 3, 1, 13.0), (1, 2, 5, 2, None), (2, 1, None, 1, 4.0), (2, 2, 7, 3, -9.0), (3, 1, 2, 2, 27.0), (3, 1, 2, 2, 27.0), (None, 4, 1, 1, 6.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    got = Tables(spark, str(tmp_path)).edges.select("src", "dst_start", "dst_end", "votes").collect()
    addrs = sorted({o * 1000 + n for o, n, *_ in rows if o is not None})
    want = []
    for o, n, p, s, q, _ in rows:
        if p is not None:
            first = (p * 37 + s) % len(addrs)
            last = len(addrs) - 1 if q is None else min(first + int(math.fmod(q, 7)), len(addrs) - 1)
            if last >= 0:
                want.append((o and o * 1000 + n, addrs[first], addrs[last], q if q is None else int(q) - 5))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [None, 3, 400])
def test_expansion_of_near_and_wide_ranges(spark, most):
    rnd = random.Random(5)
    real = sorted({rnd.randrange(-3_000, 3_000) * rnd.choice([1, 1, 40]) for _ in range(2_500)})
    pick = lambda: rnd.choice(real) + rnd.choice([0, 0, 0, 1])
    ranges = [(i, (a := pick()), rnd.choice([pick(), a, a + rnd.randrange(300), real[min(len(real) - 1, real.index(a) + 4)] if a in real else a])) for i in range(400)]
    ranges += [(400, None, 5), (401, real[7], None), (402, real[0], real[-1]), (403, real[-1], real[0])]
    got = sorted((r.id, r.addr) for r in S.expand_ranges(spark.createDataFrame(ranges, "id long, start long, end long"), make_space(spark, real), max_span=most).collect())
    known = set(real)
    want = []
    for i, a, b in ranges:
        end = max(x for x in (a, b) if x is not None)
        if a in known and end in known:
            want += [(i, x) for x in real if a <= x <= end][:most]
    assert got == sorted(want)


def test_expanded_steps_are_not_exchanged(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranges = spark.createDataFrame([(1, 1001001, 1001003)], "id long, start long, end long")
        plan = S.expand_ranges(ranges, make_space(spark, range(1001001, 1001400)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "slice(" in plan and "hashpartitioning(_bin" in plan and "hashpartitioning(_pos" not in plan, plan
