import random

import pytest
from pyspark.sql import functions as F

from canonframe.operators import annotations as An, coverage as C, media as M, search as Se, timeline as Tl


def test_years_have_no_zero(spark):
    df = spark.createDataFrame([(-1, 1), (-586, -539), (33, 33), (-4, 30)], "a long, b long")
    got = [tuple(r) for r in df.select(Tl.span_years("a", "b"), Tl.range_label("a", "b")).collect()]
    assert got == [(1, "1 BCE–1 CE"), (47, "586–539 BCE"), (0, "33 CE"), (33, "4 BCE–30 CE")]


def test_envelope_rules(spark):
    rows = [(1, "traditional", "event", -1446, -1446), (1, "critical", "event", -1270, -1200), (1, "critical", "composition", -600, -500),
            (2, "traditional", "event", -10, -5), (3, "critical", "composition", -9, -8)]
    p = spark.createDataFrame(rows, "event_id long, tradition string, dates string, earliest long, latest long")
    got = {r.event_id: tuple(r)[1:] for r in Tl.envelope(p).collect()}
    assert got == {1: (-1270, -1200, -1446, -1446), 2: (-10, -5, -10, -5), 3: (None, None, None, None)}
    whole = {r.event_id: r.earliest for r in Tl.envelope(p, F.lit(True)).collect()}
    assert whole == {1: -1270, 2: -10, 3: -9}


def test_tension_never_grades(spark):
    a = spark.createDataFrame([(1, "in-tension"), (1, "silent"), (2, "in-tension"), (3, "consistent"), (3, "corroborates")], "p long, relation string")
    got = {r.p: (r.evidence, r.has_tension) for r in Tl.evidence(a, "p", spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "p long")).collect()}
    assert got == {1: ("silent", True), 2: ("none", True), 3: ("corroborates", False), 4: ("none", False)}


def test_era_gap_and_ties(spark):
    eras = spark.createDataFrame([("a", -1000, -587), ("b", -586, -539), ("c", -330, -63)], "era_id string, start long, end long")
    ev = spark.createDataFrame([(1, -586), (2, -400), (3, -100), (4, -900)], "event_id long, year long")
    got = {r.event_id: r.era_id for r in Tl.by_era(ev, eras, "year").collect()}
    assert got == {1: "b", 2: None, 3: "c", 4: "a"}
    assert tuple(Tl.busiest_era(ev, eras, "year").first()) == ("a", 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_entries_asked_for_are_packed_first(spark, seed):
    rnd = random.Random(seed)
    bars = [(k, i, s, s + rnd.choice([.0, 2.5, 10., 60.]), rnd.choice([None, False, False, True]) if k < 3 else None)
            for k in (1, 2, 3) for i, s in enumerate(rnd.uniform(-300, 300) for _ in range(90))]
    schema = "k long, i long, a double, b double, asked boolean"
    got = {(r.k, r.i): r.lane for r in Tl.lay_out(spark.createDataFrame(bars, schema), ["k"], "a", "b", ["a", "b", "i"], "asked").collect()}
    assert len(got) == len(bars)
    for k in (1, 2, 3):
        ends = []
        for _, i, a, b, _ in sorted((x for x in bars if x[0] == k), key=lambda x: (not x[4], x[2], x[3], x[1])):
            lane = next((n for n, e in enumerate(ends) if e < a), len(ends))
            ends[lane:lane + 1] = [b]
            assert got[(k, i)] == lane


def test_a_lane_is_found_in_logarithmic_steps():
    class Counted(list):
        reads = 0

        def __getitem__(self, n):
            Counted.reads += 1
            return super().__getitem__(n)
    lanes = Tl.Lanes()
    for n in range(4096):
        assert lanes.take(0, n) == n
    lanes.least = Counted(lanes.least)
    assert [lanes.take(a, 10 ** 6) for a in (4095.5, 4000, 1)] == [0, 1, 4096] and Counted.reads < 9000     # one doubling copies the tree
    Counted.reads, lanes.least = 0, Counted(lanes.least)
    assert lanes.take(4000, 10 ** 6) == 2 and Counted.reads <= 60


def test_claims_cover_label_and_traditional_envelope(spark):
    rows = [(1, -5, -3, None, None), (2, -2, 2, -4, 9), (3, 1, 1, None, None), (4, -9, -4, None, 2), (5, 4, 4, None, None), (6, -9, -6, -9, 9)]
    e = spark.createDataFrame(rows, "id long, earliest long, latest long, trad_earliest long, trad_latest long")
    got = {r.id: (r.bar_left, r.bar_width, r.claim_left, r.claim_right) for r in Tl.strip_claims(e, F.lit(-5), F.lit(3), 10.0, reserve=25.0).collect()}
    assert got == {1: (0, 20, 0, 25), 2: (30, 30, 10, 130), 3: (50, 8, 50, 75), 4: (-40, 50, -40, 60)}


@pytest.mark.parametrize("seed", [1, 2])
def test_lanes_match_first_fit(spark, seed):
    rnd = random.Random(seed)
    bars = [(k, i, s, s + rnd.choice([0, 2, 10, 60])) for k in (1, 2) for i, s in enumerate(rnd.randrange(-300, 300) for _ in range(80))]
    got = {(r.k, r.i): r.lane for r in Tl.lay_out(spark.createDataFrame(bars, "k long, i long, a long, b long"), ["k"], "a", "b", ["a", "b", "i"]).collect()}
    for k in (1, 2):
        ends = []
        for _, i, a, b in sorted((x for x in bars if x[0] == k), key=lambda x: (x[2], x[3], x[1])):
            lane = next((n for n, e in enumerate(ends) if e < a), len(ends))
            ends[lane:lane + 1] = [b]
            assert got[(k, i)] == lane


def test_alignment_state_is_the_moving_average(spark):
    rnd = random.Random(3)
    rows = [("e", f, i, rnd.random(), rnd.uniform(1, 45), rnd.random() < .1) for f in range(4) for i in range(7)]
    out = M.alignment_state(spark.createDataFrame(rows, "ed string, f long, i long, score double, rate double, ran_out boolean"), "ed", "f", "i", 13.0).orderBy("f").collect()
    rate, carried = 13.0, 0
    for f, r in enumerate(out):
        mine = [x for x in rows if x[1] == f]
        assert r.rate_in == pytest.approx(rate) and r.carried_in == carried
        done = missing = carried = 0
        for n, x in enumerate(mine):
            nxt = mine[n + 1][3] if n + 1 < len(mine) else None
            if x[5]:
                carried += 1
            elif x[3] < .5 and nxt is not None and nxt >= .7:
                missing += 1
            else:
                done += 1
                if x[3] > .5 and 3 < x[4] < 40:
                    rate = .6 * rate + .4 * x[4]
        assert (r.done, r.missing, r.carried_out) == (done, missing, carried) and r.rate_out == pytest.approx(rate)


def test_drift_cuts_the_file(spark):
    rows = [(1, i, s) for i, s in enumerate([.9, .3, .8, .4, .2, .9])] + [(2, 0, .9), (2, 1, .1)] + [(3, 0, .2), (3, 1, .9)]
    got = {(r.f, r.i) for r in M.before_drift(spark.createDataFrame(rows, "f long, i long, s double"), ["f"], "i", "s", .5).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)}


def test_segments(spark):
    texts = spark.createDataFrame([(1, 20), (2, 0), (3, 5)], "t long, n_chars int")
    marks = spark.createDataFrame([(1, 1, "highlight", 6, 17), (1, 2, "variant", 12, 99), (1, 3, "note", 8, 8), (2, 1, "note", 0, 3)], "t long, mark_id long, kind string, start int, end int")
    got = sorted(tuple(r) for r in An.segments(texts, marks, ["t"]).select("t", "start", "end", "marks", "dominant").collect())
    assert got == [(1, 0, 6, "", ""), (1, 6, 12, "1", "highlight"), (1, 12, 17, "1,2", "highlight"), (1, 17, 20, "2", "variant"), (3, 0, 5, "", "")]


def test_unexplained_gaps(spark):
    canon = spark.createDataFrame([(b * 1000000 + 1000 + u, b) for b in (1, 2) for u in (1, 2, 3)], "addr long, book long")
    books = spark.createDataFrame([(1, "OT"), (2, "NT")], "book long, testament string")
    ed = spark.createDataFrame([("a", "all"), ("b", "OT")], "edition string, scope string")
    texts = spark.createDataFrame([("a", 1001001, 1), ("a", 1001002, 1), ("b", 1001001, 1), ("b", 2001001, 2)], "edition string, addr long, book long")
    om = spark.createDataFrame([("a", 1001003)], "edition string, addr long")
    got = sorted((r.edition, r.addr) for r in C.unexplained_gaps(canon, texts, om, ed, books).collect())
    assert got == [("b", 1001002), ("b", 1001003)]
    m = {(r.edition, r.book): r.status for r in C.coverage_matrix(texts, ed, books).collect()}
    assert m == {("a", 1): "printed", ("a", 2): "out_of_scope", ("b", 1): "printed", ("b", 2): "printed"}


def test_search_and_highlight(spark):
    units = spark.createDataFrame([(1, "Grace and peace, grace!"), (2, "peace only"), (3, "Gracious words")], "d long, text string")
    post = Se.index(units, ["d"])
    q = spark.createDataFrame([("a", 'grace "peace'), ("b", "grac*"), ("c", "NOT"), ("d", '"(*')], "id string, q string")
    slots = Se.parse_queries(q, "id", "q")
    got = {(r.query_id, r.d) for r in Se.match(slots, post, ["d"]).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 3)}
    placed = Se.index(units, ["d"], spots=True)
    assert {(r.d, r.term, r.tf, r.dl) for r in placed.collect()} == {(r.d, r.term, r.tf, r.dl) for r in post.collect()}
    spots = Se.highlights(Se.match(slots, post, ["d"]).where("query_id = 'a'"), slots.select("query_id", "term"), placed, ["d"])
    assert sorted((r.start, r.end) for r in spots.collect()) == [(0, 5), (10, 15), (17, 22)]
    stemmed = {r.term for r in Se.term_stats(Se.index(spark.createDataFrame([(1, "running runs")], "d long, text string"), ["d"], stemmed=True)).collect()}
    assert stemmed == {"run"}
    both = Se.index(spark.createDataFrame([(1, "running, runs")], "d long, text string"), ["d"], stemmed=True, spots=True).first()
    assert both.tf == 2 and [(s.position, s.start, s.end) for s in both.spots] == [(0, 0, 7), (1, 9, 13)]


@pytest.mark.parametrize("block_postings", [4, 128])
def test_best_matches_read_fewer_blocks(spark, block_postings):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    units = spark.createDataFrame([(d, " ".join(rnd.choices(words, [2 ** -i for i in range(12)], k=rnd.randint(3, 40)))) for d in range(600)], "d long, text string")
    post = Se.index(units, ["d"]).cache()
    queries = [(f"{a} {b}", f"{a} {b}") for a in words[:6] for b in words[:8]] + [("w0", "w0"), ("w1 w2 w3", "w1 w2 w3"), ("none w0", "none w0")]
    slots = Se.parse_queries(spark.createDataFrame(queries, "id string, q string"), "id", "q").cache()
    n, total = F.lit(600), F.lit(post.select("d", "dl").distinct().agg(F.sum("dl")).first()[0])
    blocks = Se.impact_blocks(post, ["d"], n, total, block_postings).cache()
    assert blocks.agg(F.sum("n")).first()[0] == post.count() and blocks.groupBy("term").count().agg(F.max("count")).first()[0] > 5

    def rows(scored):
        return {(r.query_id, r.d, round(r.score, 5), r.rank) for r in Se.page(scored, ["d"], 5).collect()}
    assert rows(Se.best_matches(slots, blocks, ["d"], 5)) == rows(Se.ranked(slots, post, ["d"], n, total))
    _, left, _ = Se.wanted_blocks(slots, blocks, ["d"], 5)
    drivers = Se._drivers(slots, blocks)[1].join(blocks, "term").count()
    if block_postings == 4:
        assert left.count() < 0.7 * drivers
