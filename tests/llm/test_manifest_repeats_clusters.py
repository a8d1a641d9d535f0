"""Merkle manifest, repeated strings and centroid clustering against brute force on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonframe.llm import centroids as C, merkle as M, suffixes as S

from .helpers import no_docs, odd_docs


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def packed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, arity):
    """Root of a list of digests, and the siblings (left, right) per level of each."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(places):
            run = at // arity * arity
            paths[i].append((level[run:at], level[at + 1:run + arity]))
            places[i] = at // arity
        level = [digest(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_plain_trees(spark, arity):
    rows = [(i, f"text {i}\n", s) for i, s in enumerate([None] * 4 + ["a"] * 30 + ["b"] + ["é", "z", "a b", ""] * 3)]
    rows += [(None, "no id", "a"), (7, None, "a"), (7, None, "a"), (7, "other", "a")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], "doc_id bigint, text string, source string, _tree string, leaf int").repartition(5)
    got = M.proofs(docs, ["doc_id", "text"], arity=arity).withColumn("again", M.fold(F.unhex("leaf"), F.col("path"))).withColumn("proof", M.proof(F.col("path"))).collect()
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, want = [], []
    for s in sources:
        mine = sorted(((d is not None, d or 0, digest(packed(d), packed(t)), d) for d, t, x in rows if x == s), key=lambda r: r[:3])
        trees.append(([(r[3], r[2]) for r in mine], *plain_tree([r[2] for r in mine], arity)))
    root, tops = plain_tree([t[1] for t in trees], arity)
    for (leaves, subroot, paths), top in zip(trees, tops):
        for (d, h), path in zip(leaves, paths):
            proof = digest(*(x for left, right in path + top for x in left + right))
            want.append((d, h, subroot, root, proof, root))
    assert Counter(want) == Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["again"]) for r in got)


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "t", f"s{i % 3}") for i in range(20)], "doc_id bigint, text string, source string")
    rows = M.proofs(docs.withColumn("other", M.leaf("doc_id", "source")), ["doc_id", "text"], keep=("other",))
    assert rows.where(M.fold(F.col("other"), F.col("path")) == F.col("root")).count() == 0


def test_manifest_of_odd_tables(spark):
    docs = odd_docs(spark).withColumn("source", F.col("shard"))
    got = M.proofs(docs, docs.columns).withColumn("again", M.fold(F.unhex("leaf"), F.col("path"))).collect()
    assert len(got) == docs.count() and all(r["again"] == r["root"] for r in got)
    assert M.proofs(no_docs(spark).withColumn("source", F.lit("x")), ["doc_id", "text"]).count() == 0
    one = M.proofs(docs.where("doc_id = 3"), ["text"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


# --- repeated strings ------------------------------------------------------------------------------

def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone[-1] = False
        spans = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return Counter(out)


def repeating_rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(50)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    a, b, c = prose(120), prose(90), prose(60)
    parts = [a, b, c, "", a[:300], a[:390], a[10:420], b[5:]]
    rows = [(i, f"{prose(rnd.randint(1, 80))} {rnd.choice(parts)} {prose(rnd.randint(0, 60))}{rnd.choice([c, a[3:401], ''])}") for i in range(120)]
    return rows + [(900, None), (901, ""), (902, "x" * 3000), (903, "ab " * 700), (904, prose(2000)), (905, "\0" * 500), (None, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("length, limits", [(400, {}), (400, {"shard_bytes": 20_000}), (400, {"hot_bytes": 3000}), (100, {"hot_bytes": 0}), (64, {})])
def test_repeats_equal_brute_force(spark, length, limits):
    rows = repeating_rows()
    docs = spark.createDataFrame([r + ("clash", 1) for r in rows], "doc_id bigint, text string, spans string, n int").repartition(3)
    assert Counter(tuple(r) for r in S.without_repeats(docs, length, **limits).collect()) == plain_repeats(rows, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "BUFFER", 1000)
    rows = repeating_rows()[:30] + [(904, "".join(random.Random(2).choice("ab") for _ in range(9000)) + "x" * 9000)]
    b = [(t or "").encode() for _, t in rows]
    for text in b:
        pieces = list(S._pieces(np.array([0, len(text)]), 400))
        assert sorted(s for _, lo, hi in pieces for s in range(lo, hi - 399)) == list(range(max(0, len(text) - 399)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    assert Counter(tuple(r) for r in S.without_repeats(docs).collect()) == plain_repeats(rows, 400)


def test_kept_bytes_and_odd_rows(spark):
    got = S.without_repeats(odd_docs(spark), 100, keep_bytes=True).collect()
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] and len(r["spans"]) == r["n_spans"] for r in got)
    assert S.without_repeats(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        S.without_repeats(odd_docs(spark), 63)


@pytest.mark.parametrize("text", ["banana" * 30, "x" * 200, "ab\0" * 40, "".join(random.Random(3).choice("ab") for _ in range(300))])
def test_suffix_array_and_common_prefixes(text):
    contents = [text.encode(), text[7:].encode(), b"zz" + text[3:90].encode()]
    sizes = np.array([len(c) for c in contents])
    ends = sizes.cumsum()
    data = np.frombuffer(b"".join(contents), np.uint8)
    left = np.repeat(ends, sizes) - np.arange(len(data))
    order = S.suffix_array(data, left)
    raw = data.tobytes()
    suffix = [raw[p:p + left[p]] for p in range(len(raw))]
    assert [suffix[p] for p in order] == sorted(suffix)
    common = S.common_prefixes(S.words_at(data), left, order, ends - sizes, sizes)

    def shared(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert [common[p] for p in order[1:]] == [shared(suffix[p], suffix[q]) for p, q in zip(order[1:], order)]


def test_shards_merge_by_binary_search():
    rnd = random.Random(4)
    noise = [bytes(rnd.choice(b"ab") for _ in range(150)) for _ in range(40)]
    whole, parts = S.Shard(noise + [x[20:140] for x in noise[:9]], 100), [S.Shard(noise, 100), S.Shard([x[20:140] for x in noise[:9]], 100)]
    parts[1].merge(parts[0])
    assert np.concatenate([p.repeats for p in parts]).tolist() == whole.repeats.tolist() and whole.repeats.any()


# --- clusters ---------------------------------------------------------------------------------------

def plain_clusters(rows, k, rounds, seed, width, scale=256):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return Counter((i, c, d if d < 1 << 63 else None) for (i, _), (d, c) in zip(kept, assign())), centroids


def vectors(far):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(i % 5, 1) for _ in range(8)]) for i in range(150)]
    rows += [(500, None), (501, [1.0] * 7), (502, [1.0] * 7 + [None]), (503, [float("nan")] + [0.0] * 7), (504, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    rows += [rows[0], rows[0], (0, [3.0] * 8), (600, [0.0] * 8), (601, [-0.001] * 8)]
    return rows + ([(700, [70000.0 * 256 ** 2] * 8), (701, [-1e300] * 4 + [1e9] * 4), (702, [1.7e308] * 8)] if far else [])


@pytest.mark.parametrize("far", [False, True])
def test_clusters_equal_plain_rounds(spark, far):
    rows = vectors(far)
    frame = spark.createDataFrame([r + ("clash", 1) for r in rows], "vec_id bigint, embedding array<double>, v string, distance int").repartition(3)
    # 256 * 1.7e308 is beyond doubles: the plain version cannot floor it, so it is left out there
    usable = [r for r in rows if r[0] != 702]
    if far:
        frame_all, frame = frame, frame.where("vec_id is null or vec_id <> 702")
        assert C.cluster(C.integer_vectors(frame_all, 8), 7, 1, "2:", width=8)[0].count() == 159
    got, centroids = C.cluster(C.integer_vectors(frame, 8), 7, 4, "2:", width=8)
    want, wanted = plain_clusters(usable, 7, 4, "2:", 8)
    assert Counter(tuple(r) for r in got.collect()) == want and centroids == wanted
    told = C.report(got, centroids).collect()
    sums = {}
    for _, c, d in want.elements():
        sums[c] = None if d is None or sums.get(c, 0) is None else sums.get(c, 0) + d
    total = None if None in sums.values() else sum(sums.values())
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in told} == {(c, s, total) for c, s in sums.items()}
    assert {r["centroid_sha256"] for r in told} == {hashlib.sha256(",".join(map(str, wanted[c])).encode()).hexdigest() for c in sums}


def test_clusters_of_few_rows(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert C.report(*C.cluster(C.integer_vectors(none), 40, 5)).count() == 0
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id bigint, embedding array<float>")
    got, centroids = C.cluster(C.integer_vectors(three), 40, 5)
    assert len(centroids) == 3 and all(r["distance"] == 0 for r in got.collect())


def test_pivots_spare_most_distances():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(0, 2000, (40, 64)).astype(np.int64)
    v = centres[rnd.integers(0, 40, 3000)] + rnd.normal(0, 20, (3000, 64)).astype(np.int64)
    pivots = centres[:8]
    best, least, measured = C.nearest(v, C.pivot_distances(v, pivots), centres, C.pivot_distances(centres, pivots))
    plain = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (least == plain.min(axis=1)).all()
    assert measured < 0.2 * 3000 * 40
