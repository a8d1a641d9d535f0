import random

import numpy as np
import xxhash

from canonframe.llm import simhash as S
from canonframe.llm.common import components

from .helpers import documents, no_docs, odd_docs


def slow_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """Smallest member reachable, by brute force over all pairs."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_classes_equal_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").toPandas()
    rng = random.Random(1)
    rows = list(docs.itertuples(index=False, name=None))
    for i, text in rows[:40]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + i, " ".join(words)))
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [slow_fingerprint(t) for _, t in rows]
    least = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    members = {}
    for (i, _), c in zip(rows, least):
        members.setdefault(c, []).append(i)
    want = {i: (f"{p:016x}", min(members[c])) for (i, _), p, c in zip(rows, prints, least)}
    for shard_rows in (S.SHARD_ROWS, 2):
        got = {r[0]: (r[1], r[2]) for r in S.linked_classes(given, shard_rows=shard_rows).collect()}
        assert got == want


def test_links_cross_every_block(spark):
    """Two flipped bits anywhere are found, also when a shard is dealt again."""
    rng = random.Random(2)
    values = []
    for _ in range(150):
        v = rng.getrandbits(64)
        values += [v, v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)]
    base = rng.getrandbits(64)
    values += [base ^ rng.getrandbits(10) for _ in range(300)]       # dense: most share two blocks
    values = sorted(set(values))
    nodes = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big")), 1) for i, v in enumerate(values)], "id bigint, value binary, size bigint")
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 2)
    for shard_rows in (S.SHARD_ROWS, 20):
        links = S.similar_links(nodes, S.Pigeonhole(2), 2, lambda d, a, b: True, shard_rows)
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        assert [roots.get(i, i) for i in range(len(values))] == want


def test_bk_tree_search_is_complete():
    rng = random.Random(3)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = S.BKTree()
    for i, v in enumerate(values):
        tree.insert(v, i)
    for probe in values[:50]:
        assert sorted(p for _, p in tree.search(probe, 3)) == [i for i, v in enumerate(values) if (v ^ probe).bit_count() <= 3]


def test_majority_of_many_hashes():
    hashes = np.random.default_rng(4).integers(0, 2 ** 63, 9000, dtype=np.uint64)
    counts = [sum(int(h) >> b & 1 for h in hashes) for b in range(64)]
    assert int.from_bytes(S.majority(hashes), "big") == sum(1 << b for b in range(64) if 2 * counts[b] > 9000)


def test_odd_rows(spark):
    got = S.linked_classes(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {0, 1, 2} and {r["component_id"] for r in zero} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert S.linked_classes(no_docs(spark)).count() == 0


def similarity(a, b):
    a, b = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_of_each_group(spark):
    """Copies with one word in 200 changed: any two share at least 0.9 of their shingles."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(200)] = rng.choice(("edit", words[0]))
            rows.append((i, " ".join(copy)))
            i += 1
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in S.keep_one(docs).collect()) == list(range(0, 180, 6))
    assert sorted(r["doc_id"] for r in S.keep_one(docs, shard_rows=3).collect()) == list(range(0, 180, 6))


def test_near_copies_are_found_and_others_stay(spark):
    """Recall against brute force over pairs of a wide range of similarities."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    pairs = []
    for n in (40, 100, 300, 1000):
        for share in (0.005, 0.01, 0.02, 0.05, 0.1):
            for _ in range(12):
                a = [rng.choice(vocabulary) for _ in range(n)]
                b = list(a)
                for p in rng.sample(range(n), max(1, int(share * n))):
                    b[p] = f"edit{rng.randrange(99)}"
                pairs.append((" ".join(a), " ".join(b)))
    docs = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in S.keep_one(docs).collect()}
    gone = [(similarity(*pair), 2 * i + 1 not in kept) for i, pair in enumerate(pairs)]
    near, far = [g for j, g in gone if j >= 0.85], [g for j, g in gone if j < 0.6]
    assert sum(near) >= 0.9 * len(near) and not any(far)
    assert set(range(0, 2 * len(pairs), 2)) <= kept


def test_keep_one_of_odd_rows(spark):
    docs = odd_docs(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 3, 4, 5, 7, 8, 9, 10, None]                      # null, empty and blank are one class; repeated rows and copies go
    assert S.keep_one(no_docs(spark)).count() == 0


def _exact_classes(texts):
    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    sets = [grams(t) for t in texts]
    return classes(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))


def test_all_pairs_from_the_threshold_up_and_none_below(spark):
    """Against brute force: pairs at exactly 0.8 (one text holds 4/5 of the other's shingles) and just below it."""
    rng = random.Random(8)
    rows = []
    for n in (5, 10, 50, 200, 1000):
        for cut in (0, 1):
            for _ in range(20):
                words = [f"w{rng.randrange(10 ** 6)}" for _ in range(n + 4)]
                rows += [" ".join(words), " ".join(words[:n * 4 // 5 - cut + 4])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in S.keep_one(docs).collect())
    assert kept == sorted(set(_exact_classes(rows))) and len(kept) == 300


def test_short_texts_link_from_the_threshold_up(spark):
    """A short text and the same with a word or a sentence more; sets of (small, large) shingles, 0.75 does not link."""
    rng = random.Random(9)
    rows, want = [], []
    for small, large in ((4, 5), (5, 6), (6, 7), (8, 10), (12, 15), (20, 25), (3, 4), (15, 20)):
        for _ in range(20):
            words = [f"w{rng.randrange(10 ** 6)}" for _ in range(large + 4)]
            want += [len(rows)] if 5 * small >= 4 * large else [len(rows), len(rows) + 1]
            rows += [" ".join(words[:small + 4]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in S.keep_one(docs).collect()) == want


def test_full_shards_lose_no_pairs(spark):
    """Copies of one template with up to 15 of 300 words changed: in shards far above the bound, classes equal brute force."""
    rng = random.Random(10)
    template = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(150):
        copy = list(template)
        for p in rng.sample(range(300), rng.randrange(5, 16)):
            copy[p] = f"edit{rng.randrange(10 ** 6)}"
        rows.append(" ".join(copy))
        for p in rng.sample(range(300), 4):
            copy[p] = f"edit{rng.randrange(10 ** 6)}"
        rows.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    want = sorted(set(_exact_classes(rows)))
    assert 1 < len(want) < len(rows) // 2 + 1
    for shard_rows in (S.SHARD_ROWS, 40):
        assert sorted(r["doc_id"] for r in S.keep_one(docs, shard_rows=shard_rows).collect()) == want
