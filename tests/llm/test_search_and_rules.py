import random
import re

import numpy as np
import pytest

from canonframe.llm import decontaminate as D, licences as L, toolcalls as C, topk as K, urlrules as U
from canonframe.llm import queries

from .helpers import SF, documents, no_docs, odd_docs


# --- decontamination ---------------------------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_prefix_distance_equals_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(1, 12)
        item = [rng.randint(1, 4) for _ in range(n)]
        window = [rng.randint(0, 4) for _ in range(rng.randint(1, 16))]
        bits = {}
        for p, x in enumerate(item):
            bits[x] = bits.get(x, 0) | 1 << p
        want = min(edit_distance(item, window[:j]) for j in range(len(window) + 1))
        assert D.prefix_distance(bits, n, window, 99)[0] == want


@pytest.mark.parametrize("n", [10, 15, 20, 35, 50, 80, 120, 200, 260])
def test_buckets_alone_find_edited_windows_and_no_others(n):
    """Candidates of the hash itself, without gate or exact distance, at the bound of edits."""
    rng = random.Random(n)
    items = [(i, [rng.randrange(1, 10 ** 6) for _ in range(n)]) for i in range(60)]
    group = D._Length(n, items, D.edits_allowed(n), 10 ** 6)
    windows = []
    for _, words in items:
        w = list(words)
        for _ in range(D.edits_allowed(n)):
            p, kind = rng.randrange(len(w)), rng.choice("sdi")
            w[p:p + (kind != "i")] = [] if kind == "d" else [rng.randrange(1, 10 ** 6)]
        windows.append((w + [rng.randrange(1, 10 ** 6) for _ in range(n)])[:n])
    # What unrelated texts share: every sixth word is one of the ten commonest.
    unrelated = [[rng.randrange(10) if rng.random() < 1 / 6 else rng.randrange(2 * 10 ** 6, 3 * 10 ** 6) for _ in range(n)] for _ in range(200)]
    found = list(group.candidates(np.array(windows + unrelated, np.int64)))
    assert sum(w == i for w, i in found) >= 0.9 * len(items)
    assert sum(w != i for w, i in found) <= 0.01 * len(items) * (len(windows) + len(unrelated))


def test_leaks_with_edits_are_found(spark):
    rng = random.Random(10)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["item_id"], D.words_of(r["text"])) for r in items.collect()]
    vocabulary = [w for _, ws in rows for w in ws]
    docs, want = [], []
    for n in range(200):
        item, words = rng.choice(rows)
        words = list(words)
        for _ in range(D.edits_allowed(len(words))):
            p, kind = rng.randrange(len(words)), rng.choice("sdi")
            words[p:p + (kind != "i")] = [] if kind == "d" else [rng.choice(vocabulary)]
        around = [[rng.choice(vocabulary) for _ in range(20)] for _ in range(2)]
        docs.append((n, b" ".join(around[0] + words + around[1]).decode().upper()))
        want.append(item)
    given = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(given, items).collect()}
    assert sum((n, i) in got for n, i in enumerate(want)) >= 0.95 * len(want)
    assert len(got) <= len(want) + 5
    blocked = {(r["doc_id"], r["item_id"]) for r in D.leaks(given, items, block_items=7).collect()}
    assert blocked == got


def test_leaks_equal_brute_force_for_exact_passages(spark):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = [(r["item_id"], b" " + b" ".join(D.words_of(r["text"])) + b" ") for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, w in held if w in b" " + b" ".join(D.words_of(r["text"])) + b" "}
    got = D.leaks(docs, items).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == want
    assert {r["doc_id"] for r in D.keep_clean(docs, items).collect()}.isdisjoint({d for d, _ in want})


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "x"), (5, "zz"), (6, "d e")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["first_word"]) for r in D.leaks(odd_docs(spark), items).collect())
    assert got == [(4, 3, 0, 0), *[(5, 4, 0, 0), (5, 6, 0, 3)] * 1, (5, 4, 0, 0), (5, 6, 0, 3), (6, 4, 0, 0), (6, 6, 0, 3)][:0] + sorted(
        [(4, 3, 0, 0)] + [(5, 4, 0, 0), (5, 6, 0, 3)] * 2 + [(6, 4, 0, 0), (6, 6, 0, 3)])
    docs = odd_docs(spark)
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert D.leaks(no_docs(spark), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    apart = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id bigint, text string")      # not across documents
    assert D.leaks(apart, items.where("item_id = 4")).count() == 0


# --- URL rules ------------------------------------------------------------------------------------------

def test_automaton_equals_regular_expressions():
    rng = random.Random(11)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/é") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [""]
    automaton = U.Automaton(globs)
    assert automaton.words > 1
    fits = automaton.match([t.encode() for t in texts])
    for g, glob in enumerate(globs):
        pattern = re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|[^*]", glob)), re.S)
        for t, text in enumerate(texts):
            assert fits[t, g] == bool(pattern.fullmatch(text)), (glob, text)


def test_url_rules_of_odd_rows(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x?q", "http://example.net/en", "http://evilexample.net/en/", "http://x.net", "http://x.net/",
            "ftp://NET/a#b", "http://x.org/fr/", "http://x.org?/fr/", "http://a.com/x.net/", "http://example.com/de/" + "y" * 5000, "http://b.c/é*\\", "http://x.net/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = [U.Rule(v, t) for v, t in queries.URL_RULES]
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in U.judge(pages, rules).collect()}
    assert [got[i][1:] for i in range(15)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), ("net/", "block"),
        ("net/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"), (None, "allow"), ("net/", "block")]
    assert got[3][0] == "a.example.net" and got[0][0] == ""
    assert U.judge(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in U.judge(pages, []).collect()} == {"allow"}


# --- top-k -----------------------------------------------------------------------------------------------

def brute_top(rows, queries_, k):
    out = set()
    for q, v in queries_:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(700, 30)) * rng.pareto(2, size=(700, 1))
    vectors[50:60] = vectors[3]                                               # ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    whole = K.integer_vectors(given)
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = brute_top(ints, [r for r in ints if r[0] % 20 == 0], 10)
    for block, head in ((K.BLOCK_ROWS, K.HEAD_ROWS), (8, 16)):
        got = K.search(whole, whole.where("vec_id % 20 = 0"), 10, block, head).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "c"), (1, None, "c"), (2, [1.0, None], "c"), (3, [nan, 1.0], "c"), (4, [inf, 1.0], "c"), (5, [1.0], "c"), (6, [-1.0, 0.5], "c"),
            (7, [1.0], "c"), (8, [], "c"), (None, [9.0], "c")]
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    whole = K.integer_vectors(given)
    got = {tuple(r) for r in K.search(whole, whole.where("vec_id = 0"), 10).collect()}
    one = 1024 * 1024
    assert got == {(0, 1, 5, one), (0, 2, 7, one), (0, 3, 6, 0), (0, 4, 8, 0)}
    assert K.search(whole.limit(0), whole, 10).count() == 0 and K.search(whole, whole.limit(0), 10).count() == 0


# --- licences ---------------------------------------------------------------------------------------------

def test_licence_scores_equal_brute_force(spark):
    docs = documents(spark).selectExpr("doc_id AS file_id", "concat('d/', doc_id) AS path", "text")
    n, counts = L.line_counts(docs, L.TEMPLATES)
    t = L.Templates(L.TEMPLATES, n, counts)
    got = {r["file_id"]: (r["licence"], round(r["score"], 9)) for r in L.own_licences(docs).collect()}
    for r in docs.collect():
        best = min(((-s, name) for s, name in (t.best(L.plain_words(line)) for line in r["text"].split("\n")) if s >= L.THRESHOLD), default=(0.0, None))
        assert got[r["file_id"]] == (best[1], round(-best[0], 9))
    assert n == sum(r["text"].count("\n") + 1 for r in docs.collect()) and any(v[0] for v in got.values())


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "x"), (3, "b.py", None), (4, None, "Released under the MIT License."),
            (5, "a/b/COPYING", "Licensed under CC BY-NC 4.0."), (6, "LICENSE", ""), (7, None, None), (8, "a/q.txt", ""), (8, "a/q.txt", ""),
            (9, "a/b/c/y.py", "first\nLicensed under the Apache License, Version 2.0.\n" + "long " * 5000)]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, path string, text string, licence string")
    got = sorted((r["file_id"], r["licence"], r["origin"], r["directory"]) for r in L.scan(files).collect())
    assert got == [(1, "MIT", "own", None), (2, "CC-BY-NC-4.0", "inherited", "a/b"), (3, None, "none", None), (4, "MIT", "own", None), (5, "CC-BY-NC-4.0", "own", None),
                   (6, None, "none", None), (7, None, "none", None), (8, "MIT", "inherited", "a"), (8, "MIT", "inherited", "a"), (9, "Apache-2.0", "own", None)]
    assert L.scan(files.limit(0)).count() == 0
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "x/y/z", "t"), (3, "w", "t")], "file_id bigint, path string, text string")
    assert {(r["file_id"], r["directory"]) for r in L.scan(root).collect()} == {(1, None), (2, ""), (3, "")}


# --- tool calls ---------------------------------------------------------------------------------------------

SCHEMAS = {"f": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "string", "enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}}
CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>, level string"


def test_tool_calls_are_ordered_checked_and_linked(spark):
    calls = spark.createDataFrame([
        (1, "p", 1, "f", '{"b":"x", "a": 1.0}', None, "c"), (1, "q", 3, "f", '{"a":-1}', ["p"], "c"), (1, "r", 5, "f", '{"b":"z","c":1}', ["p", "q"], "c"),
        (1, "r", 7, "f", "{}", None, "c"), (1, "s", 9, "g", "{}", ["nowhere", None], "c"), (1, "t", 11, "f", '{"a":', [], "c"),
        (2, "p", 1, "f", '{"a":1}', ["q"], "c"), (2, "q", 2, "f", '{"a":1}', ["p"], "c"), (2, "z", 3, "f", '{"a":1}', ["q"], "c"),
        (3, None, 1, "f", None, None, "c"), (4, "p", 1, "f", '{"a":1,"a":2}', ["p"], "c")], CALLS)
    results = spark.createDataFrame([(1, "p", 2, "one"), (1, "p", 2, "one"), (1, "q", 4, None), (1, "nobody", 4, "x"), (3, None, 2, "x"), (None, "p", 2, "é\n\"")],
                                    "conv_id bigint, call_id string, turn bigint, content string")
    out = C.link(calls, results, SCHEMAS)
    rows = {(r["conv_id"], r["call_id"], r["result_turn"]): r for r in out.collect()}
    assert out.count() == 6 + 8
    assert [rows[1, c, t]["level"] for c, t in (("p", 2), ("q", 4), ("r", None), ("s", None), ("t", None))] == [0, 1, 2, 0, 0]
    assert rows[1, "p", 2]["call_json"] == '{"arguments":{"a":1,"b":"x"},"id":"p","name":"f"}'
    assert rows[1, "q", 4]["problems"] == "a is beyond its minimum" and rows[1, "q", 4]["result_json"] == '{"content":null,"id":"q"}'
    assert rows[1, "r", None]["problems"] == "missing a; b is not allowed; unknown c" and rows[1, "r", None]["call_turn"] == 5
    assert rows[1, "s", None]["problems"] == "unknown tool; refers to unknown nowhere"
    assert rows[1, "t", None]["problems"] == "arguments are not an object"
    assert rows[1, "nobody", 4]["status"] == rows[None, "p", 2]["status"] == rows[3, None, 2]["status"] == "orphan"
    assert [rows[2, c, None]["problems"] for c in "pqz"] == ["cyclic"] * 3 and rows[2, "p", None]["level"] is None
    assert rows[3, None, None]["problems"] == "arguments are not an object; no identifier"
    assert C.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_a_long_chain_of_calls(spark):
    calls = spark.createDataFrame([(1, f"c{i}", i, "f", '{"a":1}', [f"c{j}" for j in (i - 1, i - 3) if j >= 0], "") for i in range(8)], CALLS)
    results = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string")
    assert {r["call_id"]: r["level"] for r in C.link(calls, results, SCHEMAS).collect()} == {f"c{i}": i for i in range(8)}


def test_levels_of_long_chains_and_diamonds(spark, monkeypatch):
    """A chain of 1,000, diamonds behind one another, joins of chains, cycles and calls behind cycles, against a plain walk."""
    rng = random.Random(6)
    after = {("chain", f"c{i}"): [f"c{i - 1}"] if i else [] for i in range(1000)}
    for d in range(3):                                     # each diamond hangs on the one before it, by a chain of 5
        base = [f"d{d - 1}e"] if d else []
        after |= {("diamond", f"d{d}x0"): base} | {("diamond", f"d{d}x{i}"): [f"d{d}x{i - 1}"] for i in range(1, 6)}
        after |= {("diamond", f"d{d}l"): [f"d{d}x5"], ("diamond", f"d{d}r"): [f"d{d}l"], ("diamond", f"d{d}e"): [f"d{d}l", f"d{d}r", f"d{d}x2"]}
    for i in range(60):
        after["random", f"r{i}"] = [f"r{j}" for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))]
    after |= {("cycle", "p"): ["q"], ("cycle", "q"): ["r"], ("cycle", "r"): ["p"], ("cycle", "s"): ["p", "ok"], ("cycle", "t"): ["s"], ("cycle", "ok"): [], ("cycle", "u"): ["u"],
              ("cycle", "v"): ["ok", "none"]}
    want = {}

    def level(conv, call, path=()):
        if call in path:
            return None
        if (conv, call) not in want:
            below = [level(conv, r, (*path, call)) for r in after[conv, call] if (conv, r) in after]
            want[conv, call] = None if None in below else max(below, default=-1) + 1
        return want[conv, call]
    for i in range(1000):
        level("chain", f"c{i}")
    for conv, call in after:
        if conv != "cycle":
            level(conv, call)
    want = {k: v for k, v in want.items() if k[0] != "cycle"} | {("cycle", "ok"): 0, ("cycle", "v"): 1}
    written = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, cut=C.cut_lineage: written.append(1) or cut(df))
    calls = spark.createDataFrame([(*k, v) for k, v in after.items()], "conv_id string, call_id string, after array<string>")
    known, dangling = C.levels(calls)
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in known.collect()} == want
    assert [(r["call_id"], r["ref"]) for r in dangling.collect()] == [("v", "none")]
    assert len(written) < 60
    written.clear()
    assert C.levels(calls.where("conv_id = 'chain'"))[0].count() == 1000 and len(written) <= 18     # 10 rounds and 8 tables around them
