"""Re-anchoring of quotes against a plain edit distance over every window."""

import random
import re

import pytest

from canonframe.operators import quotes as Q
from canonframe.plans import catalog


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(quote, text, threshold):
    q, w = quote.split(), text.split()
    found = min((edit_distance(quote, " ".join(w[p:p + len(q)])), p + 1) for p in range(max(len(w) - len(q) + 1, 1)))
    return found if found[0] <= int(threshold * len(quote) + 1e-9) else None


def given():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeαβγ") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    out = []
    for n in [1, 1, 2, 3, 5, 8, 9, 12, 20, 40, 90] * 4:
        text = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        quote = [rng.choice(words) for _ in range(n)]
        if rng.random() < 0.7:                          # a passage of the text with some letters changed
            at = rng.randrange(len(text))
            quote = text[at:at + n]
            quote = list(" ".join(quote))
            for _ in range(rng.randint(0, max(1, len(quote) // 3))):
                quote[rng.randrange(len(quote))] = rng.choice("abcx ")
            quote = "".join(quote).split() or ["a"]
        out.append((" ".join(quote), " ".join(text)))
    long = " ".join(rng.choice(words) for _ in range(150))
    return out + [(long, long[9:].strip() + " end"), (long, "short"), ("a", "b a a"), ("aa bb", "aa"), ("x y z", "x y z x y z"), ("a" * 64, "a" * 64), ("a" * 65, "b " + "a" * 64)]


@pytest.mark.parametrize("step", [0.0, 30.0, 1e9])      # all side by side, mixed, every pair alone
def test_windows_equal_brute_force(monkeypatch, step):
    monkeypatch.setattr(Q, "STEP", step)
    pairs = given()
    assert max(len(q) for q, _ in pairs) > 64 * Q.BLOCKS
    got = Q.Pairs([q for q, _ in pairs], [t for _, t in pairs]).best_windows(0.3)
    want = [plain(q, t, 0.3) for q, t in pairs]
    assert got == want and 10 < sum(w is not None for w in want) < len(want)


def test_small_groups_of_lanes(monkeypatch):
    monkeypatch.setattr(Q, "CELLS", 600)
    pairs = given()
    assert Q.Pairs([q for q, _ in pairs], [t for _, t in pairs]).best_windows(0.5) == [plain(q, t, 0.5) for q, t in pairs]


def test_anchors_of_a_table(spark):
    rows = [(i, q.upper() + "!", re.sub(" ", " - ", t), "clash") for i, (q, t) in enumerate(given())]
    rows += [(900, None, "a", None), (901, "...", "a", None), (902, "a b", None, None), (903, "", "", None), (904, "Én tó", "x en to", None), (904, "Én tó", "x en to", None)]
    table = spark.createDataFrame(rows, "i bigint, quote string, text string, distance string").repartition(3)
    got = {r["i"]: r for r in Q.anchor_quotes(table, "quote", "text", ["i"]).collect()}
    assert {900, 901, 903}.isdisjoint(got) and got[902]["approximate"] and got[902]["distance"] is None and got[902]["at"] is None
    assert (got[904]["distance"], got[904]["at"], got[904]["approximate"]) == (0, 2, False)
    for i, (q, t) in enumerate(given()):
        want = plain(q, t, 0.3)
        assert (got[i]["distance"], got[i]["at"]) == (want or (None, None)) and got[i]["approximate"] == (want is None)
    assert Q.anchor_quotes(table.limit(0), "quote", "text", ["i"]).count() == 0


@pytest.mark.parametrize("piece, chunk, lanes", [(7, 5, 11), (64, 40, 3), (256, 1024, 8192)])
def test_pieces_and_chunks_lose_nothing(monkeypatch, piece, chunk, lanes):
    for name, value in zip(("PIECE", "CHUNK", "LANES"), (piece, chunk, lanes)):
        monkeypatch.setattr(Q, name, value)
    pairs = given()
    got = Q.Pairs([q for q, _ in pairs], [t for _, t in pairs]).best_windows(0.3)
    assert got == [plain(q, t, 0.3) for q, t in pairs]


def test_unrelated_long_pairs_are_never_measured_alone(monkeypatch):
    rng = random.Random(8)

    def words(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(200))
    quotes, texts = [words("abcdef") for _ in range(5)], [words("uvwxyz") for _ in range(5)]
    monkeypatch.setattr(Q, "_long_columns", lambda *a: pytest.fail("measured alone"))
    assert min(map(len, quotes)) > 64 * Q.BLOCKS and Q.Pairs(quotes, texts).best_windows(0.3) == [None] * 5


def test_lines_and_texts_are_folded_before_they_are_paired(spark, tmp_path):
    documents = [(i, f"a quiet line of document {i}\nand its second line, long enough", "en", f"src{i % 3}") for i in range(6)]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.callables()["tx11_quote_anchoring"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join Inner")]
    assert "MapInArrow" in above and "regexp_replace" not in above
    assert found.count() == 24 and found.where("approximate").count() == 0


def test_folded_pairs_give_the_same_anchors(spark):
    table = spark.createDataFrame([(i, q.upper() + "!", re.sub(" ", " - ", t)) for i, (q, t) in enumerate(given())] + [(900, None, "a"), (901, "a", None)],
                                  "i bigint, quote string, text string")
    ready = table.select("i", Q.folded("quote").alias("quote"), Q.folded("text").alias("text"))
    assert sorted(map(str, Q.anchor_quotes(ready, "quote", "text", ["i"], plain=True).collect())) == sorted(map(str, Q.anchor_quotes(table, "quote", "text", ["i"]).collect()))
