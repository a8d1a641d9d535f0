import zlib

import numpy as np

from canonframe.llm import quality as Q, toxicity as T
from canonframe.llm.common import learning_rows, table

from .helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_factorisation_identity():
    """The linear-time sum equals the sum over all pairs of inputs."""
    rng = np.random.default_rng(8)
    model = Q.FactorisationMachine(np.zeros((19, 7)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = rng.choice(50, 12, replace=False), rng.normal(size=12)
    z = 0.3 + model.linear[at] @ x + sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(model.score(at, x), 1 / (1 + np.exp(-z)))


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert ((got["held_out"]) == got["doc_id"].map(held_out)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    apart = got[got["held_out"]]
    good, poor = apart["score"][apart["quality"] == 1].to_numpy(), apart["score"][apart["quality"] == 0].to_numpy()
    assert (good[:, None] > poor).mean() > 0.97


def test_held_out_labels_are_not_learned(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", f"CASE WHEN {Q.HELD_OUT} THEN 1 - quality ELSE quality END AS quality")
    a, b = Q.fit(docs, labels), Q.fit(docs, turned)
    assert a.bias == b.bias and (a.linear == b.linear).all()


def test_learning_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(50)] + [(None, "t")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = learning_rows(docs, labels, "toxic", 10).collect()
    assert len(rows) == 20 and 1 not in {r["doc_id"] for r in rows}


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert Q.keep_good(docs, model).columns == docs.columns
    assert Q.score(no_docs(spark), Q.fit(no_docs(spark), labels)).count() == 0
    nothing = Q.fit(docs, labels.limit(0))
    assert {r["score"] for r in Q.score(docs, nothing).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = T.fit(docs, labels, where="crc32(cast(doc_id as string)) % 3 <> 1")
    got = T.score(docs, chain).join(labels, "doc_id").toPandas()
    apart = got[got["doc_id"].map(held_out)]
    assert (apart["predicted"] == apart["toxic"]).mean() > 0.93
    assert apart["predicted"][apart["toxic"] == 0].mean() < 0.02


def test_chain_feeds_earlier_probabilities(spark):
    rows = [(i, "you idiot" if i % 4 == 1 else "pathetic trash" if i % 4 == 3 else f"fine day {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    chain = T.fit(docs, labels)
    assert [len(w) - len(chain.words) - 1 for w in chain.links] == [0, 1, 2]
    insult, contempt, toxic = chain.probabilities("what an Idiot!")
    assert insult > 0.5 > contempt and toxic > 0.5
    assert chain.probabilities("a fine day " * 3000)[-1] < 0.5
    assert {r["doc_id"] for r in T.keep_civil(docs, chain).collect()} == {i for i, _ in rows if i % 2 == 0}


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1), (5, 0)], "doc_id bigint, toxic int")
    assert T.score(docs, T.fit(docs, labels)).count() == docs.count()
    even = T.fit(docs, labels.limit(0))
    assert {r["p_toxic"] for r in T.score(docs, even).collect()} == {0.5}
    assert T.keep_civil(docs, T.fit(docs, labels)).columns == docs.columns
    assert T.score(no_docs(spark), T.fit(no_docs(spark), labels)).count() == 0


def test_an_untrained_chain_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"you idiot {i}" if i % 2 else "fine day") for i in range(40)], "doc_id bigint, text string")
    alike = docs.selectExpr("doc_id", "'the same words' AS text")
    kinds = {"empty": (docs, []), "civil": (docs, [(i, 0) for i in range(40)]), "toxic": (docs, [(i, 1) for i in range(40)]),
             "no trait": (alike, [(i, i % 2) for i in range(40)])}
    for kind, (given, rows) in kinds.items():
        chain = T.fit(given, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert not chain.trained and T.keep_civil(given, chain).count() == 40, kind
        assert {(r["p_toxic"], r["predicted"]) for r in T.score(given, chain).collect()} == {(0.5, 0)}, kind
