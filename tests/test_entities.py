import json

import pytest
from pyspark.sql import functions as F

from canonframe.sources import entities as E

CITE = [{"source": "src-a", "locator": "p. 1"}]
EVENT = {"id": "ev-one", "title": " An event ", "axis": "narrative", "category": "political", "confidence": "firm", "status": "draft", "summary": "s",
         "verses": [{"ref": "Gen.1.1", "link": "names"}],
         "positions": [{"id": "p", "label": "l", "tradition": "critical", "earliest": -5, "latest": 4, "summary": "s", "citations": CITE,
                        "arguments": [{"stance": "for", "text": "t", "citations": CITE + [{"source": "src-b"}], "verses": [{"ref": "Gen.1.2", "link": "dates"}]}]}],
         "attestations": [{"artifact": "art", "relation": "silent", "note": "n", "citations": CITE}]}
SAMPLES = {
    "sources": {"source": [{"id": "src-a", "kind": "book", "title": "T", "year": 1999}]},
    "eras": {"era": [{"id": "e", "name": "n", "start": -10, "end": -5, "summary": "s", "citations": CITE}]},
    "artifacts": {"id": "art-one", "name": "n", "kind": "seal", "status": "draft", "language": "l", "summary": "s", "citations": CITE, "made": {"earliest": -3, "latest": -2}},
    "events": EVENT,
    "issues": {"id": "is-one", "kind": "textual", "title": "t", "summary": "s", "status": "draft", "citations": CITE, "views": [{"label": "l", "text": "t", "citations": CITE}]},
    "persons": {"id": "per-one", "name": "n", "role": "r", "summary": "s", "status": "draft", "citations": CITE, "also_known_as": ["x"], "events": []},
    "investigations": {"id": "inv-one", "title": "t", "status": "draft", "ref": "Gen.1.1", "summary": "s",
                       "witnesses": [{"siglum": "A", "name": "n", "reading": "r", "translation": "t", "language": "l"}], "differences": [{"kind": "lexical", "text": "t"}]},
    "works": {"id": "wo-one", "title": "t", "canon": "described", "status": "draft", "summary": "s", "citations": CITE, "original_language": "l", "contents": "c",
              "excerpts": [{"text": "t"}], "composed": [{"id": "c", "label": "l", "tradition": "critical", "earliest": 1, "latest": 2, "summary": "s"}]},
}


def files(spark, *docs, name="events"):
    rows = [(f"{d['id']}.json" if isinstance(d, dict) and isinstance(d.get("id"), str) else "ev-one.json", d if isinstance(d, str) or d is None else json.dumps(d)) for d in docs]
    return spark.createDataFrame(rows, "file string, content string")


def faults(spark, doc, kind="events"):
    return {(r["path"], r["problem"]) for r in E.problems(files(spark, doc), E.KINDS[kind]).collect()}


def changed(path, value):
    """The event with one value replaced (or removed, for Ellipsis)."""
    doc = json.loads(json.dumps(EVENT))
    *way, last = path
    at = doc
    for step in way:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return doc


def test_every_kind_has_a_document_without_a_fault(spark):
    assert sorted(SAMPLES) == sorted(E.KINDS)
    for kind, doc in SAMPLES.items():
        assert faults(spark, doc, kind) == set(), kind
        got = E.documents(files(spark, doc), E.KINDS[kind]).collect()
        assert len(got) == 1 and got[0]["kind"] == kind


MUTATIONS = [
    (("title",), ..., {("title", "missing")}), (("title",), "  ", {("title", "empty")}), (("title",), 7, {("title", "wrong type bigint")}),
    (("earliest_yr",), 3, {("earliest_yr", "unknown key")}), (("segment",), None, {("segment", "wrong type void")}), (("segment",), "", set()),
    (("axis",), "sideways", {("axis", "unknown value sideways")}), (("positions",), [], {("positions", "needs an entry")}),
    (("positions",), {}, {("positions", "wrong type object")}), (("positions", 0), "x", {("positions[0]", "is no object")}),
    (("positions", 0, "earliest"), "4", {("positions[0].earliest", "wrong type string")}), (("positions", 0, "earliest"), True, {("positions[0].earliest", "wrong type boolean")}),
    (("positions", 0, "earliest"), 1.5, {("positions[0].earliest", "wrong type decimal")}),
    (("positions", 0, "citations"), ..., {("positions[0].citations", "missing")}), (("positions", 0, "citations"), [], {("positions[0].citations", "needs an entry")}),
    (("positions", 0, "arguments", 0, "stance"), "maybe", {("positions[0].arguments[0].stance", "unknown value maybe")}),
    (("positions", 0, "arguments", 0, "citations", 1, "page"), 4, {("positions[0].arguments[0].citations[1].page", "unknown key")}),
    (("positions", 0, "arguments", 0, "citations", 1, "source"), ..., {("positions[0].arguments[0].citations[1].source", "missing")}),
    (("books",), ["Gen", 4, " "], {("books[1]", "wrong type or empty"), ("books[2]", "wrong type or empty")}),
    (("attestations", 0, "relation"), "none", {("attestations[0].relation", "unknown value none")}),
    (("id",), "Ev One", {("id", "bad id")}),
]


def test_every_mutation_is_found_at_its_path_alone(spark):
    docs = spark.createDataFrame([(i, f"{changed(p, v).get('id')}.json", json.dumps(changed(p, v))) for i, (p, v, _) in enumerate(MUTATIONS)], "n int, file string, content string")
    kind = E.KINDS["events"]
    numbered = docs.withColumn("file", F.concat("file", F.lit("")))
    found = {}
    for i in range(len(MUTATIONS)):
        found[i] = set()
    for r in E._checked(numbered, kind, "content").select("n", F.inline("_faults")).collect():
        found[r["n"]].add((r["path"], r["problem"]))
    for i, (path, value, want) in enumerate(MUTATIONS):
        assert found[i] == want, (path, value, found[i])


def test_broken_files_and_names(spark):
    assert faults(spark, "{oops") == {("", "not valid JSON")} and faults(spark, None) == {("", "not valid JSON")}
    assert faults(spark, "[1]") == {("", "is no object")}
    other = spark.createDataFrame([("ev-two.json", json.dumps(EVENT))], "file string, content string")
    assert [(r["path"], r["problem"]) for r in E.problems(other, E.KINDS["events"]).collect()] == [("id", "is not the file name")]
    assert E.problems(other.limit(0), E.KINDS["events"]).count() == 0 and E.documents(other, E.KINDS["events"]).count() == 0


def test_entries_of_any_depth_and_tidy_texts(spark):
    kind = E.KINDS["events"]
    docs = E.documents(files(spark, EVENT), kind)
    assert docs.select("doc.title").first()[0] == "An event"
    got = [(r["ordinal"], r["path"], r["source"]) for r in E.entries(docs, kind, "citations").orderBy("ordinal").collect()]
    assert got == [(0, "positions[0].citations[0]", "src-a"), (1, "positions[0].arguments[0].citations[0]", "src-a"),
                   (2, "positions[0].arguments[0].citations[1]", "src-b"), (3, "attestations[0].citations[0]", "src-a")]
    assert [r["path"] for r in E.entries(docs, kind, "verses").orderBy("ordinal").collect()] == ["verses[0]", "positions[0].arguments[0].verses[0]"]
    person = E.KINDS["persons"]
    assert E.entries(E.documents(files(spark, SAMPLES["persons"]), person), person, "verses").count() == 0
    with pytest.raises(ValueError):
        E.entries(docs, E.KINDS["investigations"], "verses")
