import json

import pytest
from pyspark.sql import functions as F

from canonframe.operators import gates as G
from canonframe.sinks import publish as Pu
from canonframe.sources import parsers as Ps, placement as Pl


def test_tab_text_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿# a comment\n# book: Testament of Levi\r\n1:1\tFirst.\n\nbad line\n# book: Dan\n2:1\tSecond.\n")
    units, bad = Ps.tab_text(Ps.lines_of(Ps.read_files(spark, str(tmp_path / "*.txt"))))
    assert [tuple(r) for r in units.orderBy("line_no").select("line_no", "part", "ref", "text").collect()] == [(3, "Testament of Levi", "1:1", "First."), (7, "Dan", "2:1", "Second.")]
    assert [tuple(r) for r in bad.select("line_no", "line").collect()] == [(5, "bad line")]


def test_milestones_notes_and_welds(spark):
    xml = ('<book id="GEN"><h>Genesis</h><c id="1"/>Before.<v id="1" bcv="GEN.1.1"/>In the <w>begin</w>ning<f caller="+"><fr>1:1</fr><ft>Or <fq>when</fq></ft></f> &amp; so.'
           '<ve/>heading<v id="2" bcv="GEN.1.2"/>And¶it<x caller="-"> </x> was.<c id="2"/>x<v id="1" bcv="EXO.2.1"/>bad</book>')
    df = spark.createDataFrame([("f", xml)], "file string, content string")
    u = Ps.milestone_units(df).orderBy("seq").collect()
    assert [(r.ref, r.text, r.error) for r in u] == [("GEN.1.1", "In the beginning & so.", None), ("GEN.1.2", "And it was.", None), ("EXO.2.1", "bad", "reference and book disagree")]
    notes = Ps.milestone_units(df).select("ref", F.explode(Ps.notes(F.col("raw"))).alias("n")).collect()
    assert [(r.ref, r.n.kind, r.n.caller, r.n.text) for r in notes] == [("GEN.1.1", "footnote", "+", "1:1Or when")]
    assert Ps.prologues(df).first().text == "Before."
    welds = spark.createDataFrame([("wind<f>note</f>blows<f>n</f> x", 1), ("a <f>n</f>b", 0), ("give<f/>n", 1),
                                   ("x<f>y</f> z <f>w</f>q", 0), ("a<f>1</f><f>2</f>b", 0), ("a<f>1</f>b<f>2</f>c", 2), ("", 0), (None, None), ("a\ue000b", 0)], "x string, n long")
    assert all(r.got == r.n for r in welds.select("n", Ps.weld_sites(F.col("x"), ["f"]).alias("got")).collect())
    nested = spark.createDataFrame([("a<x> b<f>n</f>c </x>d",), ("a<f>1</f><x/>b",)], "x string")
    # The inner note goes first and joins b with c; then the outer one joins a with d.  An empty mark left alone joins too.
    assert [r[0] for r in nested.select(Ps.weld_sites(F.col("x"), ["f", "x"])).collect()] == [2, 1]


def test_html_pages(spark):
    html = "<p>One. <strong>7</strong> Two &amp; more.</p><p>Three<br/>x</p><p><strong>8</strong>Four</p>"
    rows = Ps.html_units(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html").collect()
    assert sorted((r.page, r.ordinal, r.text) for r in rows) == [(0, 1, "One."), (7, 1, "Two & more."), (7, 2, "Three x"), (8, 1, "Four")]


def test_welded_split(spark):
    u = spark.createDataFrame([(1, "one. Now two; but three"), (2, "Now Now but"), (3, "but Now"), (4, "Now but x")], "id long, text string")
    a = u.select("id", F.posexplode(F.array(F.lit("Now"), F.lit("but"))).alias("p", "anchor")).select("id", (F.col("p") + 1).alias("seq"), "anchor")
    got = {(r.id, r.piece): (r.text, r.error) for r in Pl.split_welded(u, a, "id").collect()}
    assert [got[(1, i)][0] for i in range(3)] == ["one. ", "Now two; ", "but three"] and got[(1, 0)][1] is None
    assert got[(2, 0)][1] == "anchor must occur exactly once" and got[(3, 0)][1] == "anchors out of order" and got[(4, 0)][1] == "empty piece"


def test_artifacts(spark):
    u = spark.createDataFrame([(1, "the windblows here"), (2, " "), (3, "end.Then /f* x"), (4, "Windblows fine")], "id long, text string")
    v = spark.createDataFrame([(w,) for w in "wind blows the here fine end then".split()], "word string")
    got = sorted((r.id, r.kind, r.detail) for r in Pl.text_artifacts(u, ["id"], v).collect())
    assert got == [(1, "welded-words", "windblows -> wind blows"), (2, "empty", "text is empty"), (3, "markup-residue", "/f*"), (3, "welded-punctuation", "end.Then")]


def test_entity_documents(spark, tmp_path):
    (tmp_path / "ev-1.json").write_text(json.dumps({"id": "ev-1", "title": "x"}))
    (tmp_path / "ev-2.json").write_text(json.dumps({"id": "ev-2", "title": "x", "earliest_yr": 3}))
    (tmp_path / "ev-3.json").write_text(json.dumps({"id": "other", "title": "x"}))
    (tmp_path / "ev-4.json").write_text("not json")
    docs, bad = Ps.entity_documents(Ps.read_files(spark, str(tmp_path)), "id string, title string")
    assert [r.id for r in docs.collect()] == ["ev-1"]
    assert {(r.file, r.problem) for r in bad.collect()} >= {("ev-2.json", "unknown key earliest_yr"), ("ev-3.json", "id is not the file name"), ("ev-4.json", "not an object")}


def test_failed_gate_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    first = Pu.StagedBuild(spark, root, "b1")
    df = first.write("t", spark.createDataFrame([(1,), (2,)], "a long"))
    first.promote([("repeated", G.repeated(df, ["a"]))])
    assert Pu.current_build(spark, root) == "b1"
    second = Pu.StagedBuild(spark, root, "b2")
    df = second.write("t", spark.createDataFrame([(1,), (1,), (None,)], "a long"))
    with pytest.raises(Pu.GateFailure) as e:
        second.promote([("repeated", G.repeated(df, ["a"])), ("null", G.broken(df, F.col("a") > 0)), ("fine", df.where("a > 5"))])
    assert sorted(e.value.violations) == [("null", 1), ("repeated", 1)]
    assert Pu.current_build(spark, root) == "b1"


def test_fingerprint_moves_on_equal_length_change_only(spark):
    rows = [(i, "ab", None if i % 3 else "c") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    base = Pu.fingerprint(df, ["i", "a", "b"], 3).first()
    assert Pu.fingerprint(df.repartition(7).orderBy(F.desc("i")), ["i", "a", "b"], 3).first() == base
    changed = df.withColumn("a", F.when(F.col("i") == 7, "ba").otherwise(F.col("a")))
    assert Pu.fingerprint(changed, ["i", "a", "b"], 3).first() != base
    moved = df.withColumn("b", F.when(F.col("i") == 1, "").otherwise(F.col("b")))
    assert Pu.fingerprint(moved, ["i", "a", "b"], 3).first() != base
    assert Pu.fingerprint(df.union(df.where("i = 1")), ["i", "a", "b"], 3).first() != base


def test_urls_are_split_by_size(spark, tmp_path):
    urls = spark.range(25).select(F.lit("e").alias("edition"), F.concat(F.lit("/u"), F.col("id").cast("string")).alias("url"))
    Pu.write_urls(urls, str(tmp_path / "u"), per_file=10)
    files = list((tmp_path / "u" / "edition=e").glob("*.txt"))
    assert len(files) >= 3 and sum(len(f.read_text().split()) for f in files) == 25


def test_index_entries_leave_their_part_behind(spark):
    """An entry's row holds neither the text of its part nor a search in it, so the work grows with the text and not with its square."""
    part = '<part xml:lang="{}">{}</part>'
    entry = '<entry id="x"><w xlit="x">w{0}</w><pos>N</pos><def>d</def><xref bdb="b" twot="t" strong="{0}"/></entry>'
    files = spark.createDataFrame([("f", part.format("heb", entry.format(1) + entry.format(2)) + part.format("arc", entry.format(3)) + part.format("arc", "")), ("g", "")], "file string, content string")
    rows = Ps.index_entries(files)
    assert sorted((r.file, r.part_no, r.seq, r.entry_key, r.language, r.headword) for r in rows.collect()) == [
        ("f", 0, 0, "H1", "hbo", "w1"), ("f", 0, 1, "H2", "hbo", "w2"), ("f", 1, 0, "H3", "arc", "w3")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "_part" not in above and "_part" not in next(line for line in plan.splitlines() if "Generate" in line), plan
    assert plan.count("</entry>)") == 1, plan
