import unicodedata

import pytest
from pyspark.sql import functions as F

from canonframe.functions import morphology as Mo, references as R, text as T
from canonframe.operators import words as Wd

BOOKS = [
    (1, "Gen", "Genesis", "Gen", 50, 50, False, "chapter-verse"), (2, "Exod", "Exodus", "Exod", 40, 40, False, "chapter-verse"),
    (19, "Ps", "Psalms", "Ps", 150, 150, False, "chapter-verse"), (22, "Song", "Song of Solomon", "Song", 8, 8, False, "chapter-verse"),
    (43, "John", "John", "Jn", 21, 21, False, "chapter-verse"), (45, "Rom", "Romans", "Rom", 16, 16, False, "chapter-verse"),
    (46, "1Cor", "1 Corinthians", "1 Cor", 16, 16, False, "chapter-verse"), (62, "1John", "1 John", "1 Jn", 5, 5, False, "chapter-verse"),
    (65, "Jude", "Jude", "Jude", 1, 1, False, "chapter-verse"), (84, "Ps151", "Psalm 151", "Ps 151", 1, 1, False, "chapter-verse"),
    (70, "Sir", "Sirach", "Sir", 51, 51, True, "chapter-verse"), (110, "Herm", "Shepherd of Hermas", "Herm", 27, 210, False, "part-chapter"),
    (69, "AddEsth", "Additions to Esther", "AddEsth", 7, 16, False, "chapter-verse"),
]
SCHEMA = "book_id long, osis_id string, name string, abbreviation string, chapter_count long, last_chapter long, has_prologue boolean, numbering string"


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, SCHEMA)


CASES = [
    ("John 3:16", 43003016, 43003016, None), ("Jn 3:16-18", 43003016, 43003018, None), ("John 3:16-4:2", 43003016, 43004002, None),
    ("Gen 1:1-Exod 2:3", 1001001, 2002003, None), ("John 3", 43003001, 43003999, None), ("John", 43001001, 43999999, None),
    ("1 John 2:1", 62002001, 62002001, None), ("I John 2:1", 62002001, 62002001, None), ("First John 2:1", 62002001, 62002001, None),
    ("1jn 2:1", 62002001, 62002001, None), ("Rom 8:28", 45008028, 45008028, None), ("Romans 8", 45008001, 45008999, None),
    ("John.3.16", 43003016, 43003016, None), ("1Cor.13", 46013001, 46013999, None), ("John.3.16-18", 43003016, 43003018, None),
    ("John.3.16-4.2", 43003016, 43004002, None), ("Jude 5", 65001005, 65001005, None), ("Jude", 65001001, 65999999, None),
    ("Jude.5", 65001005, 65001005, None), ("Song of Songs 2:1", 22002001, 22002001, None), ("John 3-5", 43003001, 43005999, None),
    ("John 3:18-16", 43003016, 43003018, None), ("Ps 151", 84001001, 84999999, None), ("Psalm 151:3", 84001003, 84001003, None),
    ("Sirach prologue", 70001000, 70001000, None), ("Sir", 70001000, 70999999, None), ("Hermas Mandate 4:1", 110104001, 110104001, None),
    ("Shepherd of Hermas Parable 10", 110210001, 110210999, None), ("Herm Vision 6", None, None, "part-range"),
    ("AddEsth 16:1", 69016001, 69016001, None), ("AddEsth 17:1", None, None, "chapter-range"),
    ("John 22:1", None, None, "chapter-range"), ("John 3:1000", None, None, "unit-range"), ("John 0:1", None, None, "chapter-range"),
    ("Nowhere 3:16", None, None, "unknown-book"), ("3:16", None, None, "unparsed"), ("   ", None, None, "empty"),
    ("grace and truth", None, None, "unknown-book"), ("John 3:16-99999999999999999999", None, None, "unit-range"),
]


def test_reference_parsing(spark, books):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    rows = {r.i: r for r in R.parse_references(df, "raw", books).collect()}
    got = [(CASES[i][0], rows[i].ref_start, rows[i].ref_end, rows[i].ref_error) for i in range(len(CASES))]
    assert got == CASES


def test_aliases_and_beginnings(spark, books):
    keys = {r["key"]: r.osis_id for r in R.alias_table(books).collect()}
    assert [keys.get(k) for k in ("gn", "genes", "jn", "joh", "ecclesiasticus", "sirac", "1jn", "shepherd")] == [
        "Gen", "Gen", "John", "John", "Sir", "Sir", "1John", "Herm"]
    assert "jo" not in keys or keys["jo"] == "John"            # a shared beginning belongs to nobody
    forms = ["II. Peter", "2nd Peter", "second Peter", "2 Pet.", "2PETER"]
    got = spark.createDataFrame([(f,) for f in forms], "n string").select(R.book_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["2peter", "2peter", "2peter", "2pet", "2peter"]


def test_reference_list_inherits_context(spark, books):
    df = spark.createDataFrame([(1, "John 3:16, 18-20; Rom 8; Jn 1:1"), (2, "18, John 3:1")], "k int, t string")
    got = [(r.k, r["raw"], r.ref_start, r.ref_end, r.ref_error) for r in R.parse_reference_lists(df, "k", "t", books).orderBy("k", "item").collect()]
    assert got == [(1, "John 3:16", 43003016, 43003016, None), (1, "18-20", 43003018, 43003020, None), (1, "Rom 8", 45008001, 45008999, None),
                   (1, "Jn 1:1", 43001001, 43001001, None), (2, "18", None, None, "unparsed"), (2, "John 3:1", 43003001, 43003001, None)]


def test_formatting_round_trip(spark, books):
    rows = [(43003016, 43003016, "John 3:16", "John.3.16"), (43003016, 43003018, "John 3:16–18", "John.3.16-18"), (45008001, 45008999, "Romans 8", "Rom.8.1-999"),
            (65001001, 65999999, "Jude", "Jude.1.1-999.999"), (43003016, 43004002, "John 3:16–4:2", "John.3.16-4.2"), (1001001, 2002003, "Genesis 1:1–Exodus 2:3", "Gen.1.1-Exod.2.3"),
            (43003001, 43005999, "John 3–5", "John.3.1-5.999"), (99001001, 99001001, "99.1.1", "99.1.1")]
    out = R.format_ranges(spark.createDataFrame([r[:2] for r in rows], "s long, e long"), "s", "e", books).collect()
    assert {(r.s, r.e, r.label, r.slug) for r in out} == set(rows)


def test_fold_agrees_with_general_form(spark):
    words = ["λόγος", "Ἰησοῦ", "חֶ֫סֶד", "ÉtÉ", "Åse", "naïve", "été", "ſtraße", "Œuvre", "Ǖ", "şi", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", T.fold("w").alias("a"), T.nfd_fold("w").alias("b"), T.search_form("w").alias("s"), T.nfc("w").alias("c")).collect()
    assert all(r.a == r.b and r.c == unicodedata.normalize("NFC", r.w) for r in rows)
    s = {r.w: r.s for r in rows}
    assert s["λόγος"] == "λογος" and s["Ἰησοῦ"] == "ιησου" and s["חֶ֫סֶד"] == "חסד"


def test_every_base_letter_matches_nfd(spark):
    source, target = T._base_letters()
    assert len(source) == len(target) > 500
    for a, b in zip(source, target):
        assert "".join(c for c in unicodedata.normalize("NFD", a) if not 0x300 <= ord(c) <= 0x36f) == b


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
             "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "formalize": "formal", "electrical": "electr",
             "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "effective": "effect", "probate": "probat",
             "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener"}
    assert {w: T.porter(w) for w in pairs} == pairs


def test_normalize_and_first_sentence(spark):
    rows = [("a /f + \\ft note\n/f* b", "a b"), ("The windblows where,it  wills.Then", "The wind blows where, it wills. Then"), ("  x  y ", "x y")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    assert [r[0] for r in df.select(T.normalize_unit("t")).collect()] == [r[1] for r in rows]
    g = spark.createDataFrame([("One. Two.",), ('He said "no." Then',), ("x" * 10 + " " + "y" * 200,), ("no end",)], "t string")
    assert [r[0] for r in g.select(T.first_sentence("t")).collect()] == ["One.", 'He said "no."', "x" * 10 + "…", "no end"]


def test_entities(spark):
    df = spark.createDataFrame([("a &amp; b &lt;c&gt; &#8220;x&#x201D; &quot;",)], "t string")
    assert df.select(T.decode_entities("t")).first()[0] == 'a & b <c> “x” "'


def test_morphology(spark):
    rows = [("HR/Ncfsa", "hbo", "preposition  +  noun · common · feminine · singular · absolute"), ("HVqp3ms", "hbo", "verb · qal · perfect · 3rd person · masculine · singular"),
            ("AVqp3ms", "hbo", "verb · peal · perfect · 3rd person · masculine · singular"), ("HVqrmsa", "hbo", "verb · qal · participle active · masculine · singular · absolute"),
            ("HVqc", "hbo", "verb · qal · infinitive construct"), ("N- ----NSF-", "grc", "noun · nominative · singular · feminine"), ("V- 3PAI-S--", "grc", "verb · 3rd person · present · active · indicative · singular"),
            ("HX", "hbo", "X"), ("Vqp3ms", "arc", "verb · peal · perfect · 3rd person · masculine · singular"), ("??", "grc", "??")]
    df = spark.createDataFrame(rows, "code string, lang string, want string")
    for r in df.select("code", "want", Mo.label(F.col("code"), F.col("lang")).alias("got")).collect():
        assert r.got == r.want, r.code


HESED, OLE, ATNAH = "חֶסֶד", "חֶ֫סֶד", "חֶסֶד֑"


def test_forms_merge_accents_only(spark):
    other = "חַסִיד"
    rows = [("k", ATNAH, "HNcmsa", 12), ("k", OLE, "HNcmsa", 11), ("k", HESED, "HNcmsa", 8), ("k", HESED, "HNcmsc", 3), ("k", other, "HNcmsa", 20)]
    counts = spark.createDataFrame(rows, "lemma string, surface string, morph string, count long")
    forms = Wd.group_forms(counts, "lemma", T.accent_fold("surface", F.lit("hbo"))).collect()
    got = {(f.surface, f.morph): (f["count"], [v.surface for v in f.variants]) for f in forms}
    assert got == {(ATNAH, "HNcmsa"): (31, [ATNAH, OLE, HESED]), (HESED, "HNcmsc"): (3, [HESED]), (other, "HNcmsa"): (20, [other])}
    greek = spark.createDataFrame([("τίς",)], "w string").select(T.accent_fold("w", F.lit("grc"))).first()[0]
    assert greek == "τίς"


def test_dictionary_keys(spark):
    df = spark.createDataFrame([("H430",), (" h2617 A ",), ("430",), ("A5020",), ("G26",), ("x",), ("H0430",)], "r string")
    got = [tuple(r) for r in df.select(Wd.corpus_key(F.col("r")), Wd.lexicon_key(F.col("r"))).collect()]
    assert got == [("H430", "H430"), ("H2617a", None), ("H430", "H430"), ("A5020", "H5020"), ("G26", None), (None, None), ("H430", "H430")]
    lem = spark.createDataFrame([("c/d/776", "hbo"), ("b/1254 a", "arc"), ("c/l", "hbo")], "l string, g string")
    assert [r[0] for r in lem.select(Wd.head_lemma_key(F.col("l"), F.col("g"))).collect()] == ["H776", "A1254a", None]
