"""Nested entity documents: one JSON document a file, checked against a declared schema at every depth.

A kind of document is a Spark schema: ``NOT NULL`` marks required keys.  What a
schema cannot say (allowed words, lists that need an entry) is declared by
path beside it.  ``problems`` walks the parsed variant along the schema and
reports each fault with its path, so a misspelt optional key cannot vanish;
``documents`` returns the typed documents without a fault.  Both are column
expressions: no shuffle, one pass over the files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

ID_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"
FAULT = "array<struct<path:string,problem:string>>"


@dataclass(frozen=True)
class Kind:
    """``words``: path -> allowed values; ``filled``: paths of lists that need an entry; ``own_file``: the id is the file's name."""
    name: str
    ddl: str
    words: dict[str, list[str]] = field(default_factory=dict)
    filled: frozenset[str] = frozenset()
    own_file: bool = True

    @cached_property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


def _json_kind(v: Column) -> Column:
    """STRING, BIGINT, ARRAY, OBJECT, ... of a variant; a JSON null is VOID."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _expected(t: DataType) -> str:
    if isinstance(t, StructType):
        return "OBJECT"
    if isinstance(t, ArrayType):
        return "ARRAY"
    return {LongType: "BIGINT", StringType: "STRING"}[type(t)]


def _none() -> Column:
    return F.array().cast(FAULT)


def _fault(path: Column, problem: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem")))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


RULE = "array<struct<name:string,kind:string,required:boolean,filled:boolean,words:array<string>>>"


def _walk(v: Column, schema: StructType, kind: Kind, name: str) -> Column:
    """Faults of one object, with paths from it on.  ``name``: its place in the declared tree.

    The rules of its keys are data, so the expression grows with nested tables alone.
    """
    rules = F.from_json(F.lit(json.dumps([{
        "name": f.name, "kind": _expected(f.dataType), "required": not f.nullable, "filled": f"{name}{f.name}" in kind.filled,
        "words": kind.words.get(f"{name}{f.name}")} for f in schema.fields])), RULE)

    def of(keys: Column) -> Column:
        unknown = F.transform(F.array_except(F.map_keys(keys), F.transform(rules, lambda r: r["name"])),
                              lambda k: F.struct(k.alias("path"), F.lit("unknown key").alias("problem")))
        own = F.transform(rules, lambda r: _once(F.try_element_at(keys, r["name"]), lambda item: _problem(item, r)))
        return F.concat(unknown, F.filter(own, lambda x: x["problem"].isNotNull()), *[
            _nested(F.try_element_at(keys, F.lit(f.name)), f, kind, f"{name}{f.name}") for f in schema.fields
            if isinstance(f.dataType, StructType | ArrayType)])
    return _once(F.try_variant_get(v, "$", "map<string,variant>"), of)


def _problem(item: Column, r: Column) -> Column:
    """What is wrong with the value of one key itself."""
    text = F.try_variant_get(item, "$", "string")
    problem = (F.when(item.isNull(), F.when(r["required"], F.lit("missing")))
               .when(_json_kind(item) != r["kind"], F.concat(F.lit("wrong type "), F.lower(_json_kind(item))))
               .when(r["required"] & (r["kind"] == "STRING") & (F.trim(text) == ""), F.lit("empty"))
               .when(r["words"].isNotNull() & ~F.array_contains(r["words"], text), F.concat(F.lit("unknown value "), text))
               .when(r["filled"] & (F.size(F.try_variant_get(item, "$", "array<variant>")) == 0), F.lit("needs an entry")))
    return F.struct(r["name"].alias("path"), problem.alias("problem"))


def _nested(item: Column, f: StructField, kind: Kind, name: str) -> Column:
    """Faults inside a table, or inside the entries of a list."""
    t = f.dataType
    if isinstance(t, StructType):
        return _below(F.lit(f"{f.name}."), F.when(_json_kind(item) == "OBJECT", _walk(item, t, kind, f"{name}.")))
    child = t.elementType

    def entry(e, i):
        place = F.concat(F.lit(f"{f.name}["), i.cast("string"), F.lit("]"))
        if isinstance(child, StructType):
            return F.when(_json_kind(e) != "OBJECT", _fault(place, "is no object")).otherwise(
                _below(F.concat(place, F.lit(".")), _walk(e, child, kind, f"{name}.")))
        bad = _json_kind(e) != _expected(child)
        if isinstance(child, StringType):
            bad = bad | (F.trim(F.try_variant_get(e, "$", "string")) == "")
        return F.when(bad, _fault(place, "wrong type or empty")).otherwise(_none())
    return F.coalesce(F.flatten(F.transform(F.try_variant_get(item, "$", "array<variant>"), entry)), _none())


def _below(place: Column, faults: Column) -> Column:
    return F.coalesce(F.transform(faults, lambda x: F.struct(F.concat(place, x["path"]).alias("path"), x["problem"].alias("problem"))), _none())


def _file_faults(v: Column, kind: Kind) -> Column:
    faults = _walk(v, kind.schema, kind, "")
    if kind.own_file:
        ident, stem = F.try_variant_get(v, "$.id", "string"), F.regexp_replace("file", r"\.[a-z]+$", "")
        faults = F.concat(faults, F.when(ident != stem, _fault(F.lit("id"), "is not the file name")).otherwise(_none()),
                          F.when(~ident.rlike(ID_PATTERN), _fault(F.lit("id"), "bad id")).otherwise(_none()))
    return F.when(v.isNull(), _fault(F.lit(""), "not valid JSON")).when(_json_kind(v) != "OBJECT", _fault(F.lit(""), "is no object")).otherwise(faults)


def _checked(files: DataFrame, kind: Kind, content: str) -> DataFrame:
    return files.withColumn("_faults", _once(F.try_parse_json(content), lambda v: _file_faults(v, kind)))


def problems(files: DataFrame, kind: Kind, content: str = "content") -> DataFrame:
    """(kind, file, path, problem): every fault of every document.  ``files``: file, content."""
    # outer: an inner one would be given a filter that computes all faults once more
    return (_checked(files, kind, content).select("file", F.inline_outer("_faults")).where(F.col("problem").isNotNull())
            .select(F.lit(kind.name).alias("kind"), "file", "path", "problem"))


def documents(files: DataFrame, kind: Kind, content: str = "content") -> DataFrame:
    """(kind, file, doc): the documents without a fault, typed by the declared schema; texts lose outer white space."""
    good = _checked(files, kind, content).where(F.size("_faults") == 0)
    return good.select(F.lit(kind.name).alias("kind"), "file", _tidy(F.from_json(content, kind.schema), kind.schema).alias("doc"))


def _tidy(c: Column, t: DataType) -> Column:
    if isinstance(t, StringType):
        return F.trim(c)
    if isinstance(t, ArrayType):
        return F.transform(c, lambda e: _tidy(e, t.elementType))
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_tidy(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c


def gather(doc: Column, schema: StructType, name: str) -> Column:
    """All entries of the lists called ``name`` at any depth, as array<struct<path, entry>> in the order of the schema; None without one."""
    return _gather(doc, schema, name, F.lit(""))


def _gather(doc: Column, schema: StructType, name: str, at: Column) -> Column | None:
    found = []
    for f in schema.fields:
        t, item, here = f.dataType, doc[f.name], F.concat(at, F.lit(f.name))
        if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            if f.name == name:
                found.append(F.transform(item, lambda e, i: F.struct(F.concat(here, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), e.alias("entry"))))
            elif holds(t.elementType, name):
                found.append(F.flatten(F.transform(item, lambda e, i: _gather(
                    e, t.elementType, name, F.concat(here, F.lit("["), i.cast("string"), F.lit("]."))))))
        elif isinstance(t, StructType) and holds(t, name):
            found.append(_gather(item, t, name, F.concat(here, F.lit("."))))
    if not found:
        return None
    return F.flatten(F.array_compact(F.array(*found)))


def holds(schema: StructType, name: str) -> bool:
    for f in schema.fields:
        t = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        if isinstance(t, StructType) and ((isinstance(f.dataType, ArrayType) and f.name == name) or holds(t, name)):
            return True
    return False


def entries(docs: DataFrame, kind: Kind, name: str) -> DataFrame:
    """(kind, id, ordinal, path, entry fields...): the entries of all lists called ``name``, one row each."""
    found = gather(F.col("doc"), kind.schema, name)
    if found is None:
        raise ValueError(f"{kind.name} has no list {name}")
    return (docs.select("kind", F.col("doc.id").alias("id"), F.posexplode(found).alias("ordinal", "_e"))
            .select("kind", "id", F.col("ordinal").cast("bigint").alias("ordinal"), "_e.path", "_e.entry.*"))


# Key names, required keys and allowed words of the eight kinds of documents.
_CITATIONS = "ARRAY<STRUCT<source: STRING NOT NULL, locator: STRING>>"
_VERSES = "ARRAY<STRUCT<ref: STRING NOT NULL, link: STRING NOT NULL, note: STRING>>"
_ATTESTATIONS = f"ARRAY<STRUCT<artifact: STRING NOT NULL, relation: STRING NOT NULL, note: STRING NOT NULL, citations: {_CITATIONS} NOT NULL>>"
_YEARS = "STRUCT<earliest: BIGINT NOT NULL, latest: BIGINT NOT NULL>"
STATUSES = ["draft", "sources-located", "claims-checked", "expert-reviewed"]
TRADITIONS = ["critical", "archaeological", "chronological", "traditional"]
RELATIONS = ["corroborates", "partially-corroborates", "consistent", "silent", "in-tension"]
LINK_TYPES = ["describes", "alludes", "background", "dates", "names"]

KINDS = {k.name: k for k in [
    Kind("sources", (
        "source ARRAY<STRUCT<id: STRING NOT NULL, kind: STRING NOT NULL, title: STRING NOT NULL, author: STRING, container: STRING, publisher: STRING, "
        "year: BIGINT, url: STRING, isbn: STRING>>"),
        {"source.kind": ["book", "chapter", "article", "edition", "museum", "web"]}, own_file=False),
    Kind("eras", (
        f"era ARRAY<STRUCT<id: STRING NOT NULL, name: STRING NOT NULL, start: BIGINT NOT NULL, `end`: BIGINT NOT NULL, summary: STRING NOT NULL, citations: {_CITATIONS} NOT NULL>>"),
        filled=frozenset({"era.citations"}), own_file=False),
    Kind("artifacts", (
        f"id STRING NOT NULL, name STRING NOT NULL, kind STRING NOT NULL, status STRING NOT NULL, made {_YEARS}, language STRING NOT NULL, summary STRING NOT NULL, "
        f"citations {_CITATIONS} NOT NULL, discovered STRUCT<year: BIGINT, place: STRING>, held_by STRUCT<institution: STRING NOT NULL, accession: STRING>, verses {_VERSES}"),
        {"kind": ["inscription", "chronicle", "relief", "papyrus", "ostracon", "manuscript", "seal", "coin", "site", "literary-text"], "status": STATUSES,
         "verses.link": LINK_TYPES}, frozenset({"citations"})),
    Kind("events", (
        "id STRING NOT NULL, title STRING NOT NULL, axis STRING NOT NULL, category STRING NOT NULL, confidence STRING NOT NULL, status STRING NOT NULL, summary STRING NOT NULL, "
        f"books ARRAY<STRING>, segment STRING, verses {_VERSES}, positions ARRAY<STRUCT<id: STRING NOT NULL, label: STRING NOT NULL, tradition: STRING NOT NULL, "
        "earliest: BIGINT NOT NULL, latest: BIGINT NOT NULL, summary: STRING NOT NULL, held_by: STRING, dates: STRING, "
        f"citations: {_CITATIONS} NOT NULL, arguments: ARRAY<STRUCT<stance: STRING NOT NULL, text: STRING NOT NULL, citations: {_CITATIONS} NOT NULL, verses: {_VERSES}>>>> NOT NULL, "
        f"attestations {_ATTESTATIONS}"),
        {"axis": ["narrative", "composition", "canon"], "category": ["biblical-narrative", "political", "composition", "canon"],
         "confidence": ["firm", "contested", "speculative"], "status": STATUSES, "verses.link": LINK_TYPES, "positions.tradition": TRADITIONS,
         "positions.dates": ["event", "composition"], "positions.arguments.stance": ["for", "against"], "positions.arguments.verses.link": LINK_TYPES,
         "attestations.relation": RELATIONS},
        frozenset({"positions", "positions.citations", "positions.arguments.citations", "attestations.citations"})),
    Kind("issues", (
        "id STRING NOT NULL, kind STRING NOT NULL, title STRING NOT NULL, summary STRING NOT NULL, status STRING NOT NULL, events ARRAY<STRING>, persons ARRAY<STRING>, "
        f"verses {_VERSES}, citations {_CITATIONS} NOT NULL, views ARRAY<STRUCT<label: STRING NOT NULL, text: STRING NOT NULL, citations: {_CITATIONS} NOT NULL>> NOT NULL"),
        {"kind": ["chronology", "textual", "historical", "internal"], "status": STATUSES, "verses.link": LINK_TYPES}, frozenset({"citations", "views", "views.citations"})),
    Kind("persons", (
        f"id STRING NOT NULL, name STRING NOT NULL, role STRING NOT NULL, summary STRING NOT NULL, status STRING NOT NULL, citations {_CITATIONS} NOT NULL, "
        f"also_known_as ARRAY<STRING>, lived {_YEARS}, verses {_VERSES}, events ARRAY<STRING>, attestations {_ATTESTATIONS}"),
        {"status": STATUSES, "verses.link": LINK_TYPES, "attestations.relation": RELATIONS}, frozenset({"citations", "attestations.citations"})),
    Kind("investigations", (
        "id STRING NOT NULL, title STRING NOT NULL, status STRING NOT NULL, ref STRING NOT NULL, summary STRING NOT NULL, "
        f"witnesses ARRAY<STRUCT<siglum: STRING NOT NULL, name: STRING NOT NULL, reading: STRING NOT NULL, translation: STRING NOT NULL, language: STRING NOT NULL, note: STRING, citations: {_CITATIONS}>> NOT NULL, "
        f"editions ARRAY<STRUCT<code: STRING NOT NULL, follows: STRING NOT NULL>>, differences ARRAY<STRUCT<kind: STRING NOT NULL, text: STRING NOT NULL, held_by: STRING, citations: {_CITATIONS}>> NOT NULL, "
        f"challenges ARRAY<STRUCT<text: STRING NOT NULL, citations: {_CITATIONS}>>"),
        {"status": STATUSES, "differences.kind": ["textual", "lexical", "grammatical", "stylistic", "interpretive", "editorial"]}, frozenset({"witnesses", "differences"})),
    Kind("works", (
        "id STRING NOT NULL, title STRING NOT NULL, also_known_as ARRAY<STRING>, books ARRAY<STRING>, canon STRING NOT NULL, status STRING NOT NULL, summary STRING NOT NULL, "
        f"citations {_CITATIONS} NOT NULL, original_language STRING NOT NULL, contents STRING, verses {_VERSES}, "
        f"composed ARRAY<STRUCT<id: STRING NOT NULL, label: STRING NOT NULL, tradition: STRING NOT NULL, earliest: BIGINT NOT NULL, latest: BIGINT NOT NULL, summary: STRING NOT NULL, held_by: STRING, citations: {_CITATIONS}>>, "
        f"composed_undated STRING, provenance ARRAY<STRUCT<place: STRING NOT NULL, note: STRING, citations: {_CITATIONS}>>, "
        f"witnesses ARRAY<STRUCT<name: STRING NOT NULL, siglum: STRING, earliest: BIGINT NOT NULL, latest: BIGINT NOT NULL, language: STRING NOT NULL, institution: STRING, url: STRING, note: STRING, citations: {_CITATIONS}>>, "
        f"held_canonical_by ARRAY<STRUCT<tradition: STRING NOT NULL, note: STRING, citations: {_CITATIONS}>>, translations ARRAY<STRUCT<ledger: STRING NOT NULL, code: STRING, note: STRING>>, "
        f"excerpts ARRAY<STRUCT<text: STRING NOT NULL, note: STRING, citations: {_CITATIONS}>>, events ARRAY<STRUCT<event: STRING NOT NULL, note: STRING NOT NULL, citations: {_CITATIONS}>>"),
        {"canon": ["deuterocanon", "pseudepigrapha", "nt-apocrypha", "apostolic", "described"], "status": STATUSES, "verses.link": LINK_TYPES, "composed.tradition": TRADITIONS},
        frozenset({"citations"})),
]}
