"""Operator 7, chat formatting: linking tool calls and their results.

DataFrame functions only.  Calls and results meet by a hash join on (conv_id, call_id); calls are put into topological
levels of their references; arguments are parsed once as a variant, checked against the tool's schema and written back
as canonical JSON (keys in order, no spaces, shortest numbers).

Results of one identifier are rows, not a list, and a conversation is never gathered: the order of its calls is the pair
(level, turn), which needs no window.  Long chains of calls cost the logarithm of their length (pointer doubling).  The hot side of the join is the results'; the other side has one row per identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

CALL_COLUMNS = ("conv_id", "call_id", "turn", "name", "arguments", "after")


def _kind_of(value: Column) -> Column:
    """JSON kind of a variant: integer, number, string, boolean, array, object or null."""
    t = F.schema_of_variant(value)
    return (F.when(t.isNull(), None).when(t == "BIGINT", "integer").when(t.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
            .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "VOID", "null").otherwise("other"))


def _literal_path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def problems_of(arguments: Column, raw: Column, schema: dict) -> Column:
    """Array of problems of variant ``arguments`` under one schema, in the order of the schema's properties.

    The schema is the usual subset: ``properties`` with ``type``, ``enum``, ``minimum`` and ``maximum``; ``required``;
    ``additionalProperties``.
    """
    found = []
    for name, rule in schema.get("properties", {}).items():
        value = F.variant_get(arguments, _literal_path(name), "variant")
        kind = _kind_of(value)
        allowed = {"number": ["number", "integer"]}.get(rule.get("type"), [rule.get("type")])
        wrong = F.when(kind.isNull(), F.when(F.lit(name in schema.get("required", [])), F.lit(f"missing {name}")))
        if rule.get("type"):
            wrong = wrong.when(~kind.isin(allowed), F.lit(f"{name} is not {rule['type']}"))
        if rule.get("enum"):
            wrong = wrong.when(~F.to_json(value).isin([_json(v) for v in rule["enum"]]), F.lit(f"{name} is not allowed"))
        number = F.try_variant_get(arguments, _literal_path(name), "double")
        for key, off in (("minimum", number < rule.get("minimum", 0)), ("maximum", number > rule.get("maximum", 0))):
            if key in rule:
                wrong = wrong.when(off, F.lit(f"{name} is beyond its {key}"))
        found.append(wrong)
    if schema.get("additionalProperties", True) is False:
        extra = F.array_except(F.json_object_keys(raw), F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>"))
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), ", "))))
    return F.filter(F.array(*found), lambda p: p.isNotNull()) if found else F.array().cast("array<string>")


def _json(value) -> str:
    import json
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def check_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with ``canonical`` (canonical JSON of the arguments, null if they are none) and ``problems`` (array)."""
    v = F.try_parse_json("arguments")
    parsed = calls.withColumn("_v", v).withColumn("canonical", F.to_json("_v"))
    by_tool = F.lit(None).cast("array<string>")
    for name, schema in schemas.items():
        by_tool = F.when(F.col("name") == name, problems_of(F.col("_v"), F.col("arguments"), schema)).otherwise(by_tool)
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return (parsed.withColumn("problems", F.when(~is_object, F.array(F.lit("arguments are not an object")))
                              .otherwise(F.coalesce(by_tool, F.array(F.lit("unknown tool"))))).drop("_v"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _ends(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, stop, dist): where the chain of references from each call with one reference leads, and how far.

    ``single`` is (conv_id, call_id, ref).  The stop is the first call that is not in ``single``.  Pointer doubling: a call
    that has reached no stop takes over the pointer of the call it points at, so a chain of n calls takes log2(n) rounds.
    While a chain is left, every round ends some calls; a round that ends none leaves those on cycles, which get no row.
    """
    inner = single.select("conv_id", F.col("call_id").alias("ref"), F.lit(False).alias("_inner"))
    first = cut_lineage(single.join(inner, ["conv_id", "ref"], "left")
                        .select("conv_id", "call_id", F.col("ref").alias("stop"), F.lit(1).alias("dist"), F.coalesce("_inner", F.lit(True)).alias("done")))
    ended, going = [first.where("done")], first.where("not done")
    while not going.isEmpty():
        onward = _union([*ended, going]).select("conv_id", F.col("call_id").alias("stop"), F.col("stop").alias("_next"), F.col("dist").alias("_more"), F.col("done").alias("_done"))
        step = cut_lineage(going.join(onward, ["conv_id", "stop"])
                           .select("conv_id", "call_id", F.col("_next").alias("stop"), (F.col("dist") + F.col("_more")).alias("dist"), F.col("_done").alias("done")))
        fresh, going = step.where("done"), step.where("not done")
        if fresh.isEmpty():
            break
        ended.append(fresh)
    return _union(ended).drop("done")


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, level) of all calls whose references can be ordered, and the references to no call.

    A call without references has level 0, others one more than the highest they refer to.  Calls on a cycle, or behind
    one, get no row.  Chains of calls with one reference are contracted by pointer doubling; what is left are the calls
    that join several references, and these take one round per join on the longest way: a join and a grouped maximum.
    """
    ids = calls.select("conv_id", "call_id")
    refs = (calls.select("conv_id", "call_id", F.explode("after").alias("ref")).where("ref is not null").distinct())
    there = ids.select("conv_id", F.col("call_id").alias("ref"))
    dangling = refs.join(there, ["conv_id", "ref"], "left_anti")
    open_refs = cut_lineage(refs.join(there, ["conv_id", "ref"], "left_semi"))
    counted = open_refs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref"))
    single = cut_lineage(counted.where("n = 1").drop("n"))
    ends = cut_lineage(_ends(single))
    known = [cut_lineage(ids.join(open_refs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))]
    joining = cut_lineage(counted.where("n > 1").select("conv_id", "call_id"))
    if not joining.isEmpty():
        # references of joining calls go straight to the stops of their chains; those into a cycle go nowhere and never settle
        chained = single.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("_chained"))
        led = ends.select("conv_id", F.col("call_id").alias("ref"), "stop", "dist")
        waiting = (open_refs.join(joining, ["conv_id", "call_id"]).join(chained, ["conv_id", "ref"], "left").join(led, ["conv_id", "ref"], "left")
                   .select("conv_id", "call_id", F.when(F.col("_chained"), F.col("stop")).otherwise(F.col("ref")).alias("stop"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
                   .groupBy("conv_id", "call_id", "stop").agg(F.max("dist").alias("dist")).withColumn("reached", F.lit(None).cast("int")))
        fresh = known[0]
        while not fresh.isEmpty():
            settled = fresh.select("conv_id", F.col("call_id").alias("stop"), F.col("level").alias("_l"))
            reached = cut_lineage(waiting.join(settled, ["conv_id", "stop"], "left")
                                  .select("conv_id", "call_id", "stop", "dist", F.coalesce("reached", F.col("_l") + F.col("dist")).alias("reached")))
            fresh = cut_lineage(reached.groupBy("conv_id", "call_id").agg(F.max("reached").alias("level"), F.count_if(F.col("reached").isNull()).alias("n"))
                                .where("n = 0").drop("n"))
            known.append(fresh)
            waiting = reached.join(fresh, ["conv_id", "call_id"], "left_anti")
            if len(known) > 16:                       # keeps plans short
                known = [cut_lineage(_union(known))]
    stops = cut_lineage(_union(known))
    behind = (ends.join(stops.select("conv_id", F.col("call_id").alias("stop"), F.col("level").alias("_l")), ["conv_id", "stop"])
              .select("conv_id", "call_id", (F.col("_l") + F.col("dist")).alias("level")))
    return cut_lineage(stops.unionByName(behind)), dangling


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per result with its call, per call without result, and per result without call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (identifiers it refers to).  ``results``: conv_id,
    call_id, turn, content.  Output: conv_id, call_id, call_turn, level, result_turn, status, problems, call_json,
    result_json.  Status is ``answered``, ``unanswered`` or ``orphan``; ``level`` is null on cycles (problem
    ``cyclic``).  Of calls that share an identifier the first by turn, name and arguments counts.  Null identifiers never
    match: such calls are unanswered and such results orphans.  Further columns are ignored.
    """
    # Named afresh, so that clashing or further columns of the inputs do not matter.
    calls = calls.select(*CALL_COLUMNS)
    keyed = calls.where("conv_id is not null and call_id is not null")
    first = (keyed.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
             .select("conv_id", "call_id", "c.*"))
    nameless = calls.where("conv_id is null or call_id is null")
    first = cut_lineage(first)
    known, dangling = levels(first)
    lost = dangling.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("refers to unknown "), "ref"))).alias("lost"))
    empty = F.array().cast("array<string>")
    checked = (check_arguments(first, schemas).join(known, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left")
               .withColumn("cyclic", F.when(F.col("level").isNull(), F.array(F.lit("cyclic"))).otherwise(empty)))
    nameless = (check_arguments(nameless, schemas).withColumn("level", F.lit(None).cast("int")).withColumn("lost", F.lit(None).cast("array<string>"))
                .withColumn("cyclic", F.array(F.lit("no identifier"))))
    both = checked.unionByName(nameless).select(
        "conv_id", "call_id", F.col("turn").alias("call_turn"), "level",
        F.array_join(F.concat("problems", F.coalesce("lost", empty), "cyclic"), "; ").alias("problems"),
        F.to_json(F.struct(F.try_parse_json("canonical").alias("arguments"), F.col("call_id").alias("id"), "name"),
                  {"ignoreNullFields": "false"}).alias("call_json"))
    whole = cut_lineage(both)
    answers = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"),
                             F.to_json(F.struct("content", F.col("call_id").alias("id")), {"ignoreNullFields": "false"}).alias("result_json"))
    named = whole.where("conv_id is not null and call_id is not null")
    linked = (answers.join(named.withColumn("_there", F.lit(True)), ["conv_id", "call_id"], "left")
              .withColumn("status", F.when(F.col("_there"), "answered").otherwise("orphan")).drop("_there"))
    asked = answers.select("conv_id", "call_id").where("conv_id is not null and call_id is not null").distinct()
    silent = (whole.join(asked, ["conv_id", "call_id"], "left_anti")
              .withColumn("status", F.lit("unanswered")).withColumn("result_turn", F.lit(None).cast(answers.schema["result_turn"].dataType))
              .withColumn("result_json", F.lit(None).cast("string")))
    columns = ["conv_id", "call_id", "call_turn", "level", "result_turn", "status", "problems", "call_json", "result_json"]
    return linked.select(columns).unionByName(silent.select(columns))
