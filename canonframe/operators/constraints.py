"""Constraint specs of a table, checked together in one scan.

A spec is a list of rules about one table.  ``check`` compiles it to one plan:
the table is read once, every key the rules group by is one grouping set of
the same aggregate (folded before the shuffle), and references meet the values
they may take in a second aggregate over distinct values only.  No rule joins,
so a value that a third of the rows share costs no more than a rare one.

=============  =================================================================
``Row``        a condition every row must meet; NULL counts as not met
``Group``      a condition on the aggregates of every group of some keys
``Reference``  a value (of one or more columns) that must occur elsewhere
``Size``       the number of rows lies between two bounds
=============  =================================================================

The shorthands below them make the usual rules of a schema.  Violations are
rows for ``Row`` and ``Reference``, groups for ``Group`` and one for ``Size``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Row:
    name: str
    holds: Column


@dataclass(frozen=True)
class Group:
    name: str
    keys: tuple[str, ...]
    holds: Column


@dataclass(frozen=True)
class Reference:
    """``known`` holds the allowed values in as many columns; values are compared as text.

    A value with a NULL in it is a violation unless ``optional``.
    """
    name: str
    columns: tuple[str, ...]
    known: DataFrame
    optional: bool = False


@dataclass(frozen=True)
class Size:
    name: str
    low: int
    high: int


Rule = Row | Group | Reference | Size


def one_of(column: str, allowed: list, optional: bool = False) -> Row:
    ok = F.col(column).isin(allowed)
    return Row(f"{column} is a known value", ok | F.col(column).isNull() if optional else ok)


def required(*columns: str) -> list[Row]:
    """Present and, as text, not blank."""
    return [Row(f"{c} is present", F.trim(F.col(c).cast("string")) != "") for c in columns]


def typed(column: str, sql_type: str) -> Row:
    """A text that reads as a value of the type; NULL is left to ``required``."""
    return Row(f"{column} is {sql_type}", F.col(column).isNull() | F.col(column).try_cast(sql_type).isNotNull())


def years(low: str, high: str, optional: bool = False) -> list[Row]:
    """No year zero, in order, and both or neither when optional."""
    a, b = F.col(low), F.col(high)
    free = a.isNull() & b.isNull() if optional else F.lit(False)
    return [Row(f"{low} is no year zero", free | (a != 0)), Row(f"{high} is no year zero", free | (b != 0)),
            Row(f"{low} to {high} in order", free | (a <= b))]


def words_at_most(column: str, n: int) -> Row:
    """Runs of anything but white space; a blank text has none."""
    text = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    return Row(f"{column} has at most {n} words", (text == "") | (F.size(F.split(text, " ")) <= n))


def only_with(column: str, condition: Column, name: str) -> Row:
    """The column is filled exactly where the condition holds."""
    return Row(name, F.col(column).isNotNull() == F.coalesce(condition, F.lit(False)))


def unique(*keys: str) -> Group:
    """NULLs are equal to each other here."""
    return Group(f"{', '.join(keys)} unique", keys, F.count(F.lit(1)) == 1)


def reference(column: str, known: DataFrame, optional: bool = False) -> Reference:
    return Reference(f"{column} exists", (column,), known, optional)


def _text(columns) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(gate, violations) for every rule, the kept ones included; an empty table breaks ``Size`` alone."""
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rules share a name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    key_sets = list(dict.fromkeys([()] + [tuple(sorted(r.keys if isinstance(r, Group) else r.columns))
                                          for r in rules if isinstance(r, Group | Reference)]))
    columns = sorted({c for keys in key_sets for c in keys})
    # grouping_id has a bit for every column, first column highest, set where the set leaves it out
    set_id = {keys: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for keys in key_sets}

    def id_of(rule) -> int:
        return set_id[tuple(sorted(rule.keys if isinstance(rule, Group) else rule.columns))] if isinstance(rule, Group | Reference) else set_id[()]

    measures = [F.count(F.lit(1)).alias("_n")]
    for i, r in enumerate(rules):
        if isinstance(r, Row):
            measures.append(F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"_m{i}"))
        elif isinstance(r, Group):
            measures.append(F.coalesce(r.holds, F.lit(False)).alias(f"_m{i}"))
    if columns:
        # the keys of a set are columns of their own: measures read the table's, which stay filled
        keyed = df.select("*", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)])
        key = {c: f"_k{i}" for i, c in enumerate(columns)}
        groups = (keyed.groupingSets([[F.col(key[c]) for c in keys] for keys in key_sets], *[F.col(key[c]) for c in columns])
                  .agg(F.grouping_id().alias("_set"), *measures))
    else:
        key, groups = {}, df.groupBy().agg(F.lit(0).alias("_set"), *measures)

    # counts of a set's groups are one row a task and set; only values of references stay apart
    references = [(i, r) for i, r in enumerate(rules) if isinstance(r, Reference)]
    value = F.lit(None).cast("array<string>")
    for ident, cols in {id_of(r): r.columns for _, r in references}.items():
        whole = reduce(lambda a, b: a & b, [F.col(key[c]).isNotNull() for c in cols])
        value = F.when((F.col("_set") == ident) & whole, _text([key[c] for c in sorted(cols)])).otherwise(value)
    counted = [F.when(F.col("_set") == set_id[()], F.col("_n")).otherwise(0).alias("_rows")]
    for i, r in enumerate(rules):
        here = F.col("_set") == id_of(r)
        if isinstance(r, Row):
            counted.append(F.when(here, F.col(f"_m{i}")).otherwise(0).alias(f"_c{i}"))
        elif isinstance(r, Group):
            counted.append(F.when(here & ~F.col(f"_m{i}"), 1).otherwise(0).cast("bigint").alias(f"_c{i}"))
        elif isinstance(r, Reference):
            counted.append(F.when(here, F.col("_n")).otherwise(0).alias(f"_c{i}"))
    tagged = groups.select("_set", value.alias("_value"), *counted)
    for i, r in references:
        order = sorted(range(len(r.columns)), key=lambda k: r.columns[k])
        known_columns = [r.known.columns[k] for k in order]
        known = r.known.select(F.lit(id_of(r)).cast("bigint").alias("_set"), _text(known_columns).alias("_value"), F.lit(i).alias("_known")).where(
            reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known_columns]))
        tagged = tagged.unionByName(known, allowMissingColumns=True)
    if references:
        sums = [F.sum(c).alias(c) for c in ["_rows", *[f"_c{i}" for i, r in enumerate(rules) if not isinstance(r, Size)]]]
        seen = [F.max(F.col("_known") == i).alias(f"_s{i}") for i, _ in references]
        tagged = tagged.groupBy("_set", "_value").agg(*sums, *seen)

    totals = []
    for i, r in enumerate(rules):
        if isinstance(r, Size):
            total = F.when(F.coalesce(F.sum("_rows"), F.lit(0)).between(r.low, r.high), 0).otherwise(1)
        elif isinstance(r, Reference):
            free = F.col("_value").isNull() if r.optional else F.lit(False)
            total = F.sum(F.when(free | F.coalesce(F.col(f"_s{i}"), F.lit(False)), 0).otherwise(F.col(f"_c{i}")))
        else:
            total = F.sum(f"_c{i}")
        totals.append(F.struct(F.lit(r.name).alias("gate"), F.coalesce(total, F.lit(0)).cast("bigint").alias("violations")))
    return tagged.agg(F.array(*totals).alias("_all")).select(F.inline("_all"))


def check_all(specs: list[tuple[str, DataFrame, list[Rule]]]) -> DataFrame:
    """The reports of several tables, every gate named ``table: rule``; one scan a table."""
    reports = [check(df, rules).select(F.concat(F.lit(f"{table}: "), "gate").alias("gate"), "violations") for table, df, rules in specs]
    return reduce(DataFrame.unionByName, reports)


def broken_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that break a ``Row`` rule, with the names of those they break (for a report; one more scan)."""
    names = [F.when(F.coalesce(r.holds, F.lit(False)), F.lit(None)).otherwise(F.lit(r.name)) for r in rules if isinstance(r, Row)]
    return df.withColumn("broken", F.array_compact(F.array(*names))).where(F.size("broken") > 0)
