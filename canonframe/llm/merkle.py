"""Operator 11, Merkle manifest of a dataset.

Every row is a leaf, every value of ``tree`` (a source, say) has a tree of its own, and the trees' roots are the leaves of
one tree above them.  Nodes are rows (tree, idx, n, hash): ``idx`` counts from 0 within a level, ``n`` is the level's size.

A level is one step for all trees at once: a node's siblings have computable places (``idx XOR 1`` in binary trees, the
other slots of its run otherwise), so ``arity - 1`` equijoins of the level with itself bring them to it, and the nodes in
slot zero, which now hold their whole run, emit the parents.  Going down again, a node's siblings are put before those of
its parent, so every leaf ends with its whole authentication path.  Join keys are (tree, idx): one tree that holds a third
of all rows is dealt like many small ones.

Digests are kept as 32 bytes and hashed as 64 lowercase hex digits.  ``H`` is sha256 of its inputs, concatenated.

* null values are the field ``-``; a null tree is a tree of its own and comes first; a null in ``order`` comes first.
* rows that tie in ``order`` stand in the order of their leaves; equal rows are leaves of their own.
* a tree of one leaf has that leaf as its root; an empty table gives an empty table.
* further columns are not read, whatever their names, unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage

PATH = "array<struct<left: array<binary>, right: array<binary>>>"


def field(c: Column | str) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value (numbers in decimal)."""
    text = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column | str) -> Column:
    """The digest of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def fold(digest: Column, path: Column) -> Column:
    """The root, in hex, that ``digest`` (32 bytes) and the siblings in ``path`` lead to."""
    return F.aggregate(path, hexed(digest), lambda h, s: F.sha2(F.concat(_joined(s["left"]), h, _joined(s["right"])), 256))


def proof(path: Column) -> Column:
    """H of all siblings, level by level upwards, left to right."""
    return F.sha2(_joined(F.flatten(F.transform(path, lambda s: F.concat(s["left"], s["right"])))), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (place in its tree by ``order``, then hash) and ``n`` (rows of the tree).

    Rows are sorted by ranges; a table of one row per tree and range holds the offsets.
    """
    keys = ["_tree", *order, "_hash", "_tie"]
    ranged = (rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*(F.asc_nulls_first(k) for k in keys))
              .sortWithinPartitions(*(F.asc_nulls_first(k) for k in keys)).drop("_tie")
              .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    parts = ranged.groupBy("_tree", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_here"))
    tree = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_here").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(tree).alias("_n"))
    return (ranged.join(offsets, ["_tree", "_part"])
            .withColumn("_idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"))


def _linked(level: DataFrame, arity: int) -> DataFrame:
    """The nodes of a level that has several, with the digests ``_left`` and ``_right`` of them in their run, and ``_parent`` in slot zero."""
    nodes = level.where("_n > 1").withColumn("_slot", F.col("_idx") % arity)
    digests = nodes.select("_tree", F.col("_idx").alias("_j"), "_hash")
    found = []
    for shift in range(1, arity):
        place = F.col("_idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("_idx") - F.col("_slot") + (F.col("_slot") + shift) % arity
        sibling = digests.withColumnRenamed("_hash", f"_sibling{shift}")
        nodes = nodes.withColumn("_j", place).join(sibling, ["_tree", "_j"], "left").drop("_j")
        found.append(F.struct(((F.col("_slot") + shift) % arity).alias("slot"), F.col(f"_sibling{shift}").alias("hash")))
    run = F.array_sort(F.filter(F.array(*found), lambda s: s["hash"].isNotNull()))
    nodes = (nodes.withColumn("_run", run)
             .withColumn("_left", F.transform(F.filter("_run", lambda s: s["slot"] < F.col("_slot")), lambda s: s["hash"]))
             .withColumn("_right", F.transform(F.filter("_run", lambda s: s["slot"] > F.col("_slot")), lambda s: s["hash"])))
    parent = F.when(F.col("_slot") == 0, F.unhex(F.sha2(F.concat(hexed(F.col("_hash")), _joined(F.col("_right"))), 256)))
    return nodes.withColumn("_parent", parent).drop("_slot", "_run", *(f"_sibling{s}" for s in range(1, arity)))


def _grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels from the leaves up: the linked nodes of each, and the roots (_tree, _hash) that each holds."""
    size = leaves.agg(F.max("_n")).first()[0] or 0
    levels, roots, level = [], [], leaves
    while True:
        roots.append(level.where("_n = 1"))
        if size <= 1:
            return levels, roots
        linked = cut_lineage(_linked(level, arity))
        levels.append(linked)
        level = linked.where("_parent is not null").select(
            "_tree", F.expr(f"_idx div {arity}").alias("_idx"), F.expr(f"(_n + {arity - 1}) div {arity}").alias("_n"), F.col("_parent").alias("_hash"))
        size = -(-size // arity)


def _paths(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``_path`` from each to the last root; ``above`` is (_tree, _path, _subroot) of the trees' roots.

    Columns that only the leaves have stay on them.
    """
    def tops(k: int) -> DataFrame:
        return roots[k].join(above, "_tree")

    path = tops(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        parents = path.select("_tree", F.col("_idx").alias("_p"), F.col("_path").alias("_rest"), "_subroot")
        step = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        below = (levels[k].withColumn("_p", F.expr(f"_idx div {arity}")).join(parents, ["_tree", "_p"])
                 .withColumn("_path", F.concat(step, "_rest")))
        alone = tops(k)
        path = alone.unionByName(below.select(*alone.columns))
        if k:
            path = cut_lineage(path)
    return path


def proofs(rows: DataFrame, columns: list[str], tree: str = "source", order: tuple[str, ...] = ("doc_id",), arity: int = 3,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``rows``: ``order`` and ``keep`` columns, ``leaf``, ``path``, ``subroot``, ``root`` (hex but the path).

    Leaves hash ``columns``; those of one ``tree`` value stand by ``order``.  ``arity`` consecutive nodes have one parent, the
    last run of a level may be shorter, even one node.  Subroots stand by ``tree``, null first, then bytewise.
    """
    passed = list(dict.fromkeys([*order, *keep]))
    # n: no tree given, s...: its value; so null comes first and no value can be taken for it
    named = F.when(F.col(tree).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(tree).cast("string")))
    # order columns are copied under names of their own: whatever ``keep`` holds, nothing clashes
    slim = rows.select(named.alias("_tree"), leaf(*columns).alias("_hash"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)),
                       F.struct(*(F.col(c) for c in passed)).alias("_kept"))
    leaves = cut_lineage(_numbered(slim, [f"_o{i}" for i in range(len(order))]).select("_tree", "_idx", "_n", "_hash", "_kept"))
    levels, roots = _grown(leaves, arity)
    nothing = F.array().cast(PATH)
    subroots = None
    for r in roots:
        part = r.select("_tree", "_hash")
        subroots = part if subroots is None else subroots.unionByName(part)
    # the tree above: its leaves are the subroots, in the order of their trees
    top = (_numbered(subroots.select(F.lit("top").alias("_tree"), F.col("_tree").alias("_o0"), "_hash"), ["_o0"])
           .select("_tree", "_idx", "_n", "_hash", F.col("_o0").alias("_of")))
    top = cut_lineage(top)
    top_levels, top_roots = _grown(top, arity)
    root = top_roots[-1].select("_hash").first()
    end = rows.sparkSession.range(1).select(F.lit("top").alias("_tree"), nothing.alias("_path"), F.lit(None).cast("binary").alias("_subroot"))
    above = cut_lineage(_paths(top_levels, top_roots, end, arity).select(F.col("_of").alias("_tree"), "_path", F.col("_hash").alias("_subroot")))
    found = _paths(levels, roots, above, arity)
    return found.select(*(F.col("_kept")[c].alias(c) for c in passed), hexed(F.col("_hash")).alias("leaf"), F.col("_path").alias("path"),
                        hexed(F.col("_subroot")).alias("subroot"), F.lit(root[0].hex() if root else None).cast("string").alias("root"))
