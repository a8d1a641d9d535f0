"""The address space and the interval primitives everything else is built on.

Three rules hold throughout this module:

* an order over a whole table is never computed by one task: positions and
  running values are computed per block of the key space, and only the block
  totals (a few rows per million) are scanned in order;
* a closed range is handled through positions or through bins of its own size,
  never through a ``BETWEEN`` join;
* a block or bin holds a bounded number of rows because its width in the
  integer key space is fixed and its rows are unique in that key, or because
  rows were aggregated by key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

BLOCK = 1_000_000          # addresses per block (one collection)
SUPERBLOCK = 1_000         # blocks per superblock
LIST = 256                 # positions per stored list of addresses
LINK_SPAN = 400            # fixed value: widest link target, in real addresses, that heat walks


def address_space(df: DataFrame, addr: str = "addr") -> DataFrame:
    """One row per real address with its parts."""
    return (df.select(F.col(addr).cast("bigint").alias("addr")).where(F.col("addr").isNotNull()).distinct()
            .select("addr",
                    F.expr("addr div 1000000").alias("book"),
                    F.expr("(addr div 1000) % 1000").alias("chapter"),
                    F.expr("addr % 1000").alias("unit")))


def numbered_space(df: DataFrame, addr: str = "addr") -> DataFrame:
    """``address_space`` with the dense position ``pos`` of every address.

    The same rows as ``global_position(address_space(df), "addr")``.  Addresses alone are exchanged, once: a block's
    copies meet in the task that ranks the block, and its parts are derived behind the exchange.
    """
    block = F.expr(f"addr div {BLOCK}")
    blocked = (df.select(F.col(addr).cast("bigint").alias("addr")).where(F.col("addr").isNotNull())
               .withColumn("_b1", block).repartition("_b1").dropDuplicates(["_b1", "addr"]))
    ranked = cut_lineage(blocked.withColumn("_r", F.row_number().over(W.partitionBy("_b1").orderBy("addr"))))
    cells = cut_lineage(ranked.groupBy("_b1").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b2", F.expr(f"_b1 div {SUPERBLOCK}")))
    out = ranked.join(_block_offsets(cells, []), "_b1")
    return out.select("addr", F.expr("addr div 1000000").alias("book"), F.expr("(addr div 1000) % 1000").alias("chapter"),
                      F.expr("addr % 1000").alias("unit"), (F.col("_o") + F.col("_r") - 1).cast("bigint").alias("pos"))


def _block_offsets(cells: DataFrame, lead: list[str]) -> DataFrame:
    """(lead, _b1, _o): the rows before each block.  ``cells``: lead, _b2, _b1, _n."""
    def exclusive(window):
        return F.coalesce(F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    mids = cells.groupBy(*lead, "_b2").agg(F.sum("_n").alias("_n"))
    mids = mids.withColumn("_m0", exclusive(W.partitionBy(*lead).orderBy("_b2")))
    if lead:
        tops = mids.groupBy(*lead).agg(F.sum("_n").alias("_n"))
        tops = tops.withColumn("_t0", exclusive(W.orderBy(*lead))).drop("_n")
        mids = mids.join(tops, lead).withColumn("_m0", F.col("_m0") + F.col("_t0")).drop("_t0")
    cells = cells.withColumn("_c0", exclusive(W.partitionBy(*lead, "_b2").orderBy("_b1"))).drop("_n")
    offsets = cells.join(mids.drop("_n"), [*lead, "_b2"])
    return offsets.withColumn("_o", F.col("_c0") + F.col("_m0")).drop("_c0", "_m0", "_b2")


def global_position(df: DataFrame, key: str, lead: Sequence[str] = (), name: str = "pos",
                    total: str | None = None) -> DataFrame:
    """0-based position of every row in the order ``(*lead, key)``.

    ``key`` must be an integer and unique within ``lead``; it is what bounds a
    block, so no window partition can exceed ``BLOCK`` rows however the rows
    are distributed.  ``lead`` columns may be of any orderable type; the only
    unpartitioned window runs over their distinct values (or, without ``lead``,
    over the superblocks).  The block counts, a tiny table, are written once;
    ``df`` itself is read twice.  ``total`` names a column for the row count.
    """
    lead = list(lead)
    blocked = (df.withColumn("_b1", F.expr(f"`{key}` div {BLOCK}"))
               .withColumn("_b2", F.expr(f"`{key}` div {BLOCK * SUPERBLOCK}")))
    cells = cut_lineage(blocked.groupBy(*lead, "_b2", "_b1").agg(F.count(F.lit(1)).alias("_n")))
    n_rows = cells.select(F.coalesce(F.sum("_n"), F.lit(0))).scalar()

    offsets = _block_offsets(cells, lead)
    local = blocked.drop("_b2").withColumn(
        "_r", F.row_number().over(W.partitionBy(*lead, "_b1").orderBy(key)))
    out = local.join(offsets, [*lead, "_b1"]).withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, n_rows)
    return out.drop("_o", "_r", "_b1")


def addresses_near(ranges: DataFrame, space: DataFrame, at: Column, steps: Column, most: int) -> DataFrame:
    """``ranges`` with ``first``, the address at position ``at``, and ``last``, the one ``steps`` (at most ``most``) further on.

    Rows without one of the two are left out.  ``space`` (addr, pos: dense from 0) is put in lists of ``LIST`` positions,
    each with ``most`` more at both ends, so a row meets both of its addresses in one exchange, and only its own columns go there.
    ``at`` is the join's key and must hold no subquery.
    """
    lists = (space.select(F.struct("pos", "addr").alias("_a"),
                          F.explode(F.sequence(F.expr(f"greatest(pos - {most}, 0) div {LIST}"), F.expr(f"(pos + {most}) div {LIST}"))).alias("_list"))
             .groupBy("_list").agg(F.transform(F.array_sort(F.collect_list("_a")), lambda a: a["addr"]).alias("_addrs")))

    def address(place):
        return F.get("_addrs", (place - F.greatest(F.col("_list") * LIST - most, F.lit(0))).cast("int"))
    near = ranges.where((at >= 0) & (F.abs(steps) <= most)).join(lists, F.floor((at - at % LIST) / LIST) == F.col("_list"))
    return (near.withColumn("first", address(at)).withColumn("last", address(at + steps))
            .where("first IS NOT NULL AND last IS NOT NULL").drop("_list", "_addrs"))


def quintile(pos: str, total: Column, buckets: int = 5) -> Column:
    """``min(5, floor(pos * 5 / n) + 1)``: differs from ``ntile`` when n is not a multiple of 5."""
    return F.least(F.lit(buckets).cast("bigint"), F.floor(F.col(pos) * buckets / total).cast("bigint") + 1)


def row_total(df: DataFrame) -> Column:
    """The number of rows of ``df`` as a scalar subquery (no join, no driver round trip)."""
    return df.select(F.count(F.lit(1))).scalar()


def to_positions(ranges: DataFrame, space: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Replace range endpoints by positions in ``space`` (``addr``, ``pos``).

    Endpoints that are not real addresses drop the range, as they cannot be
    expanded; callers that must report them use ``unresolved_ranges``.
    Reversed ranges collapse onto their start.
    """
    real_end = F.greatest(F.col(start), F.col(end))
    first = space.select(F.col("addr").alias("_s"), F.col("pos").alias("p_start"))
    last = space.select(F.col("addr").alias("_e"), F.col("pos").alias("p_end"))
    return (ranges.withColumn("_end", real_end)
            .join(first, F.col(start) == F.col("_s")).drop("_s")
            .join(last, F.col("_end") == F.col("_e")).drop("_e", "_end"))


def unresolved_ranges(ranges: DataFrame, space: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges with an endpoint that is not in the space."""
    addrs = space.select(F.col("addr").alias("_a"))
    bad_start = ranges.join(addrs, F.col(start) == F.col("_a"), "left_anti")
    bad_end = (ranges.join(addrs, F.col(start) == F.col("_a"), "left_semi")
               .join(addrs, F.greatest(F.col(start), F.col(end)) == F.col("_a"), "left_anti"))
    return bad_start.withColumn("bad", F.lit("start")).unionByName(bad_end.withColumn("bad", F.lit("end")))


def _last_position(max_span: int | None) -> Column:
    return F.col("p_end") if max_span is None else F.least(F.col("p_end"), F.col("p_start") + (max_span - 1))


def range_report(ranges: DataFrame, space: DataFrame, start: str = "start", end: str = "end",
                 max_span: int | None = None) -> DataFrame:
    """What an expansion leaves out: ranges with an unreal ``start`` or ``end``, and those ``truncated`` at ``max_span``.

    ``ranges`` columns plus ``bad`` and ``lost``, the number of real addresses left out (null for unreal ends).
    """
    missing = unresolved_ranges(ranges, space, start, end).withColumn("lost", F.lit(None).cast("bigint"))
    cut = (to_positions(ranges, space, start, end).withColumn("lost", F.col("p_end") - _last_position(max_span)).where("lost > 0")
           .withColumn("bad", F.lit("truncated")).select(*ranges.columns, "bad", "lost"))
    return missing.select(*ranges.columns, "bad", "lost").unionByName(cut)


def expand_ranges(ranges: DataFrame, space: DataFrame, start: str = "start", end: str = "end",
                  max_span: int | None = None) -> DataFrame:
    """One row per real address inside each range: ``ranges`` columns plus ``addr``.

    Ranges are walked whole unless ``max_span`` says where to stop;
    ``range_report`` gives the ranges that this cuts and those with unreal ends.
    A range that ends near its start meets the addresses of its bin, so its row
    is exchanged once and its steps never.  Wider ones go through positions,
    one row for each list of addresses that they touch.
    """
    spread, low, high = space.agg(F.count(F.lit(1)), F.min("addr"), F.max("addr")).first()
    width = max(LIST, min(LIST * LIST, LIST * ((high or 0) - (low or 0) + 1) // max(spread, 1)))     # a bin's addresses: about LIST, never above its width
    own = F.expr(f"`{start}` div {width}")
    ends = ranges.withColumn("_end", F.greatest(start, end))
    near = F.col("_end") < (own + 1) * width + width // 4
    bins = (space.select("addr", F.explode(F.when(F.expr(f"addr % {width} < {width // 4}"), F.array(F.expr(f"addr div {width}"), F.expr(f"addr div {width} - 1")))
                                           .otherwise(F.array(F.expr(f"addr div {width}")))).alias("_bin"))
            .groupBy("_bin").agg(F.array_sort(F.collect_list("addr")).alias("_addrs")))
    first, last = F.array_position("_addrs", F.col(start)), F.array_position("_addrs", F.col("_end"))
    steps = last - first + 1 if max_span is None else F.least(last - first + 1, F.lit(max_span))
    met = ends.where(near).withColumn("_bin", own).join(bins, "_bin").where((first > 0) & (last > 0))
    inside = met.select(*ranges.columns, F.explode(F.slice("_addrs", first.cast("int"), steps.cast("int"))).alias("addr"))

    located = to_positions(ends.where(~near).drop("_end"), space, start, end).withColumn("_last", _last_position(max_span))
    lists = space.groupBy(F.expr(f"pos div {LIST}").alias("_list")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "addr"))), lambda a: a["addr"]).alias("_addrs"))
    walked = located.withColumn("_list", F.explode(F.sequence(F.expr(f"p_start div {LIST}"), F.expr(f"_last div {LIST}")))).join(lists, "_list")
    skipped = F.greatest(F.col("p_start") - F.col("_list") * LIST, F.lit(0)).cast("int")
    taken = F.least(F.col("_last") - F.col("_list") * LIST + 1, F.lit(LIST)).cast("int") - skipped
    return inside.unionByName(walked.select(*ranges.columns, F.explode(F.slice("_addrs", skipped + 1, taken)).alias("addr")))


def running(df: DataFrame, order: str, block: Column, aggs: dict[str, tuple[str, str]],
            partition: Sequence[str] = ()) -> DataFrame:
    """Running aggregates in the order of ``order`` without a one-task window.

    ``aggs`` maps an output name to ``(kind, column)`` with kind ``sum``,
    ``max`` or ``last`` (last non-null).  Rows must be unique in
    ``(*partition, order)``; ``block`` must be non-decreasing in ``order``.
    The value is the one including the current row.
    """
    part = list(partition)
    blocked = df.withColumn("_blk", block)
    here = W.partitionBy(*part, "_blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals, local = [], {}
    for name, (kind, col) in aggs.items():
        if kind == "sum":
            totals.append(F.sum(col).alias(f"_x_{name}"))
            local[f"_l_{name}"] = F.sum(col).over(here)
        elif kind == "max":
            totals.append(F.max(col).alias(f"_x_{name}"))
            local[f"_l_{name}"] = F.max(col).over(here)
        elif kind == "last":
            totals.append(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order))).alias(f"_x_{name}"))
            local[f"_l_{name}"] = F.last(col, ignorenulls=True).over(here)
        else:
            raise ValueError(f"unknown running aggregate: {kind}")
    past = W.partitionBy(*part).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carries = blocked.groupBy(*part, "_blk").agg(*totals)
    for name, (kind, _) in aggs.items():
        over = {"sum": F.sum(f"_x_{name}"), "max": F.max(f"_x_{name}"),
                "last": F.last(f"_x_{name}", ignorenulls=True)}[kind].over(past)
        carries = carries.withColumn(f"_p_{name}", over)
    carries = carries.drop(*[f"_x_{n}" for n in aggs])
    out = blocked.withColumns(local).join(carries, [*part, "_blk"])
    for name, (kind, _) in aggs.items():
        lo, pr = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        value = {"sum": F.coalesce(pr, F.lit(0)) + F.coalesce(lo, F.lit(0)),
                 "max": F.greatest(pr, lo), "last": F.coalesce(lo, pr)}[kind]
        out = out.withColumn(name, value)
    return out.drop("_blk", *[f"_l_{n}" for n in aggs], *[f"_p_{n}" for n in aggs])


def tally_ranges(ranges: DataFrame, space: DataFrame, weight: Column, start: str = "start",
                 end: str = "end", max_span: int | None = None) -> DataFrame:
    """Per address: how many ranges cover it and their summed weight.

    Equal ranges are pre-aggregated, the rest is expanded to positions and
    summed map-side, so what is shuffled is bounded by the positions a task
    touches, not by the expanded steps; addresses are looked up once per
    position at the end.
    """
    distinct = (ranges.groupBy(F.col(start).alias("_rs"), F.col(end).alias("_re"))
                .agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).cast("bigint").alias("_w")))
    located = to_positions(distinct, space, "_rs", "_re")
    cells = (located.select(F.explode(F.sequence("p_start", _last_position(max_span))).alias("pos"), "_n", "_w")
             .groupBy("pos").agg(F.sum("_n").alias("n_ranges"), F.sum("_w").alias("weight")))
    return cells.join(space.select("pos", "addr"), "pos").select("addr", "n_ranges", "weight")


def tally_ranges_by_deltas(ranges: DataFrame, space: DataFrame, weight: Column, start: str = "start",
                           end: str = "end", max_span: int | None = None) -> DataFrame:
    """The same without expanding: cheaper for wide ranges, and the second method a gate compares with.

    Every distinct range leaves a +value at its first and a -value after its
    last position; the running sum of the deltas over the positions is the
    answer.
    """
    distinct = (ranges.groupBy(F.col(start).alias("_rs"), F.col(end).alias("_re"))
                .agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).cast("bigint").alias("_w")))
    located = to_positions(distinct, space, "_rs", "_re")
    stop = _last_position(max_span) + 1
    marks = located.select(F.explode(F.array(
        F.struct(F.col("p_start").alias("pos"), F.col("_n").alias("dn"), F.col("_w").alias("dw")),
        F.struct(stop.alias("pos"), (-F.col("_n")).alias("dn"), (-F.col("_w")).alias("dw")))).alias("m"))
    deltas = marks.select("m.*").groupBy("pos").agg(F.sum("dn").alias("dn"), F.sum("dw").alias("dw"))
    cells = space.select("pos", "addr").join(deltas, "pos", "left")
    summed = running(cells, "pos", F.expr("pos div 100000"),
                     {"n_ranges": ("sum", "dn"), "weight": ("sum", "dw")})
    return summed.where("n_ranges > 0").select("addr", F.col("n_ranges").cast("bigint").alias("n_ranges"),
                                               F.col("weight").cast("bigint").alias("weight"))


_RADIX_BITS = 5
_LEVELS = 11               # 2**55 covers any packed address


def _own_level(start: str, end: str) -> Column:
    """Smallest level whose bins are at least as wide as the interval."""
    width = F.col(end) - F.col(start) + 1
    level = F.lit(_LEVELS)
    for k in range(_LEVELS - 1, -1, -1):
        level = F.when(width <= (1 << (_RADIX_BITS * k)), F.lit(k)).otherwise(level)
    return level


def _bins(levels: Column, start: str, end: str) -> Column:
    """Array of (level, bin, first) for the given array of levels: at most two bins per level."""
    def at(level):
        w = F.expr(f"CAST({_RADIX_BITS} AS INT)") * level
        first = F.call_function("shiftright", F.col(start), w)
        last = F.call_function("shiftright", F.col(end), w)
        return F.transform(F.sequence(first, last), lambda b: F.struct(
            level.alias("level"), b.alias("bin"), first.alias("first")))
    return F.flatten(F.transform(levels, at))


def _occupied(df: DataFrame, start: str, end: str) -> Column:
    """The levels a side's intervals own, as a scalar subquery: at most ``_LEVELS + 1`` numbers whatever the size."""
    return df.select(F.coalesce(F.collect_set(_own_level(start, end)), F.array().cast("array<int>"))).scalar()


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str],
                 right_range: tuple[str, str], salt: int = 1) -> DataFrame:
    """All pairs of rows whose closed integer ranges share a value.

    Every interval owns one level of a radix tree of bins, the one whose bins
    are as wide as itself, and touches at most two bins there.  A pair meets
    in the bin of the wider interval: one equi-join finds the pairs whose right
    interval is the wider, a second one the rest, so nothing is emitted twice.
    A row is copied only to the levels that the other side occupies, which are
    read from the data, so no width has to be promised: a few very long ranges
    add one or two copies per row, and without them there are none.  The pair is
    kept in the first bin both touch, which makes a final ``distinct`` unnecessary.

    ``salt`` > 1 splits a hot bin of the right side over that many join keys
    and repeats the (smaller) left side; adaptive skew splitting handles the
    rest.
    """
    ls, le = left_range
    # A side whose two bounds are one column holds points: nothing is narrower.
    points = ls == le
    left_levels = None if points else _occupied(left, ls, le)
    return _overlap(left, right, left_range, right_range, salt, left_levels, _occupied(right, *right_range))


def _overlap(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str],
             salt: int, left_levels: Column | None, right_levels: Column) -> DataFrame:
    ls, le = left_range
    rs, re_ = right_range

    def keyed(df, s, e, side, there, wanted):
        out = df.withColumn("_lv", _own_level(s, e)).withColumn("_there", there if there is not None else F.array("_lv"))
        out = out.withColumn("_bin", F.explode(_bins(F.filter("_there", wanted), s, e)))
        return (out.withColumn("_level", F.col("_bin.level")).withColumn("_key", F.col("_bin.bin"))
                .withColumn(f"_first_{side}", F.col("_bin.first")).drop("_bin", "_lv", "_there"))

    def every(v):
        return F.lit(True)

    def salted(df, side):
        if salt <= 1:
            return df
        if side == "r":
            return df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if not c.startswith("_")]),
                                                 F.lit(salt)).cast("int"))
        return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salt)])))

    keys = ["_level", "_key"] + (["_salt"] if salt > 1 else [])
    match = F.col("_key") == F.greatest(F.col("_first_l"), F.col("_first_r"))
    meets = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    columns = [*left.columns, *right.columns]

    wide_right = (salted(keyed(left, ls, le, "l", right_levels, lambda v: v >= F.col("_lv")), "l")
                  .join(salted(keyed(right, rs, re_, "r", None, every), "r"), keys))
    pairs = wide_right.where(match & meets).select(*columns)
    if left_levels is None:
        return pairs
    wide_left = (salted(keyed(left, ls, le, "l", None, every), "l")
                 .join(salted(keyed(right, rs, re_, "r", left_levels, lambda v: v > F.col("_lv")), "r"), keys))
    return pairs.unionByName(wide_left.where(match & meets).select(*columns))


def points_in_ranges(points: DataFrame, ranges: DataFrame, point: str,
                     range_cols: tuple[str, str], salt: int = 1) -> DataFrame:
    """Pairs (point row, range row) with the point inside the range."""
    return overlap_join(points, ranges, (point, point), range_cols, salt)


def merge_ranges(ranges: DataFrame, start: str = "start", end: str = "end",
                 partition: Sequence[str] = (), touch: int = 1) -> DataFrame:
    """Minimal sorted set of ranges per ``partition``; ``end + touch`` still joins.

    Starts are made unique by a partial aggregate first, then the running
    maximum of the ends is computed block-wise, so a partition holding most of
    the rows is still spread over many tasks.
    """
    part = list(partition)
    unique = ranges.groupBy(*part, F.col(start).alias("s")).agg(F.max(F.greatest(F.col(start), F.col(end))).alias("e"))
    block = F.expr(f"s div {BLOCK}")
    reach = running(unique, "s", block, {"reach": ("max", "e")}, part)
    # The reach before this row: the running value of the previous row, carried across blocks.
    prev_local = F.lag("reach").over(W.partitionBy(*part, "_b").orderBy("s"))
    blocked = reach.withColumn("_b", block).withColumn("_pl", prev_local)
    ends = blocked.groupBy(*part, "_b").agg(F.max("reach").alias("_br"))
    ends = ends.withColumn("_pb", F.max("_br").over(
        W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_br")
    flagged = (blocked.join(ends, [*part, "_b"])
               .withColumn("_prev", F.coalesce("_pl", "_pb"))
               .withColumn("_head", F.when(F.col("_prev").isNull() | (F.col("s") > F.col("_prev") + touch), F.col("s")))
               .select(*part, "s", "e", "_head"))
    islands = running(flagged, "s", block, {"island": ("last", "_head")}, part)
    return (islands.groupBy(*part, F.col("island").alias(start))
            .agg(F.max("e").alias(end), F.count(F.lit(1)).alias("n_starts")))


def neighbours(chapters: DataFrame, book: str = "book", chapter: str = "chapter") -> DataFrame:
    """Previous and next existing chapter; at most 1,000 distinct chapters per collection."""
    order = W.partitionBy(book).orderBy(chapter)
    return (chapters.select(book, chapter).distinct()
            .withColumn("prev", F.lag(chapter).over(order)).withColumn("next", F.lead(chapter).over(order)))


def asof_join(probes: DataFrame, intervals: DataFrame, at: str, start: str, value: str,
              partition: Sequence[str], bucket: int, tie: str) -> DataFrame:
    """Last interval whose start is <= the probe time; NULL before the first.

    Both sides become one ordered event list per partition; the last interval
    seen is carried over fixed-width time buckets, so one very busy partition
    key does not land in one task.  ``at``/``start`` are integers.  Of
    intervals that start at the same time the one with the greatest ``value`` wins.
    """
    part = list(partition)
    marks = intervals.groupBy(*part, F.col(start).alias("_t")).agg(F.max(value).alias("_v"))
    probe_times = probes.select(*part, F.col(at).alias("_t")).distinct()
    events = (probe_times.withColumn("_q", F.lit(True))
              .join(marks, [*part, "_t"], "full_outer"))
    carried = running(events, "_t", F.expr(f"_t div {bucket}"), {"_hit": ("last", "_v")}, part)
    found = carried.where("_q").select(*part, F.col("_t").alias(at), F.col("_hit").alias(value))
    return probes.join(found, [*part, at], "left")
