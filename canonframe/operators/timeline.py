"""Cited timelines: envelopes, grades, eras, passage notes, entity details."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from . import space as S

# Orders of the enumerations.
EVIDENCE_ORDER = ["corroborates", "partially-corroborates", "consistent", "silent"]
RELATION_ORDER = ["in-tension", "corroborates", "partially-corroborates", "consistent", "silent"]
TRADITION_ORDER = ["archaeological", "critical", "chronological", "traditional"]
UNCHECKED = ["draft", "sources-located"]


def rank_in(value: Column | str, order: list[str]) -> Column:
    """0-based place in an enumerated order; unknown values come last."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.array_position(F.array(*[F.lit(o) for o in order]), v)
    return F.when(at == 0, len(order)).otherwise(at - 1).cast("int")


def envelope(positions: DataFrame, include_composition: Column | None = None) -> DataFrame:
    """Date range per event, derived from its positions.

    Scholarly positions lead; traditional ones stand in when they are all there
    is.  Positions that date the writing never widen an event.
    """
    keep = F.col("dates") == "event"
    if include_composition is not None:
        keep = keep | include_composition
    trad = F.col("tradition") == "traditional"

    def edge(fn, col, cond):
        return fn(F.when(keep & cond, F.col(col)))
    a = positions.groupBy("event_id").agg(
        edge(F.min, "earliest", ~trad).alias("_se"), edge(F.max, "latest", ~trad).alias("_sl"),
        edge(F.min, "earliest", trad).alias("trad_earliest"), edge(F.max, "latest", trad).alias("trad_latest"))
    return a.select("event_id", F.coalesce("_se", "trad_earliest").alias("earliest"),
                    F.coalesce("_sl", "trad_latest").alias("latest"), "trad_earliest", "trad_latest")


def evidence(attested: DataFrame, key: str, everyone: DataFrame) -> DataFrame:
    """Strongest relation per subject (tension is a flag, never a grade); ``none`` without any."""
    best = attested.groupBy(key).agg(
        F.min(F.when(F.col("relation") != "in-tension", rank_in("relation", EVIDENCE_ORDER))).alias("_r"),
        F.max(F.col("relation") == "in-tension").alias("has_tension"))
    labels = F.array(*[F.lit(o) for o in EVIDENCE_ORDER])
    return (everyone.select(key).join(best, key, "left")
            .select(key, F.coalesce(F.get(labels, F.col("_r")), F.lit("none")).alias("evidence"),
                    F.coalesce("has_tension", F.lit(False)).alias("has_tension")))


def era_of_year(eras: DataFrame) -> DataFrame:
    """Year -> first matching era; a calendar of years is small whatever the number of events."""
    years = eras.withColumn("year", F.explode(F.sequence("start", "end"))).where("year <> 0")
    return years.groupBy("year").agg(F.min_by("era_id", F.struct("start", "era_id")).alias("era_id"))


def by_era(events: DataFrame, eras: DataFrame, year: str) -> DataFrame:
    """Events with their era; NULL where none contains the year (the unplaced bucket)."""
    return events.join(era_of_year(eras).withColumnRenamed("year", year), year, "left")


def busiest_era(events: DataFrame, eras: DataFrame, year: str) -> DataFrame:
    """The era containing most events, ties to the earlier one; every containing era counts."""
    years = eras.withColumn(year, F.explode(F.sequence("start", "end"))).where(F.col(year) != 0)
    per_year = events.groupBy(year).agg(F.count(F.lit(1)).alias("_n"))
    n = years.join(per_year, year).groupBy("era_id", "start").agg(F.sum("_n").alias("n"))
    return n.orderBy(F.desc("n"), "start", "era_id").limit(1).select("era_id", "n")


def in_window(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events overlapping each requested [from, to] year window (years shifted past the missing 0)."""
    def shifted(c: str) -> Column:
        return F.when(F.col(c) < 0, F.col(c) + 1).otherwise(F.col(c)) + 100_000
    e = events.withColumn("_es", shifted("earliest")).withColumn("_ee", shifted("latest"))
    w = windows.withColumn("_ws", shifted("from_year")).withColumn("_we", shifted("to_year"))
    return S.overlap_join(e, w, ("_es", "_ee"), ("_ws", "_we")).drop("_es", "_ee", "_ws", "_we")


def span_years(a: Column | str, b: Column | str) -> Column:
    """Years between two historical years; there is no year 0 to count."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.abs(y - x) - F.when((x < 0) != (y < 0), 1).otherwise(0)


def year_label(y: Column | str) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    return F.concat(F.abs(c).cast("string"), F.when(c < 0, " BCE").otherwise(" CE"))


def range_label(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    same_era = (x < 0) == (y < 0)
    return (F.when(x == y, year_label(x))
            .when(same_era, F.concat(F.abs(x).cast("string"), F.lit("–"), year_label(y)))
            .otherwise(F.concat(year_label(x), F.lit("–"), year_label(y))))


# --- passages ------------------------------------------------------------------------------------

def links_in(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Typed links overlapping each request, with their anchor inside it."""
    hit = S.overlap_join(requests, links, ("q_start", "q_end"), ("start", "end"))
    return (hit.withColumn("anchor", F.greatest("start", "q_start"))
            .withColumn("clamped_end", F.least("end", "q_end")))


def entities(requests: DataFrame, links: DataFrame, positions: DataFrame) -> DataFrame:
    """(req, kind, subject) a passage touches; an argument's link counts for its event."""
    hit = links_in(requests, links).select("req", "subject_kind", "subject_id").distinct()
    argued = (hit.where("subject_kind = 'argument'").join(
        positions.select(F.col("event_id").alias("subject_id")).distinct(), "subject_id", "left_semi")
        .withColumn("subject_kind", F.lit("event")))
    return hit.where("subject_kind <> 'argument'").unionByName(argued.select(*hit.columns)).distinct()


def strongest_relations(hits: DataFrame, relations: DataFrame) -> DataFrame:
    """Per artifact link in a request: the strongest relation to a subject linked to a shared address.

    ``relations``: artifact_id, rel_kind, rel_id, relation.
    """
    art = hits.where("subject_kind = 'artifact'").select(
        "req", F.col("subject_id").alias("artifact_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"),
        F.col("anchor").alias("lo"), F.col("clamped_end").alias("hi")).distinct()
    others = hits.where("subject_kind IN ('event', 'person')").select(
        "req", F.col("subject_kind").alias("rel_kind"), F.col("subject_id").alias("rel_id"),
        F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    shared = (art.join(relations, "artifact_id").join(others, ["req", "rel_kind", "rel_id"])
              .where(F.greatest("o_start", "lo") <= F.least("o_end", "hi")))
    return (shared.groupBy("req", "artifact_id", "a_start", "a_end")
            .agg(F.min_by("relation", rank_in("relation", RELATION_ORDER)).alias("relation")))


def margin_notes(requests: DataFrame, links: DataFrame, attestations: DataFrame, events: DataFrame) -> DataFrame:
    """One note per subject and anchor; artifacts carry their strongest relation and are dropped
    where a canon event they attest already covers the anchor."""
    hits = cut_lineage(links_in(requests, links.where("link_type <> 'names'")))   # read by five branches
    attested = attestations.join(events.select("event_id", "axis"), "event_id")
    relations = attested.where("axis <> 'canon'").select(
        "artifact_id", F.lit("event").alias("rel_kind"), F.col("event_id").alias("rel_id"), "relation")
    strongest = strongest_relations(hits, relations)
    canon = attested.where("axis = 'canon'").select("artifact_id", F.col("event_id").alias("rel_id"))
    event_links = hits.where("subject_kind = 'event'").select(
        "req", F.col("subject_id").alias("rel_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    restated = (hits.where("subject_kind = 'artifact'").select("req", F.col("subject_id").alias("artifact_id"), "anchor").distinct()
                .join(canon, "artifact_id").join(event_links, ["req", "rel_id"])
                .where(F.col("anchor").between(F.col("o_start"), F.col("o_end")))
                .select("req", F.lit("artifact").alias("subject_kind"), F.col("artifact_id").alias("subject_id"), "anchor").distinct())
    kept = hits.join(restated, ["req", "subject_kind", "subject_id", "anchor"], "left_anti")
    notes = kept.groupBy("req", "subject_kind", "subject_id", "anchor").agg(
        F.min(F.struct("start", "end", "link_type")).alias("_first"))
    notes = notes.select("req", "subject_kind", "subject_id", "anchor", "_first.start", "_first.end", "_first.link_type")
    rel = strongest.select("req", F.lit("artifact").alias("subject_kind"), F.col("artifact_id").alias("subject_id"),
                           F.col("a_start").alias("start"), F.col("a_end").alias("end"), "relation")
    return notes.join(rel, ["req", "subject_kind", "subject_id", "start", "end"], "left")


def ordered_list(parts: list[Column], sort: list[Column], sep: str = "|") -> Column:
    """Aggregate: text entries joined in the order of ``sort`` (one entity's own rows)."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(sort)], F.concat(*parts).alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"]), sep)


# --- strips ----------------------------------------------------------------------------------------

class Lanes:
    """Ends of the lanes of one strip under a tree of least ends: the first free lane is found by descent."""

    def __init__(self):
        self.width, self.used, self.least = 1, 0, [inf, inf]

    def take(self, start: float, end: float) -> int:
        """The first lane whose last claim ends before ``start``, else a new one; it then ends at ``end``."""
        if self.least[1] < start:
            node = 1
            while node < self.width:
                node = 2 * node if self.least[2 * node] < start else 2 * node + 1
            lane = node - self.width
        else:
            lane = self.used
            self.used += 1
            if lane == self.width:
                leaves = self.least[self.width:]
                self.width *= 2
                self.least = [inf] * self.width + leaves + [inf] * len(leaves)
                for node in range(self.width - 1, 0, -1):
                    self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])
        node = lane + self.width
        self.least[node] = end
        while node > 1:
            node //= 2
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])
        return lane


def strip_claims(events: DataFrame, start: Column, end: Column, scale: float, min_width: float = 8.0, reserve: float = 0.0) -> DataFrame:
    """Bars of the entries that overlap the window, with the room each claims in its lane.

    Adds ``bar_left`` and ``bar_width`` (at least ``min_width``) and ``claim_left``, ``claim_right``.  The bar shows the
    envelope ``earliest`` to ``latest``; the claim also covers the traditional one (``trad_earliest``, ``trad_latest``;
    null: none) and ``reserve`` from the bar's left, the room of its label.  Distances do not count a year zero;
    what lies before the window has negative ones.
    """
    def offset(year: Column) -> Column:
        return F.when(year < start, -span_years(start, year)).otherwise(span_years(start, year)) * scale
    e = events.where((F.col("earliest") <= end) & (F.col("latest") >= start))
    left = offset(F.col("earliest"))
    width = F.greatest(span_years("earliest", "latest") * scale, F.lit(min_width))
    lens_left = offset(F.least("earliest", "trad_earliest"))           # nulls do not count
    lens_right = offset(F.greatest("latest", "trad_latest"))
    return (e.withColumn("bar_left", left.cast("double")).withColumn("bar_width", width.cast("double"))
            .withColumn("claim_left", lens_left.cast("double"))
            .withColumn("claim_right", F.greatest(F.col("bar_left") + F.greatest("bar_width", F.lit(reserve)), lens_right).cast("double")))


def lay_out(events: DataFrame, strip: list[str], left: str, right: str, order: list[str], first: str | None = None) -> DataFrame:
    """First-fit lanes: every bar takes the first lane whose claims all end before it starts.

    Bars are taken in the order of ``order``, those with ``first`` (a boolean column) before the rest.  A time at which
    nothing is claimed frees all lanes, so bars are grouped by island of overlapping claims and only an island is laid
    out in sequence.  Bars taken first hold their lanes up to their ends: the islands of a strip up to the last of these
    ends are one sequence.  ``left`` must not decrease from one island to the next in ``order``.
    """
    asked = F.coalesce(F.col(first), F.lit(False)) if first else F.lit(False)
    events = events.withColumn("_rank", F.when(asked, 0).otherwise(1))
    whole = F.floor(left).cast("bigint")
    claims = events.select(*strip, whole.alias("_s"), F.ceil(right).cast("bigint").alias("_e"))
    # Claims that merely touch are one island: a lane is free only when it ends strictly before.
    islands = S.merge_ranges(claims, "_s", "_e", strip, touch=0)
    starts = events.withColumn("_s", whole).select(*strip, "_s").distinct()
    marks = islands.select(*strip, "_s", F.col("_s").alias("_island"))
    carried = S.running(starts.join(marks, [*strip, "_s"], "left"), "_s", F.expr("_s div 1000000"),
                        {"island": ("last", "_island")}, strip)
    rows = events.withColumn("_s", whole).join(carried.select(*strip, "_s", "island"), [*strip, "_s"]).drop("_s")
    if first:
        held = rows.where("_rank = 0").groupBy(*strip).agg(F.max(right).alias("_held"))
        rows = rows.join(held, strip, "left").withColumn("island", F.when(F.col("island") <= F.col("_held"), None).otherwise(F.col("island"))).drop("_held")

    keys = [*strip, "island"]

    def lanes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive sorted by island; only the lane ends of the current island are held.
        current, now = None, Lanes()
        for pdf in batches:
            out = []
            columns = [pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys]
            for key, a, b in zip(zip(*columns), pdf[left], pdf[right]):
                if key != current:
                    current, now = key, Lanes()
                out.append(now.take(a, b))
            yield pdf.assign(lane=out)

    schema = StructType([*rows.schema.fields, StructField("lane", LongType())])
    return (rows.repartition(*keys).sortWithinPartitions(*keys, "_rank", *order)
            .mapInPandas(lanes, schema).drop("island", "_rank"))


def limit_rows(bars: DataFrame, max_rows: int) -> DataFrame:
    return bars.withColumn("hidden", F.col("lane") >= max_rows)


def diversity_gate(entries: DataFrame, series: list[str], day: str, facets: dict[str, int], size: int = 30) -> DataFrame:
    """Windows of ``size`` consecutive entries with too few distinct values of a facet.

    One entry per date, so a series is bounded by the calendar.
    """
    order = W.partitionBy(*series).orderBy(day)
    frame = order.rowsBetween(-(size - 1), 0)
    out = entries.withColumn("_k", F.count(F.lit(1)).over(frame))
    for col in facets:
        out = out.withColumn(f"n_{col}", F.size(F.collect_set(col).over(frame)).cast("bigint"))
    short = F.lit(False)
    for col, least in facets.items():
        short = short | (F.col(f"n_{col}") < least)
    return out.where(F.col("_k") == size).withColumn("fails", short).drop("_k")
