"""Range annotations: validity rules, anchors, live rows, fan-out to addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import address as A
from . import space as S

# Fixed values of the annotation rules.
KINDS = ["highlight", "note", "bookmark"]
MAX_BODY = 20_000
MAX_QUOTED = 4_000
MAX_TAGS = 32
MAX_TAG_LENGTH = 64
COLOR_TOKEN = r"^[a-z][a-z0-9-]{0,23}$"


def _problems(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules]),
                    lambda p: p.isNotNull())


def check_shape(df: DataFrame) -> DataFrame:
    """Adds ``problems``: shape and arithmetic rules that need no corpus."""
    s_off, e_off = F.col("start_offset"), F.col("end_offset")
    has = s_off.isNotNull() & e_off.isNotNull()
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return df.withColumn("problems", _problems([
        (~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "kind"),
        (~F.coalesce(A.is_encodable("start_addr"), F.lit(False)), "start address"),
        (~F.coalesce(A.is_encodable("end_addr"), F.lit(False)), "end address"),
        (F.col("end_addr") < F.col("start_addr"), "reversed"),
        (s_off.isNull() != e_off.isNull(), "offsets not paired"),
        (has & ((s_off < 0) | (e_off < 0)), "negative offset"),
        (has & (F.col("start_addr") == F.col("end_addr")) & (e_off <= s_off), "empty offsets"),
        (has & F.col("edition").isNull(), "offsets need an edition"),
        (F.length("quoted") > MAX_QUOTED, "quoted too long"),
        (F.length("body") > MAX_BODY, "body too long"),
        (F.col("color").isNotNull() & ~F.col("color").rlike(COLOR_TOKEN), "color"),
        (F.size(tags) > MAX_TAGS, "too many tags"),
        (F.exists(tags, lambda x: (F.length(x) == 0) | (F.length(x) > MAX_TAG_LENGTH)), "tag length"),
    ]))


def check_anchor(df: DataFrame, space: DataFrame, lengths: DataFrame, editions: DataFrame) -> DataFrame:
    """Adds ``anchor_problems``: unknown edition, address that does not exist, offsets past the text.

    ``lengths``: edition, addr, n_chars of the printed texts.
    """
    d = df.join(editions.select("edition").withColumn("_ed", F.lit(True)), "edition", "left")
    for side in ("start", "end"):
        real = space.select(F.col("addr").alias(f"{side}_addr")).withColumn(f"_{side}", F.lit(True))
        d = d.join(real, f"{side}_addr", "left")
        size = lengths.select("edition", F.col("addr").alias(f"{side}_addr"), F.col("n_chars").alias(f"_{side}_len"))
        d = d.join(size, ["edition", f"{side}_addr"], "left")
    has = F.col("start_offset").isNotNull() & F.col("end_offset").isNotNull()
    printed = F.col("_start_len").isNotNull() & F.col("_end_len").isNotNull()
    out = d.withColumn("anchor_problems", _problems([
        (F.col("edition").isNotNull() & F.col("_ed").isNull(), "unknown edition"),
        (F.col("_start").isNull(), "start does not exist"), (F.col("_end").isNull(), "end does not exist"),
        (has & ~printed, "offsets on unprinted text"),
        (has & printed & (F.col("start_offset") >= F.col("_start_len")), "start past text"),
        (has & printed & (F.col("end_offset") > F.col("_end_len")), "end past text"),
    ]))
    return out.drop("_ed", "_start", "_end", "_start_len", "_end_len")


def live(annotations: DataFrame) -> DataFrame:
    """What a user still has: soft-deleted rows are left out."""
    return annotations.where("deleted_at IS NULL")


def fan_out(changes: DataFrame, space: DataFrame) -> DataFrame:
    """One message per real address a change spans; works on a stream joined to a static space.

    The range is walked by position in the space, so sparse addresses and
    chapter crossings cost what they hold.  Ranges are not capped.
    """
    one = changes.where("start_addr = end_addr").withColumn("addr", F.col("start_addr"))
    many = S.expand_ranges(changes.where("start_addr < end_addr"), space, "start_addr", "end_addr")
    return one.unionByName(many)


# --- decorations -------------------------------------------------------------------------------------

# Which kind wins the background of a segment.
KIND_PRIORITY = {"search-hit": 60, "highlight": 50, "note": 40, "variant": 30, "crossref": 20, "source": 10}


def segments(texts: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Flat segments of every text with the marks that cover them.

    ``texts``: keys, n_chars; ``marks``: keys, mark_id, kind, start, end.
    Boundaries are made per text and a mark is attached to the segments it
    spans by walking boundary numbers, so no pair of mark and segment that do
    not touch is ever formed.
    """
    from pyspark.sql import Window as W
    base = texts.where("n_chars > 0").select(*keys, "n_chars")
    m = marks.join(base, keys).withColumn("s", F.greatest(F.lit(0), F.least("start", "n_chars"))).withColumn(
        "e", F.greatest(F.lit(0), F.least("end", "n_chars"))).where("e > s").select(*keys, "mark_id", "kind", "s", "e")
    points = (m.select(*keys, F.explode(F.array("s", "e")).alias("p"))
              .unionByName(base.select(*keys, F.explode(F.array(F.lit(0).cast("int"), F.col("n_chars").cast("int"))).alias("p")))).distinct()
    order = W.partitionBy(*keys).orderBy("p")
    cuts = points.withColumn("no", F.row_number().over(order)).withColumn("q", F.lead("p").over(order))
    nos = cuts.select(*keys, "p", "no")
    spans = (m.join(nos.select(*keys, F.col("p").alias("s"), F.col("no").alias("a")), [*keys, "s"])
             .join(nos.select(*keys, F.col("p").alias("e"), F.col("no").alias("b")), [*keys, "e"]))
    rank = F.lit(0)
    for kind, value in KIND_PRIORITY.items():
        rank = F.when(F.col("kind") == kind, value).otherwise(rank)
    covered = spans.withColumn("_rank", rank).withColumn("no", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    active = covered.groupBy(*keys, "no").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("mark_id").cast("string"))), ",").alias("marks"),
        F.max_by("kind", F.struct("_rank", (-F.col("mark_id")).alias("x"))).alias("dominant"), F.count(F.lit(1)).alias("n_marks"))
    out = cuts.where("q IS NOT NULL").select(*keys, F.col("p").alias("start"), F.col("q").alias("end"), "no").join(active, [*keys, "no"], "left")
    return out.select(*keys, "start", "end", F.coalesce("marks", F.lit("")).alias("marks"), F.coalesce("dominant", F.lit("")).alias("dominant"),
                      F.coalesce("n_marks", F.lit(0).cast("bigint")).alias("n_marks"))
