"""Timed media: intervals, scores, alignment state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def successor(df: DataFrame, order: str, block: Column, partition: list[str], name: str) -> DataFrame:
    """Next value of ``order`` within the partition, looked up block by block.

    Rows must be unique in (partition, order); a partition with most of the
    rows is spread over its blocks.
    """
    b = df.withColumn("_blk", block)
    local = F.lead(order).over(W.partitionBy(*partition, "_blk").orderBy(order))
    heads = b.groupBy(*partition, "_blk").agg(F.min(order).alias("_head"))
    heads = heads.withColumn("_next", F.lead("_head").over(W.partitionBy(*partition).orderBy("_blk"))).drop("_head")
    return (b.withColumn("_local", local).join(heads, [*partition, "_blk"])
            .withColumn(name, F.coalesce("_local", "_next")).drop("_blk", "_local", "_next"))


def chapter_scores(verses: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and least score, and characters per second, per chapter."""
    return verses.groupBy(*keys).agg(
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 4).alias("min_score"),
        F.round(F.sum("n_chars") / F.greatest((F.max("end_ms") - F.min("start_ms")) / 1000.0, F.lit(0.001)), 2).alias("rate"))


def score_census(chapters: DataFrame, edition: str, floor: float) -> DataFrame:
    kept = F.col("mean_score") >= floor
    return chapters.groupBy(edition).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def before_drift(chapters: DataFrame, file_keys: list[str], seq: str, score: str, low: float) -> DataFrame:
    """Rows of each file up to the first drift: two low scores in a row, or a low last one."""
    order = W.partitionBy(*file_keys).orderBy(seq)
    nxt = F.lead(score).over(order)
    drift = (F.col(score) < low) & (nxt.isNull() | (nxt < low))
    marked = chapters.withColumn("_at", F.when(drift, F.col(seq)))
    first = marked.groupBy(*file_keys).agg(F.min("_at").alias("_drift"))
    return (marked.drop("_at").join(first, file_keys)
            .where(F.col("_drift").isNull() | (F.col(seq) < F.col("_drift"))).drop("_drift"))


HORIZON = 200


def alignment_state(chapters: DataFrame, edition: str, file_no: str, seq: str, initial_rate: float,
                    low: float = 0.5, good: float = 0.7, min_score: float = 0.5,
                    min_rate: float = 3.0, max_rate: float = 40.0) -> DataFrame:
    """Resumable state per file: speaking rate in and out, chapters done, skipped and carried over.

    The rate is a moving average (0.6 old, 0.4 new) over sane chapters.  It is
    a linear recurrence, so each file is reduced to what it adds and how many
    chapters it ages the rest; a file sums the additions of the last
    ``HORIZON`` chapters, before which a chapter weighs less than 1e-40.
    Input columns: score, rate, ran_out (the audio ended before the chapter).
    """
    nxt = F.lead("score").over(W.partitionBy(edition, file_no).orderBy(seq))
    skipped = (F.col("score") < low) & (nxt >= good)
    sane = ~F.col("ran_out") & ~F.coalesce(F.col("skipped"), F.lit(False)) & (F.col("score") > min_score) \
        & (F.col("rate") > min_rate) & (F.col("rate") < max_rate)
    rows = chapters.withColumn("skipped", F.coalesce(skipped, F.lit(False)) & ~F.col("ran_out"))
    steps = F.array_sort(F.collect_list(F.when(sane, F.struct(F.col(seq).alias("s"), F.col("rate").alias("m")))))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc, x):
        return F.struct((acc["a"] * 0.6).alias("a"), (acc["b"] * 0.6 + x["m"] * 0.4).alias("b"))
    files = rows.groupBy(edition, file_no).agg(
        steps.alias("_s"), F.count_if(~F.col("ran_out") & ~F.col("skipped")).alias("done"),
        F.count_if("skipped").alias("missing"), F.count_if("ran_out").alias("carried_out"))
    files = files.withColumn("_b", F.aggregate("_s", start, step)["b"]).withColumn("_n", F.size("_s").cast("bigint")).drop("_s")
    # After n sane chapters the first rate weighs 0.6**n, and what a file added weighs 0.6 to the number of chapters since.
    order = W.partitionBy(edition).orderBy(file_no)
    files = files.withColumn("_to", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    recent = W.partitionBy(edition).orderBy("_to").rangeBetween(-HORIZON, 0)
    added = F.collect_list(F.when(F.col("_n") > 0, F.struct("_to", "_b"))).over(recent)     # one per sane chapter at most
    rate_out = F.aggregate(added, F.pow(F.lit(0.6), F.col("_to")) * initial_rate, lambda r, f: r + f["_b"] * F.pow(F.lit(0.6), F.col("_to") - f["_to"]))
    files = files.withColumn("rate_out", rate_out)
    return (files.withColumn("rate_in", F.coalesce(F.lag("rate_out").over(order), F.lit(initial_rate)))
            .withColumn("carried_in", F.coalesce(F.lag("carried_out").over(order), F.lit(0).cast("bigint"))).drop("_b", "_n", "_to"))
