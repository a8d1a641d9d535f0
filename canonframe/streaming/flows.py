"""Stateful change flows as Structured Streaming jobs.

Late-data policy: one hour.  Rows later than the watermark are left out of
windows; duplicates of a change are removed within it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import annotations as An
from ..session import shared_folder

LATENESS = "1 hour"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str = "append", combine: Callable[[DataFrame], DataFrame] | None = None,
                 timers: bool = False, at: str | None = None) -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    Every micro-batch is written under its batch number (a repeated batch
    overwrites itself, so a restart writes nothing twice).  ``combine`` turns
    the batches, with their ``batch_id``, into the final table.  ``timers``
    chooses the state store that timers need.  A run ``at`` the folder of an
    earlier one goes on from its state and returns what both wrote.
    """
    spark = stream.sparkSession
    root = at or f"{shared_folder(spark)}/canonframe-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")
    writer = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
              .option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write))
    query = _start_with_timers(spark, writer) if timers else writer.start()
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    written = spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    return combine(written) if combine else written.drop("batch_id")


def _start_with_timers(spark: SparkSession, writer):
    """A query keeps the settings it starts with, so the store is set for the start alone."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def latest_batch(written: DataFrame) -> DataFrame:
    """Complete mode rewrites the whole result: the last batch is the table."""
    last = written.select(F.max("batch_id")).scalar()
    return written.where(F.col("batch_id") == last).drop("batch_id")


def change_source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def deduplicated(changes: DataFrame, change_id: str, ts: str) -> DataFrame:
    return changes.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([change_id])


def compact(log: DataFrame, keys: list[str]) -> DataFrame:
    """The changes that can still matter: of each key the last create and everything after it, before any create nothing is lost."""
    last = log.where("op = 'create'").groupBy(*keys).agg(F.max("seq").alias("_last"))
    kept = log.join(last, keys, "left").where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last"))).drop("_last")
    return kept.dropDuplicates([*keys, "seq", "op"])


def merge_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Create / patch / soft delete per key: the latest states after all available input.

    ``changes``: keys, op, body, seq (the change order).  A patch or delete of
    a row that is not there or already deleted does nothing; a create starts
    the row again.  Every micro-batch is merged with the compacted log of the
    batch before and written under its own number, so changes may arrive in any
    order and any number of files, a repeated batch overwrites itself, and
    nothing but the shared folder holds state.
    """
    spark = changes.sparkSession
    root = f"{shared_folder(spark)}/canonframe-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        log = batch if batch_id == 0 else batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{root}/log/{batch_id - 1}"))
        compact(log, keys).write.mode("overwrite").parquet(f"{root}/log/{batch_id}")
        done.append(batch_id)
    query = (changes.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).start())
    query.awaitTermination()
    if not done:
        return final_states(spark.createDataFrame([], changes.schema), keys)
    return final_states(spark.read.schema(changes.schema).parquet(f"{root}/log/{max(done)}"), keys)


def final_states(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Latest states of a change log by three aggregates: last create, first delete after it, last patch between."""
    created = changes.where("op = 'create'").groupBy(*keys).agg(F.max_by(F.struct("seq", "body"), "seq").alias("_c"))
    after = changes.join(created, keys).where(F.col("seq") > F.col("_c.seq"))
    deleted = after.where("op = 'delete'").groupBy(*keys).agg(F.min("seq").alias("_d"))
    patched = (after.where("op = 'patch'").join(deleted, keys, "left").where(F.col("_d").isNull() | (F.col("seq") < F.col("_d")))
               .groupBy(*keys).agg(F.max_by(F.struct("seq", "body"), "seq").alias("_p")))
    j = created.join(deleted, keys, "left").join(patched, keys, "left")
    return j.select(*keys, F.col("_d").isNull().alias("alive"), F.coalesce("_p.body", "_c.body").alias("body"),
                    F.col("_c.seq").alias("created"), F.coalesce("_d", "_p.seq", "_c.seq").alias("updated"))


def fan_out_changes(changes: DataFrame, space: DataFrame) -> DataFrame:
    """Upsert / remove messages per real address; the stream meets the static space."""
    kind = F.when(F.col("op") == "delete", "remove").otherwise("upsert")
    return An.fan_out(changes.withColumn("message", kind), space)


def reconcile(optimistic: DataFrame, confirmed: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Temporary id -> server id: the confirmations of the same key within the time limit.

    Both sides carry a watermark, so rows leave the state; an unconfirmed one does with a null server id once no
    confirmation can come any more.  ``with_pending`` adds those that still wait when the input ends.
    """
    o = optimistic.withWatermark("o_ts", LATENESS)
    c = confirmed.withWatermark("c_ts", LATENESS)
    same = [o[k] == c[k] for k in keys]
    window = (F.col("c_ts") >= F.col("o_ts")) & (F.col("c_ts") <= F.col("o_ts") + F.expr(f"INTERVAL {within}"))
    cond = window
    for s in same:
        cond = cond & s
    return o.join(c, cond, "leftOuter").select(*[o[k] for k in keys], "temp_id", "server_id")


def with_pending(settled: DataFrame, optimistic: DataFrame, keys: list[str]) -> DataFrame:
    """Every temporary id: the settled ones, and the rest with a null server id."""
    rest = optimistic.select(*keys, "temp_id").join(settled.select("temp_id"), "temp_id", "left_anti")
    return settled.unionByName(rest.withColumn("server_id", F.lit(None).cast("bigint")))


def reading_sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", cap_seconds: int = 60) -> DataFrame:
    """Sessions per reader: first and last seen, events, active seconds (each interval counts at most ``cap_seconds``)."""
    return (events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), *keys)
            .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                 F.sum(F.least(F.col("seconds"), F.lit(cap_seconds))).alias("active_seconds")))


def windowed_counts(events: DataFrame, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) counts under the watermark."""
    return (events.withWatermark("ts", LATENESS).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))
