"""Completed reading sessions: keyed state with event-time timers, and the same table from a batch.

A session holds the events of a key, in order of time and id, each less than ``gap`` after the one before.  It ends with
a completion event (``completed``) or once the watermark is ``gap`` past its last event (``expired``).  Every interval
between two of its events counts as active time, at most ``cap`` of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from .flows import LATENESS

RESULT = [("first_us", "bigint"), ("last_us", "bigint"), ("n_events", "bigint"), ("active_us", "bigint"), ("ended", "string")]


class SessionTracker(StatefulProcessor):
    """State of one key: events the watermark has not passed yet, the open session, and the next timer.

    Events wait until the watermark is at or past them, so they are taken in order however they arrive.  One timer a key
    is enough: the earliest of the first waiting event and the end of the open session.  When both are gone the key
    leaves the state.  Rows at or before the watermark are late; each is returned as a row of its own, ``ended = 'late'``.
    """

    def __init__(self, keys: list[str], gap_us: int, cap_us: int):
        self.keys, self.gap, self.cap = keys, gap_us, cap_us
        self.out = Row(*keys, *(name for name, _ in RESULT))

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, id bigint, completes boolean")
        self.open = handle.getValueState("open", "first_us bigint, last_us bigint, n_events bigint, active_us bigint")
        self.timer = handle.getValueState("timer", "due_ms bigint")

    def _row(self, key: tuple, first: int, last: int, n: int, active: int, ended: str) -> Row:
        return self.out(*key, first, last, n, active, ended)

    def _wake(self, due_us: int) -> None:
        """Keep the earliest of the timers asked for."""
        due = -(-due_us // 1000)
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or due < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = []
        for r in rows:
            if passed > 0 and r.us <= passed:
                yield self._row(key, r.us, r.us, 1, 0, "late")
            else:
                fresh.append((r.us, r.id, bool(r.completes)))
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(fresh)[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ready = [w for w in waiting if w[0] <= passed]
        later = waiting[len(ready):]
        session = tuple(self.open.get()) if self.open.exists() else None
        for us, _, completes in ready:
            if session and us - session[1] >= self.gap:
                yield self._row(key, *session, "expired")
                session = None
            first, last, n, active = session or (us, us, 0, 0)
            session = (first, us, n + 1, active + min(us - last, self.cap))
            if completes:
                yield self._row(key, *session, "completed")
                session = None
        if session and session[1] + self.gap <= passed:
            yield self._row(key, *session, "expired")
            session = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.open.update(session) if session else self.open.clear()
        due = ([later[0][0]] if later else []) + ([session[1] + self.gap] if session else [])
        if due:
            self._wake(min(due))


def _result(df: DataFrame, keys: list[str]) -> T.StructType:
    kinds = T.StructType([df.schema[k] for k in keys])
    return T.StructType(kinds.fields + T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in RESULT)).fields)


def completed_sessions(events: DataFrame, keys: list[str], completes, gap_us: int, cap_us: int = 60_000_000,
                       ts: str = "ts", id_col: str = "event_id", lateness: str = LATENESS) -> DataFrame:
    """Closed sessions and late rows of a stream, in append mode.

    ``completes`` is a condition (null: no).  Rows without a time or a key part are left out.  Sessions still open when
    the input ends stay in the state and are returned by a later run over the same checkpoint.  The time column is
    replaced by its microseconds before the state, so late rows reach the tracker and are reported instead of dropped.
    What a key holds in memory is its events of one batch and the lateness; ``max_files`` of the source bounds a batch.
    Needs the RocksDB state store (``run_to_table(..., timers=True)`` sets it).
    """
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = (events.where(known).withWatermark(ts, lateness)
            .select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(id_col).cast("bigint").alias("id"),
                    F.coalesce(completes, F.lit(False)).alias("completes")))
    return rows.groupBy(*keys).transformWithState(SessionTracker(keys, gap_us, cap_us), _result(rows, keys), "Append", "EventTime")


def sessions_of(events: DataFrame, keys: list[str], completes, gap_us: int, cap_us: int = 60_000_000,
                ts: str = "ts", id_col: str = "event_id", passed_us: int | None = None) -> DataFrame:
    """The same sessions from a whole table, by windows; those the watermark ``passed_us`` leaves open end as ``open``.

    Without a watermark every session is closed.  Events past the watermark are not taken.
    """
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = events.where(known).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(id_col).cast("bigint").alias("id"),
                                      F.coalesce(completes, F.lit(False)).alias("completes"))
    if passed_us is not None:
        rows = rows.where(F.col("us") <= passed_us)
    order = W.partitionBy(*keys).orderBy("us", "id", "completes")
    rows = rows.withColumn("_since", F.col("us") - F.lag("us").over(order))
    begins = F.col("_since").isNull() | (F.col("_since") >= gap_us) | F.lag("completes").over(order)
    rows = rows.withColumn("_begins", begins).withColumn("_session", F.count_if("_begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    active = F.when(F.col("_begins"), 0).otherwise(F.least("_since", F.lit(cap_us)))
    closed = F.lit(True) if passed_us is None else F.col("last_us") + gap_us <= passed_us
    return (rows.groupBy(*keys, "_session")
            .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n_events"),
                 F.sum(active).cast("bigint").alias("active_us"), F.bool_or("completes").alias("_done"))
            .withColumn("ended", F.when(F.col("_done"), "completed").when(closed, "expired").otherwise("open"))
            .drop("_session", "_done"))


def progress(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: first and last seen, sessions, completed ones, events and active time (late rows do not count)."""
    return (sessions.where("ended <> 'late'").groupBy(*keys)
            .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count(F.lit(1)).alias("n_sessions"),
                 F.count_if(F.col("ended") == "completed").alias("n_completed"), F.sum("n_events").alias("n_events"),
                 F.sum("active_us").alias("active_us")))
