"""Alignment state carried from file to file of an edition, as keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .flows import LATENESS

RESULT = "file_no bigint, rate_in double, rate_out double, done bigint, missing bigint, carried_in bigint, carried_out bigint, n_late bigint"
KEEP, TAKE = 0.6, 0.4          # moving average: weight of the rate so far, weight of the chapter


class AlignmentTracker(StatefulProcessor):
    """State of one edition: its rate, the chapters carried over, the files that are not complete yet.

    A file is complete once the watermark reaches its end; files are taken in the order of their ends, so chapters and
    files may arrive in any order.  Chapters of a complete file are late: each batch returns one row a file with their
    number and no rates.  A complete file leaves the state.
    """

    def __init__(self, edition: str, initial_rate: float, low: float, good: float, min_score: float, min_rate: float, max_rate: float):
        self.initial, self.low, self.good = initial_rate, low, good
        self.min_score, self.min_rate, self.max_rate = min_score, min_rate, max_rate
        self.out = Row(edition, *(field.split()[0] for field in RESULT.split(", ")))

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ends_us bigint, file_no bigint, seq bigint, score double, rate double, ran_out boolean")
        self.carried = handle.getValueState("carried", "rate double, chapters bigint")
        self.timer = handle.getValueState("timer", "due_ms bigint")

    def _wake(self, ends_us: int) -> None:
        due = -(-ends_us // 1000)
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or due < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh, late = [], {}
        for r in rows:
            if passed > 0 and r.ends_us <= passed:
                late[r.file_no] = late.get(r.file_no, 0) + 1
            else:
                fresh.append((r.ends_us, r.file_no, r.seq, r.score, r.rate, r.ran_out))
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(f[0] for f in fresh))
        for file_no, n in sorted(late.items()):
            yield self.out(*key, file_no, None, None, 0, 0, 0, 0, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        later = [w for w in waiting if w[0] > passed]
        files: dict[tuple[int, int], list[tuple]] = {}
        for w in waiting:
            if w[0] <= passed:
                files.setdefault(w[:2], []).append(w[2:])
        rate, carried = tuple(self.carried.get()) if self.carried.exists() else (self.initial, 0)
        for (_, file_no), chapters in sorted(files.items()):
            rate_out, done, missing, left = self._file(rate, sorted(chapters, key=lambda c: c[0]))
            yield self.out(*key, file_no, rate, rate_out, done, missing, carried, left, 0)
            rate, carried = rate_out, left
        if files:
            self.carried.update((rate, carried))
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(min(w[0] for w in later))

    def _file(self, rate: float, chapters: list[tuple]) -> tuple[float, int, int, int]:
        """(rate after the file, chapters done, skipped, left over): the chapters of a file in their order."""
        done = missing = left = 0
        following = [c[1] for c in chapters[1:]] + [None]
        for (_, score, speed, ran_out), after in zip(chapters, following):
            if ran_out:
                left += 1
            elif score is not None and after is not None and score < self.low and after >= self.good:
                missing += 1
            else:
                done += 1
                if score is not None and speed is not None and score > self.min_score and self.min_rate < speed < self.max_rate:
                    rate = KEEP * rate + TAKE * speed
        return rate, done, missing, left


def alignment_stream(chapters: DataFrame, edition: str, ends: str, initial_rate: float, low: float = 0.5, good: float = 0.7, min_score: float = 0.5,
                     min_rate: float = 3.0, max_rate: float = 40.0, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """One row per complete file, in append mode: speaking rate in and out, chapters done, skipped and carried over.

    ``chapters``: edition, file_no, seq, score, rate, ran_out, the event time ``ts`` and ``ends``, the time in
    microseconds at which the file is over.  Rows without edition, file, time or end are left out; a null ``ran_out`` is
    false.  Rows with ``n_late`` above zero report chapters that came after their file was complete.  Files not complete
    when the input ends stay in the state for a run over the same checkpoint.
    """
    rows = (chapters.where(F.col(ts).isNotNull() & F.col(edition).isNotNull() & F.col("file_no").isNotNull() & F.col(ends).isNotNull())
            .withWatermark(ts, lateness)
            .select(edition, F.col(ends).cast("bigint").alias("ends_us"), F.col("file_no").cast("bigint").alias("file_no"),
                    F.col("seq").cast("bigint").alias("seq"), F.col("score").cast("double").alias("score"), F.col("rate").cast("double").alias("rate"),
                    F.coalesce("ran_out", F.lit(False)).alias("ran_out")))
    kind = rows.schema[edition].dataType.simpleString()
    tracker = AlignmentTracker(edition, initial_rate, low, good, min_score, min_rate, max_rate)
    return rows.groupBy(edition).transformWithState(tracker, f"`{edition}` {kind}, {RESULT}", "Append", "EventTime")
