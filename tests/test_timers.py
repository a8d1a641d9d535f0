"""Sessions and alignment in keyed state: any arrival order, late rows, restarts, equal to the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from canonframe.operators import media as M
from canonframe.streaming import alignment as Al, flows as Fl, sessions as Ss

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, who string, item long, kind string, ts timestamp, us long"
MINUTE = 60_000_000


def event(i, who, minutes, kind="view", item=1):
    return i, who, item, kind, T0 + dt.timedelta(minutes=minutes), None


def put(spark, path, batches, schema):
    for rows in batches:                                            # files are read in the order of their writing
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, schema):
    return Fl.change_source(spark, str(path), spark.createDataFrame([], schema).schema, max_files=1)


def tracked(spark, path, at=None):
    done = F.col("kind") == "finish"
    return Fl.run_to_table(Ss.completed_sessions(source(spark, path, EVENTS), ["who", "item"], done, 30 * MINUTE), timers=True, at=at)


def since(us):
    return None if us is None else round((us / 1e6 - T0.replace(tzinfo=dt.timezone.utc).timestamp()) / 60, 3)


def table(df):
    return sorted((r.who, r.item, since(r.first_us), since(r.last_us), r.n_events, r.active_us / 1e6, r.ended) for r in df.collect())


def test_sessions_end_by_completion_or_timer(spark, tmp_path):
    rows = [event(1, "a", 0), event(2, "a", .5), event(3, "a", 20, "finish"), event(4, "a", 21), event(5, "a", 51), event(6, "b", 5, None),
            event(7, None, 5), event(8, "a", 3, item=2), event(9, "z", 1000), event(10, "c", 940), event(11, "c", 940, "finish"),
            (12, "a", 1, "view", None, None)]
    put(spark, tmp_path / "in", [rows], EVENTS)
    # 21 and 51 are just 30 minutes apart: two sessions; z lies past the watermark and stays open.
    assert table(tracked(spark, tmp_path / "in")) == [
        ("a", 1, 0, 20, 3, 90.0, "completed"), ("a", 1, 21, 21, 1, 0.0, "expired"), ("a", 1, 51, 51, 1, 0.0, "expired"),
        ("a", 2, 3, 3, 1, 0.0, "expired"), ("b", 1, 5, 5, 1, 0.0, "expired"), ("c", 1, 940, 940, 2, 0.0, "completed")]
    twin = Ss.sessions_of(spark.createDataFrame(rows, EVENTS), ["who", "item"], F.col("kind") == "finish", 30 * MINUTE)
    assert table(twin)[:-1] == table(tracked(spark, tmp_path / "in")) and table(twin)[-1][0] == "z"
    totals = {(r.who, r.item): (r.n_sessions, r.n_completed, r.n_events) for r in Ss.progress(twin, ["who", "item"]).collect()}
    assert totals["a", 1] == (3, 1, 5) and totals["c", 1] == (1, 1, 2)


def test_sessions_of_shuffled_files_equal_the_batch(spark, tmp_path):
    """Files hold overlapping times (within the lateness) in a random order; nothing is late, so nothing may differ."""
    rnd = random.Random(5)
    rows = [event(i, rnd.choice("abc"), m, rnd.choice(["view"] * 6 + ["finish"]), rnd.randrange(2)) for i, m in
            enumerate(sorted(rnd.randrange(0, 1200) for _ in range(150)))]
    rows += [event(1000 + n, who, 3000, item=item) for n, (who, item) in enumerate((w, i) for w in "abc" for i in (0, 1))]
    moved = sorted(rows, key=lambda r: (r[4] + dt.timedelta(minutes=rnd.uniform(0, 55))))
    put(spark, tmp_path / "in", [moved[:50], moved[50:100], moved[100:]], EVENTS)
    got = tracked(spark, tmp_path / "in")
    twin = Ss.sessions_of(spark.createDataFrame(rows, EVENTS), ["who", "item"], F.col("kind") == "finish", 30 * MINUTE)
    assert table(got) == [r for r in table(twin) if r[3] < 3000]


def test_late_rows_are_reported(spark, tmp_path):
    put(spark, tmp_path / "in", [[event(1, "a", 0), event(2, "b", 300)], [event(3, "a", 10), event(4, "b", 250)], [event(5, "q", 900)]], EVENTS)
    assert table(tracked(spark, tmp_path / "in")) == [
        ("a", 1, 0, 0, 1, 0.0, "expired"), ("a", 1, 10, 10, 1, 0.0, "late"), ("b", 1, 250, 250, 1, 0.0, "expired"), ("b", 1, 300, 300, 1, 0.0, "expired")]


def test_a_restart_in_the_middle_gives_the_same_table(spark, tmp_path):
    parts = [[event(1, "a", 0), event(2, "a", 20), event(3, "b", 55)], [event(4, "a", 45, "finish"), event(5, "a", 46), event(6, "b", 80)],
             [event(7, "a", 70), event(8, "b", 100)], [event(9, "z", 900)]]
    put(spark, tmp_path / "whole", parts, EVENTS)
    put(spark, tmp_path / "parts", parts[:2], EVENTS)
    at = str(tmp_path / "run")
    first = table(tracked(spark, tmp_path / "parts", at))
    put(spark, tmp_path / "parts", parts[2:], EVENTS)
    both = table(tracked(spark, tmp_path / "parts", at))
    assert first != both and both == table(tracked(spark, tmp_path / "whole"))
    assert ("a", 1, 0, 45, 3, 120.0, "completed") in both and ("a", 1, 46, 70, 2, 60.0, "expired") in both
    assert table(tracked(spark, tmp_path / "parts", at)) == both                       # nothing new, nothing twice


def test_a_failed_batch_is_repeated(spark, tmp_path):
    """The sink fails once in the middle; the next run repeats the batch from the same state."""
    parts = [[event(1, "a", 0), event(2, "b", 200)], [event(3, "a", 190), event(4, "b", 400)], [event(5, "z", 900)]]
    put(spark, tmp_path / "in", parts, EVENTS)
    at, failed = str(tmp_path / "run"), []

    def write(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{at}/out/batch_id={batch_id}")
    stream = Ss.completed_sessions(source(spark, tmp_path / "in", EVENTS), ["who", "item"], F.col("kind") == "finish", 30 * MINUTE)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(write)
    with pytest.raises(Exception):
        Fl._start_with_timers(spark, writer).awaitTermination()
    assert failed and table(tracked(spark, tmp_path / "in", at)) == table(tracked(spark, tmp_path / "in"))


def test_no_events(spark, tmp_path):
    put(spark, tmp_path / "in", [[]], EVENTS)
    assert table(tracked(spark, tmp_path / "in")) == []
    assert Ss.sessions_of(spark.createDataFrame([], EVENTS), ["who"], F.lit(True), 1).count() == 0


CHAPTERS = "ed string, file_no long, seq long, score double, rate double, ran_out boolean, ts timestamp, ends_us long"
HOUR = 3600 * 10 ** 6


def chapters_of(rnd, files=6):
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 10 ** 6
    return [(ed, f, c, rnd.random(), rnd.uniform(1, 45), rnd.random() < .15, T0 + dt.timedelta(hours=f, minutes=7 * c), start + (f + 1) * HOUR)
            for ed in "xy" for f in range(files) for c in range(8)]


def states(df):
    return sorted((r.ed, r.file_no, round(r.rate_in, 9), round(r.rate_out, 9), r.done, r.missing, r.carried_in, r.carried_out) for r in df.collect())


def aligned(spark, path, at=None):
    return Fl.run_to_table(Al.alignment_stream(source(spark, path, CHAPTERS), "ed", "ends_us", 13.0), timers=True, at=at)


def test_alignment_is_carried_between_files_and_runs(spark, tmp_path):
    rnd = random.Random(6)
    rows = chapters_of(rnd)
    beyond = [("x", 99, 0, .9, 10.0, False, T0 + dt.timedelta(hours=99), (24 * 3650 + 10 ** 6) * HOUR)]
    moved = sorted(rows, key=lambda r: r[6] + dt.timedelta(minutes=rnd.uniform(0, 55))) + beyond
    at = str(tmp_path / "run")
    put(spark, tmp_path / "in", [moved[:30], moved[30:50]], CHAPTERS)
    early = states(aligned(spark, tmp_path / "in", at))
    put(spark, tmp_path / "in", [moved[50:90], moved[90:]], CHAPTERS)
    out = aligned(spark, tmp_path / "in", at)
    want = states(M.alignment_state(spark.createDataFrame(rows, CHAPTERS), "ed", "file_no", "seq", 13.0))
    assert states(out) == want and 0 < len(early) < len(want)
    assert out.where("n_late > 0").count() == 0


def test_late_chapters_are_counted(spark, tmp_path):
    rows = [r for r in chapters_of(random.Random(7), 5) if r[0] == "x"]
    put(spark, tmp_path / "in", [rows[:8] + rows[24:], rows[8:12] + rows[5:6]], CHAPTERS)
    got = sorted((r.file_no, r.rate_in is None, r.n_late) for r in aligned(spark, tmp_path / "in").collect())
    # The first batch moves the watermark to 3:49: files 0 to 2 are over before the second one comes.
    assert got == [(0, False, 0), (0, True, 1), (1, True, 4)]
