import datetime as dt
import random

from pyspark.sql import functions as F

from canonframe.streaming import flows as Fl

SCHEMA = "id long, k long, op string, body string, seq long, ts timestamp"


def write_files(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_change_log_over_several_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(8), rnd.choice(["create", "patch", "patch", "delete"]), f"b{i}", i, t0 + dt.timedelta(minutes=i)) for i in range(120)]
    write_files(spark, tmp_path / "in", [rows[:40], rows[40:80], rows[80:]])
    src = Fl.change_source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, max_files=1)
    out = Fl.merge_changes(src.select("k", "op", "body", "seq"), ["k"])
    want = Fl.final_states(spark.createDataFrame(rows, SCHEMA), ["k"])
    cols = ["k", "alive", "body", "created", "updated"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_change_log_does_not_depend_on_arrival(spark, tmp_path):
    """Changes of one key in many small files, in a random order, one file per batch."""
    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.randrange(3), rnd.choice(["create", "patch", "delete"]), f"b{i}", i, t0) for i in range(24)]
    mixed = rnd.sample(rows, len(rows))
    write_files(spark, tmp_path / "in", [mixed[i:i + 4] for i in range(0, 24, 4)])
    src = Fl.change_source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, max_files=1)
    out = Fl.merge_changes(src.select("k", "op", "body", "seq"), ["k"])
    want = {}
    for _, k, op, body, seq, _ in rows:                        # in change order
        alive, created, text, updated = want.get(k, (False, None, None, None))
        if op == "create":
            want[k] = (True, seq, body, seq)
        elif alive:
            want[k] = (True, created, body, seq) if op == "patch" else (False, created, text, seq)
    assert {r.k: (r.alive, r.created, r.body, r.updated) for r in out.collect()} == want


def test_unconfirmed_ids_stay(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    write_files(spark, tmp_path / "o", [[(1, 1, "", "", 1, t0), (2, 1, "", "", 2, t0 + dt.timedelta(hours=9)), (3, 2, "", "", 3, t0)]])
    write_files(spark, tmp_path / "c", [[(7, 1, "", "", 1, t0 + dt.timedelta(hours=1)), (8, 2, "", "", 1, t0 + dt.timedelta(hours=5))]])
    o, c = (Fl.change_source(spark, str(tmp_path / p), spark.createDataFrame([], SCHEMA).schema).select("k", F.col("id").alias(i), F.col("ts").alias(s))
            for p, i, s in (("o", "temp_id", "o_ts"), ("c", "server_id", "c_ts")))
    settled = Fl.run_to_table(Fl.reconcile(o, c, ["k"], "2 HOURS"))
    asked = spark.read.parquet(str(tmp_path / "o")).withColumnRenamed("id", "temp_id")
    got = sorted((r.temp_id, r.server_id) for r in Fl.with_pending(settled, asked, ["k"]).collect())
    assert got == [(1, 7), (2, None), (3, None)]


def test_repeated_changes_are_dropped(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "create", "a", 1, t0), (1, 1, "create", "a", 1, t0), (2, 1, "patch", "b", 2, t0)]
    write_files(spark, tmp_path / "in", [rows[:2], rows[1:]])
    src = Fl.change_source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, max_files=1)
    assert Fl.run_to_table(Fl.deduplicated(src, "id", "ts").select("id")).count() == 2


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def at(i, minutes):
        return (i, 1, "x", "b", i, t0 + dt.timedelta(minutes=minutes))
    write_files(spark, tmp_path / "in", [[at(1, 10), at(2, 20)], [at(3, 300)], [at(6, 301)], [at(4, 15), at(5, 290)]])
    src = Fl.change_source(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, max_files=1).withColumn("value", F.lit(1.0))
    out = Fl.run_to_table(Fl.windowed_counts(src, ["k"], "1 hour"))
    got = {r.window.start: r.n for r in out.collect()}
    # The row at minute 15 came hours late; Spark compares it with the watermark of the batch before.
    assert got[t0] == 2
