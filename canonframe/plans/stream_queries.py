"""Change flows run as streams over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import space as S
from ..session import cut_lineage
from ..streaming import alignment as Al, flows as Fl, sessions as Ss
from .media_queries import _CHAPTERS, chapters_of
from .registry import query
from .views import epoch_micros


def _events(t):
    """The event table as a stream; its schema is the table's."""
    src = Fl.change_source(t.spark, f"{t.dir}/event[s].parquet", t.events.schema)
    return src.withColumn("us", epoch_micros("ts")).withColumn("ts", F.timestamp_micros("us"))


#: Where the watermark stands after all events, in microseconds: whole milliseconds, one hour back.
_PASSED = "wm AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS passed FROM events)"


def _op(col="event_type"):
    return F.when(F.col(col) == "view", "create").when(F.col(col) == "click", "patch").when(F.col(col) == "error", "delete")


_CH = """ch AS MATERIALIZED (SELECT user_id, CAST(floor(value) AS BIGINT) AS item, CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'patch' WHEN 'error' THEN 'delete' END AS op, props AS body,
    event_id AS seq FROM events WHERE event_type IN ('view', 'click', 'error'))"""
_FINAL = f"""{_CH}, c AS (SELECT user_id, item, max(seq) AS seq, arg_max(body, seq) AS body FROM ch WHERE op = 'create' GROUP BY 1, 2),
    d AS (SELECT c.user_id, c.item, min(ch.seq) AS seq FROM c JOIN ch ON ch.user_id = c.user_id AND ch.item = c.item AND ch.op = 'delete' AND ch.seq > c.seq GROUP BY 1, 2),
    p AS (SELECT c.user_id, c.item, max(ch.seq) AS seq, arg_max(ch.body, ch.seq) AS body FROM c JOIN ch ON ch.user_id = c.user_id AND ch.item = c.item AND ch.op = 'patch' AND ch.seq > c.seq
          LEFT JOIN d ON d.user_id = c.user_id AND d.item = c.item WHERE d.seq IS NULL OR ch.seq < d.seq GROUP BY 1, 2)
    SELECT c.user_id, c.item, d.seq IS NULL AS alive, coalesce(p.body, c.body) AS body, c.seq AS created, coalesce(d.seq, p.seq, c.seq) AS updated
    FROM c LEFT JOIN d ON d.user_id = c.user_id AND d.item = c.item LEFT JOIN p ON p.user_id = c.user_id AND p.item = c.item"""


def _changes(e):
    return e.where(_op().isNotNull()).select("user_id", F.floor("value").alias("item"), _op().alias("op"), F.col("props").alias("body"),
                                             F.col("event_id").alias("seq"), *(["ts"] if "ts" in e.columns else []))


@query("sm01_latest_state", f"WITH {_FINAL}")
def latest_state(t):
    changes = Fl.deduplicated(_changes(_events(t)), "seq", "ts").drop("ts")
    return Fl.merge_changes(changes, ["user_id", "item"])


@query("sm01_batch_twin", f"WITH {_FINAL}")
def batch_twin(t):
    return Fl.final_states(_changes(t.events.drop("ts")), ["user_id", "item"])


@query("prj19_live_annotations", f"WITH x AS (WITH {_FINAL}) SELECT user_id, count(*) AS n_live FROM x WHERE alive GROUP BY 1")
def live_annotations(t):
    rows = Fl.final_states(_changes(t.events.drop("ts")), ["user_id", "item"])
    from ..operators.annotations import live
    kept = live(rows.withColumn("deleted_at", F.when(~F.col("alive"), F.col("updated"))))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_live"))


@query("sm02_change_fan_out", """WITH c AS (SELECT e.event_id, CASE WHEN e.event_type = 'error' THEN 'remove' ELSE 'upsert' END AS message, a.pos AS p, CAST(floor(e.value) AS BIGINT) % 9 AS w, (SELECT count(*) FROM space) AS n
      FROM events e JOIN space a ON a.pos = e.event_id % (SELECT count(*) FROM space) WHERE e.event_type IN ('view', 'click', 'error'))
    SELECT event_id, message, s.addr FROM (SELECT event_id, message, unnest(range(p, least(p + w, n - 1) + 1)) AS q FROM c) x JOIN space s ON s.pos = x.q""", ("space",))
def change_fan_out(t):
    space = cut_lineage(t.space.select("addr", "pos"))
    n = space.count()      # one number
    e = _events(t).where(_op().isNotNull()).withColumn("_p", F.col("event_id") % n).withColumn("_q", F.least(F.col("_p") + F.floor("value") % 9, F.lit(n - 1)))
    ch = (e.join(space.select(F.col("pos").alias("_p"), F.col("addr").alias("start_addr")), "_p")
          .join(space.select(F.col("pos").alias("_q"), F.col("addr").alias("end_addr")), "_q")
          .select("event_id", _op().alias("op"), "start_addr", "end_addr"))
    return Fl.run_to_table(Fl.fan_out_changes(ch, space).select("event_id", "message", "addr"))


@query("sm03_id_reconcile", """SELECT o.user_id, o.event_id AS temp_id, c.event_id AS server_id FROM events o LEFT JOIN events c ON c.user_id = o.user_id AND c.event_type = 'purchase'
    AND c.ts >= o.ts AND c.ts <= o.ts + INTERVAL 2 HOUR WHERE o.event_type = 'view'""")
def id_reconcile(t):
    o = _events(t).where("event_type = 'view'").select("user_id", F.col("event_id").alias("temp_id"), F.col("ts").alias("o_ts"))
    c = _events(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("server_id"), F.col("ts").alias("c_ts"))
    settled = Fl.run_to_table(Fl.reconcile(o, c, ["user_id"], "2 HOURS"))
    asked = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("temp_id"))
    return Fl.with_pending(settled, asked, ["user_id"])


@query("sm05_reading_progress", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM e)
    SELECT user_id, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, round(sum(least(value, 60.0)), 2) AS active_seconds FROM s GROUP BY user_id, sid""")
def reading_progress(t):
    e = _events(t).select("user_id", "ts", F.col("value").alias("seconds"))
    out = Fl.run_to_table(Fl.reading_sessions(e, ["user_id"]), "complete", Fl.latest_batch)
    return out.select("user_id", "n_events", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
                      F.round("active_seconds", 2).alias("active_seconds"))


@query("sm06_tumbling_counts", "SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    out = Fl.run_to_table(Fl.windowed_counts(_events(t), ["event_type"], "1 hour"), "complete", Fl.latest_batch)
    return out.select(F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "event_type", "n", "total")


@query("sm06_sliding_counts", "SELECT epoch_us(ts) // 1800000000 - k AS half_hour, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def sliding_counts(t):
    out = Fl.run_to_table(Fl.windowed_counts(_events(t), ["event_type"], "1 hour", "30 minutes"), "complete", Fl.latest_batch)
    return out.select(F.expr("unix_micros(window.start) div 1800000000").alias("half_hour"), "event_type", "n")


@query("sm06_closed_windows", f"""WITH {_PASSED} SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, wm
    WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= passed GROUP BY 1, 2""")
def closed_windows(t):
    """Append mode: a window is written once, when the watermark closes it, and leaves the state."""
    out = Fl.run_to_table(Fl.windowed_counts(_events(t), ["event_type"], "1 hour"))
    return out.select(F.expr("unix_micros(window.start) div 3600000000").alias("hour"), "event_type", "n", "total")


GAP_US = 6 * 3_600_000_000
_SESSIONS = f"""{_PASSED}, e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS done FROM events, wm WHERE epoch_us(ts) <= passed),
    p AS (SELECT *, us - lag(us) OVER o AS since, lag(done) OVER o AS after_done FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
    b AS (SELECT *, since IS NULL OR since >= {GAP_US} OR after_done AS begins FROM p),
    n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b),
    s AS (SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events, sum(CASE WHEN begins THEN 0 ELSE least(since, 60000000) END)::BIGINT AS active_us,
          CASE WHEN bool_or(done) THEN 'completed' WHEN max(us) + {GAP_US} <= (SELECT passed FROM wm) THEN 'expired' ELSE 'open' END AS ended FROM n GROUP BY user_id, session)"""


@query("sm05_completed_sessions", f"WITH {_SESSIONS} SELECT * FROM s WHERE ended <> 'open'")
def completed_sessions(t):
    """A purchase completes a session, six quiet hours end it; intervals count for a minute at most."""
    e = _events(t).select("user_id", "ts", "event_id", "event_type")
    return Fl.run_to_table(Ss.completed_sessions(e, ["user_id"], F.col("event_type") == "purchase", GAP_US), timers=True)


def _passed(t):
    return t.events.agg(((F.expr("max(unix_micros(CAST(ts AS TIMESTAMP))) div 1000") - 3_600_000) * 1000).alias("p")).head()["p"]     # one number


@query("sm05_sessions_twin", f"WITH {_SESSIONS} SELECT * FROM s")
def sessions_twin(t):
    return Ss.sessions_of(t.events, ["user_id"], F.col("event_type") == "purchase", GAP_US, passed_us=_passed(t))


@query("sm05_progress", f"""WITH {_SESSIONS} SELECT user_id, min(first_us) AS first_us, max(last_us) AS last_us, count(*) AS n_sessions, count(*) FILTER (ended = 'completed') AS n_completed,
    sum(n_events)::BIGINT AS n_events, sum(active_us)::BIGINT AS active_us FROM s GROUP BY 1""")
def reading_totals(t):
    return Ss.progress(sessions_twin(t), ["user_id"])


@query("sm04_alignment_stream", f"WITH RECURSIVE {_PASSED}, {_CHAPTERS} SELECT s.*, 0::BIGINT AS n_late FROM s, wm WHERE (file_no + 1) * 86400000000 <= passed")
def alignment_stream(t):
    """A file is over at the end of its day; rates and left-over chapters go on to the next file in keyed state."""
    chapters = chapters_of(_events(t)).withColumn("ends_us", F.expr("(file_no + 1) * 86400000000"))
    out = Fl.run_to_table(Al.alignment_stream(chapters, "user_id", "ends_us", 13.0), timers=True)
    return out.withColumn("rate_in", F.round("rate_in", 6)).withColumn("rate_out", F.round("rate_out", 6))
