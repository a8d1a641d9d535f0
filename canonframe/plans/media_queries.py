"""Timed media over the event table: intervals, as-of lookups, scores, alignment state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M, space as S
from .registry import query
from .views import epoch_micros

HOUR = 3_600_000_000
_EV = "ev AS MATERIALIZED (SELECT *, epoch_us(ts) AS us FROM events)"


def chapters_of(events):
    """One file per user and day; the event value is the score."""
    return events.select("user_id", "ts", F.expr(f"us div {24 * HOUR}").alias("file_no"), F.col("us").alias("seq"), "event_id", "event_type",
                    F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
                    (F.col("value") % 37 + 1).alias("rate"), (F.col("event_type") == "error").alias("ran_out"))


def _chapters(t):
    return chapters_of(t.events_us).drop("ts")


@query("jn17_asof_lookup", f"WITH {_EV} SELECT p.event_id, coalesce(v.event_id, -1) AS interval_id FROM (SELECT * FROM ev WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.us <= p.us")
def asof_lookup(t):
    e = t.events_us
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    intervals = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("interval_id"))
    return S.asof_join(probes, intervals, "us", "us", "interval_id", ["user_id"], 24 * HOUR, "interval_id").select(
        "event_id", "interval_id").fillna(-1, ["interval_id"])


@query("jn15_derived_key_join", f"""WITH {_EV}, f AS (SELECT user_id, us // 86400000000 AS day, min(us) AS file_start, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT e.event_id, f.day, f.n, (e.us - f.file_start) // 1000 AS start_ms FROM ev e JOIN f ON f.user_id = e.user_id AND f.day = e.us // 86400000000""")
def derived_key_join(t):
    e = t.events_us.withColumn("day", F.expr(f"us div {24 * HOUR}"))
    files = e.groupBy("user_id", "day").agg(F.min("us").alias("file_start"), F.count(F.lit(1)).alias("n"))
    return e.join(files, ["user_id", "day"]).select("event_id", "day", "n", F.expr("(us - file_start) div 1000").alias("start_ms"))


@query("src17_interval_ends", f"WITH {_EV} SELECT event_id, user_id, coalesce((lead(us) OVER (PARTITION BY user_id ORDER BY us) - us) // 1000, -1) AS duration_ms FROM ev")
def interval_ends(t):
    """Each timed unit lasts until the next one of its edition."""
    e = t.events_us.select("event_id", "user_id", "us")
    out = M.successor(e, "us", F.expr(f"us div {24 * HOUR}"), ["user_id"], "next_us")
    return out.select("event_id", "user_id", F.coalesce(F.expr("(next_us - us) div 1000"), F.lit(-1)).alias("duration_ms"))


@query("jn25_edition_choice", """
    WITH c AS (SELECT DISTINCT user_id, event_type FROM events), o AS (SELECT unnest(['purchase', 'signup', 'click', 'view', 'error']) AS event_type, unnest(range(5)) AS n)
    SELECT c.user_id, arg_min(c.event_type, o.n) AS edition FROM c JOIN o ON o.event_type = c.event_type WHERE c.event_type <> 'error' GROUP BY 1""")
def media_edition_choice(t):
    order = F.array(*[F.lit(x) for x in ["purchase", "signup", "click", "view", "error"]])
    have = t.events.where("event_type <> 'error'").select("user_id", "event_type").distinct()
    return have.groupBy("user_id").agg(F.min_by("event_type", F.array_position(order, F.col("event_type"))).alias("edition"))


@query("jn29_first_timed_unit", f"""WITH {_EV} SELECT user_id, coalesce(max(event_id) FILTER (event_id = requested AND event_type = 'view'), arg_min(event_id, us) FILTER (event_type = 'view'), -1) AS start_unit
    FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS requested FROM ev) GROUP BY user_id""")
def first_timed_unit(t):
    """The requested unit when it has a timing, else the first listed one that has."""
    e = t.events_us
    asked = e.groupBy("user_id").agg(F.max("event_id").alias("requested"))
    timed = e.where("event_type = 'view'").select("user_id", "event_id", "us")
    j = asked.join(timed, "user_id", "left")
    return j.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_id") == F.col("requested"), F.col("event_id"))),
                                               F.min_by("event_id", "us"), F.lit(-1).cast("bigint")).alias("start_unit"))


@query("ag28_chapter_scores", f"""WITH {_EV} SELECT user_id, us // 86400000000 AS chapter, round(avg(value), 4) AS mean_score, round(min(value), 4) AS min_score,
    round(sum(length(props)) / greatest((max(us // 1000) - min(us // 1000)) / 1000.0, 0.001)::DOUBLE, 2) AS rate FROM ev GROUP BY 1, 2""")
def chapter_scores(t):
    v = t.events_us.select("user_id", F.expr(f"us div {24 * HOUR}").alias("chapter"), F.col("value").alias("score"),
                           F.length("props").alias("n_chars"), F.expr("us div 1000").alias("start_ms"), F.expr("us div 1000").alias("end_ms"))
    return M.chapter_scores(v, ["user_id", "chapter"])


@query("ag29_score_census", f"""WITH {_EV}, c AS (SELECT user_id, us // 86400000000 AS chapter, round(avg(value), 4) AS m FROM ev GROUP BY 1, 2)
    SELECT user_id, count(*) FILTER (m >= 40) AS kept, count(*) FILTER (m < 40) AS dropped FROM c GROUP BY 1""")
def score_census(t):
    return M.score_census(chapter_scores(t), "user_id", 40)


@query("ag30_media_coverage", f"WITH {_EV} SELECT event_type, count(DISTINCT (user_id, us // 86400000000)) AS chapters, count(*) AS verses FROM ev GROUP BY 1")
def media_coverage(t):
    cells = t.events_us.groupBy("event_type", "user_id", F.expr(f"us div {24 * HOUR}").alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("event_type").agg(F.count(F.lit(1)).alias("chapters"), F.sum("_n").alias("verses"))


@query("gr12_passage_media", f"""WITH {_EV}, c AS (SELECT user_id, us // 86400000000 AS day, event_type, count(*) AS n, min(us) AS s, max(us) AS e FROM ev GROUP BY 1, 2, 3)
    SELECT user_id, day, string_agg(event_type || ':' || n || ':' || (e - s) // 1000, '|' ORDER BY event_type) AS by_edition FROM c GROUP BY 1, 2""")
def passage_media(t):
    from ..operators.timeline import ordered_list
    c = t.events_us.groupBy("user_id", F.expr(f"us div {24 * HOUR}").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("s"), F.max("us").alias("e"))
    entry = [F.col("event_type"), F.lit(":"), F.col("n").cast("string"), F.lit(":"), F.expr("CAST((e - s) div 1000 AS STRING)")]
    return c.groupBy("user_id", "day").agg(ordered_list(entry, [F.col("event_type")]).alias("by_edition"))


@query("wn09_before_drift", f"""WITH {_EV}, x AS (SELECT event_id, user_id, us // 86400000000 AS f, us, least(value / 100, 1.0) AS score, lead(least(value / 100, 1.0)) OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us) AS nxt FROM ev),
    d AS (SELECT user_id, f, min(us) FILTER (score < 0.5 AND (nxt IS NULL OR nxt < 0.5)) AS drift FROM x GROUP BY 1, 2)
    SELECT x.event_id, x.user_id FROM x JOIN d ON d.user_id = x.user_id AND d.f = x.f WHERE d.drift IS NULL OR x.us < d.drift""")
def before_drift(t):
    return M.before_drift(_chapters(t), ["user_id", "file_no"], "seq", "score", 0.5).select("event_id", "user_id")


_CHAPTERS = f"""{_EV}, c AS (SELECT user_id, us // 86400000000 AS file_no, us, least(value / 100, 1.0) AS score, value % 37 + 1 AS rate, event_type = 'error' AS ran_out FROM ev),
    m AS (SELECT *, NOT ran_out AND score < 0.5 AND coalesce(lead(score) OVER (PARTITION BY user_id, file_no ORDER BY us) >= 0.7, false) AS skipped FROM c),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n, NOT ran_out AND NOT skipped AND score > 0.5 AND rate > 3 AND rate < 40 AS sane FROM m),
    r AS (SELECT user_id, n, CASE WHEN sane THEN 0.6 * 13.0::DOUBLE + 0.4 * rate ELSE 13.0::DOUBLE END AS now FROM k WHERE n = 1
          UNION ALL SELECT k.user_id, k.n, CASE WHEN k.sane THEN 0.6 * r.now + 0.4 * k.rate ELSE r.now END FROM r JOIN k ON k.user_id = r.user_id AND k.n = r.n + 1),
    f AS (SELECT k.user_id, k.file_no, arg_max(r.now, k.n) AS rate_out, count(*) FILTER (NOT ran_out AND NOT skipped) AS done, count(*) FILTER (skipped) AS missing,
          count(*) FILTER (ran_out) AS carried_out FROM k JOIN r ON r.user_id = k.user_id AND r.n = k.n GROUP BY 1, 2),
    s AS (SELECT user_id, file_no, round(coalesce(lag(rate_out) OVER o, 13.0), 6) AS rate_in, round(rate_out, 6) AS rate_out, done, missing,
          coalesce(lag(carried_out) OVER o, 0) AS carried_in, carried_out FROM f WINDOW o AS (PARTITION BY user_id ORDER BY file_no))"""


@query("sm04_alignment_state", f"WITH RECURSIVE {_CHAPTERS} SELECT * FROM s")
def alignment_state(t):
    out = M.alignment_state(_chapters(t), "user_id", "file_no", "seq", 13.0)
    return out.withColumn("rate_in", F.round("rate_in", 6)).withColumn("rate_out", F.round("rate_out", 6))
