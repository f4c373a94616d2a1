"""Queries over the event stream and the derived runs: joins over time, windows, sketches, grouping sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changelens import labels as L
from changelens.operators import rollups, temporal
from changelens.plans import derived as D
from changelens.plans.derived import runs, table
from changelens.plans.label_queries import _EXACT
from changelens.plans.session import checkpoint_dir
from changelens.streaming import windows

HOUR = 3_600_000_000
LEVEL_OF = {t: level for level, types in L.LEVELS.items() for t in types}


def error_before_purchase(spark, d):
    """Every purchase with the latest error of the same user before it."""
    events = table(spark, d, "events")
    errors = events.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("error_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.as_of(bought, errors, ["user_id"], "ts").select("event_id", "user_id", F.col("match.error_id").alias("error_id"))


def events_near_errors(spark, d):
    """Events of a user in the hours after one of their errors; the hours differ from error to error."""
    events = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    hours = F.when(F.col("event_id") % 50 == 0, 24 * 20).otherwise(1 + F.col("event_id") % 7)
    spans = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("from"), (F.col("at") + hours * HOUR).alias("to"))
    points = events.where("event_type <> 'error'").select("user_id", "event_id", "at")
    found = temporal.in_intervals(points, spans, ["user_id"], "at", "from", "to", HOUR)
    return found.groupBy("error_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.sum("event_id").alias("sum_ids"))


def _windowed(spark, d, window, mode):
    events = table(spark, d, "events")
    stream = windows.read_stream(spark, f"{d}/events.parquet", events.schema, lambda s: s.withColumn("ts", F.col("ts").cast("timestamp")))
    out = windows.windowed(stream, "ts", "event_type", window, "1 hour", F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    run = f"{checkpoint_dir(spark).rstrip('/')}/windows/{uuid.uuid4().hex}"
    windows.run_to_table(out, f"{run}/table", f"{run}/state", mode)
    return spark.read.parquet(f"{run}/table").select(
        "event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "cents")


def tumbling_windows(spark, d):
    return _windowed(spark, d, windows.tumbling("ts", "6 hours"), "complete")


def sliding_windows(spark, d):
    return _windowed(spark, d, windows.sliding("ts", "6 hours", "2 hours"), "complete")


def session_windows(spark, d):
    return _windowed(spark, d, windows.session("ts", "20 minutes"), "complete")


def sketched_events(spark, d):
    """Distinct users and value quantiles by event type, from sketches of every day merged; beside them whether they are inside the bounds."""
    events = table(spark, d, "events")
    parts = rollups.sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value")
    guess = rollups.estimates(rollups.merged(parts, "event_type"), 0.5, 0.9)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))
    rank = lambda q: F.sum((F.col("value") <= F.col(q)).cast("bigint"))
    ranks = events.join(guess.select("event_type", "q50", "q90"), "event_type").groupBy("event_type").agg(rank("q50").alias("r50"), rank("q90").alias("r90"))
    near = lambda r, q: F.abs(F.col(r) / F.col("n") - q) <= rollups.RANK_ERROR + 1 / F.col("n")
    return guess.join(exact, "event_type").join(ranks, "event_type").select(
        "event_type", "n", "n_users", (F.abs(F.col("n_distinct") - F.col("n_users")) <= rollups.COUNT_ERROR * F.col("n_users") + 1).alias("count_inside"),
        near("r50", 0.5).alias("median_inside"), near("r90", 0.9).alias("q90_inside"))


def score_cube(spark, d):
    """Counters by track, level and type in five groupings at once."""
    out = rollups.score_cube(runs(spark, d), "predicted", "truth", LEVEL_OF)
    return out.select("grouping", "track", "level", "type", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


QUERIES = {f.__name__: f for f in (
    error_before_purchase, events_near_errors, tumbling_windows, sliding_windows, session_windows, sketched_events, score_cube)}

# Oracle side

_US = "epoch_us(ts)"
_CENTS = "sum(round(value * 100)::BIGINT)::BIGINT AS cents"
_LEVELS = ", ".join(f"('{t}', '{level}')" for t, level in LEVEL_OF.items())


def _bucket_sql(size: int, step: int) -> str:
    return f"""SELECT event_type, s AS start_us, s + {size * HOUR} AS end_us, count(*) AS n, {_CENTS}
FROM (SELECT *, ({_US} // {step * HOUR} - k) * {step * HOUR} AS s FROM events, (SELECT unnest(range({size // step})) AS k)) GROUP BY 1, 2"""


ORACLE = {
    "error_before_purchase": """
WITH e AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, e.error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts""",
    "events_near_errors": f"""
WITH e AS (SELECT *, {_US} AS us FROM events),
s AS (SELECT user_id, event_id AS error_id, us AS f, us + CASE WHEN event_id % 50 = 0 THEN 480 ELSE 1 + event_id % 7 END * {HOUR} AS t FROM e WHERE event_type = 'error')
SELECT error_id, count(*) AS n, min(event_id) AS first_id, sum(event_id)::BIGINT AS sum_ids FROM s JOIN e ON s.user_id = e.user_id AND e.us >= f AND e.us < t WHERE event_type <> 'error' GROUP BY 1""",
    "tumbling_windows": _bucket_sql(6, 6),
    "sliding_windows": _bucket_sql(6, 2),
    "session_windows": f"""
WITH e AS (SELECT *, {_US} AS us, lag({_US}) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us > prev + {HOUR // 3} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts) AS no FROM e)
SELECT event_type, min(us) AS start_us, max(us) + {HOUR // 3} AS end_us, count(*) AS n, {_CENTS} FROM s GROUP BY event_type, no""",
    "sketched_events": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS count_inside, true AS median_inside, true AS q90_inside FROM events GROUP BY 1",
    "score_cube": f"""WITH {D.DUCK_RUNS},
p AS (SELECT DISTINCT case_id, track, unnest(predicted) AS type FROM runs), g AS (SELECT DISTINCT case_id, track, unnest(truth) AS type FROM runs),
px AS (SELECT * FROM p WHERE type IN ({_EXACT})), gx AS (SELECT * FROM g WHERE type IN ({_EXACT})),
c AS (SELECT coalesce(px.track, gx.track) AS track, coalesce(px.type, gx.type) AS type, px.type IS NOT NULL AS a, gx.type IS NOT NULL AS b
      FROM px FULL JOIN gx ON px.case_id = gx.case_id AND px.track = gx.track AND px.type = gx.type),
v(type, level) AS (VALUES {_LEVELS}),
l AS (SELECT c.*, coalesce(v.level, '') AS level FROM c LEFT JOIN v ON v.type = c.type),
s AS (SELECT grouping(track, level, type) AS grouping, track, level, type, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn
      FROM l GROUP BY GROUPING SETS ((track, level, type), (track, level), (track), (level), ()))
SELECT grouping, track, level, type, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM s""",
}
