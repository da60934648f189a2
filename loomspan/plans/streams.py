"""Stream operators over the given tables: batch runs whose definitions SQL checks, and streams that really run.

The streams read a folder to which rows are added in arrivals. Each arrival is a run of its own that starts from the checkpoint
of the one before, so every query here restarts in its middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators import joins as J
from loomspan.plans.inventory import folder
from loomspan.plans.registry import query
from loomspan.plans.relational import SEQ
from loomspan.sources.tables import sequences, table
from loomspan.streaming import streams, tracks


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    return [rows.where(F.col(column) == k).drop(column) for k in range(n)]


@query("SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return streams.windowed(events(spark, d)).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT epoch(time_bucket(INTERVAL 30 minutes, ts) - to_minutes(30 * k::INTEGER))::BIGINT AS start, event_type, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding(spark, d):
    return streams.windowed(events(spark, d), "1 hour", "30 minutes").select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, k")
def stream_session(spark, d):
    return streams.sessions(events(spark, d)).select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark, d):
    e = events(spark, d)
    return streams.deduplicated(e.unionByName(e)).select("event_id", "event_type")


#: The month in four arrivals of eight days by time; of every seventh event the arrival is one later, of every 49th two, so it may be late.
ARRIVAL = "least(3, (date_diff('day', DATE '2024-01-01', ts::DATE) // 8) + CASE WHEN event_id % 49 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)"
#: Rows with the watermark of their arrival: the latest time of all arrivals before, less ten minutes, in milliseconds as Spark keeps it.
LATE = f"a AS (SELECT *, {ARRIVAL} AS arrival FROM events), m AS (SELECT k, max(epoch_ms(ts)) - 600000 AS mark FROM a, range(1, 5) r(k) WHERE arrival < k GROUP BY k), w AS (SELECT a.*, coalesce(m.mark, 0) AS mark FROM a LEFT JOIN m ON m.k = a.arrival)"


def arriving(spark, d, n: int = 4) -> list[DataFrame]:
    days = F.least(F.lit(3), F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 8) + F.when(F.col("event_id") % 49 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    return arrivals(events(spark, d).withColumn("arrival", days), "arrival", n)


@query(f"WITH {LATE}, g AS (SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE (epoch(time_bucket(INTERVAL 1 hour, ts)) + 3600) * 1000 > mark GROUP BY ALL) SELECT g.* FROM g JOIN m ON m.k = 4 WHERE (start + 3600) * 1000 <= mark")
def stream_late(spark, d):
    """Hourly counts of a stream whose watermark drops rows of windows that are closed; windows still open at the end are not given."""
    out = streams.replayed(arriving(spark, d), streams.windowed, folder(spark, "late"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {LATE} SELECT event_id, event_type, arrival::INT AS arrival FROM w WHERE epoch_ms(ts) > mark")
def stream_late_dedup(spark, d):
    """Every row comes twice in its arrival and once more in the next; late ones are dropped, of the others one is kept."""
    parts = [x.withColumn("arrival", F.lit(k)) for k, x in enumerate(arriving(spark, d))]
    sent = [x.unionByName(x) if k == 0 else x.unionByName(x).unionByName(parts[k - 1].where("event_id % 7 = 0")) for k, x in enumerate(parts)]
    out = streams.replayed(sent, lambda e: streams.deduplicated(e, late="10 minutes"), folder(spark, "dedup"))
    return out.select("event_id", "event_type", "arrival")


@query("SELECT event_id, event_type, value FROM events")
def stream_resume(spark, d):
    """A stream whose run fails after it has written its third batch and before that is committed: the next run writes the batch again, once."""
    return streams.replayed(arriving(spark, d), lambda e: e, folder(spark, "resume"), lambda n: n == 2).select("event_id", "event_type", "value")


def points(spark, d):
    """Two events of a recording are a frame of two points."""
    s = sequences(spark, d)
    return s.select("id", F.expr("pos div 2").alias("pos"), (F.col("pos") % 2).alias("k"), (F.col("value") % 10).alias("x"), F.col("label").cast("double").alias("y"), F.col("ts").cast("timestamp").alias("ts"))


REACH, STALE = 4.0, 12 * 3600.0
TRACKS = f"""RECURSIVE {SEQ}, e AS (SELECT id, pos // 2 AS pos, pos % 2 AS k, value % 10 AS x, label::DOUBLE AS y, epoch_us(ts) / 1e6 AS at FROM s),
f AS (SELECT a.id, a.pos, a.x AS x0, a.y AS y0, a.at AS at0, b.x AS x1, b.y AS y1, coalesce(b.at, a.at) AS at1 FROM e a LEFT JOIN e b ON b.id = a.id AND b.pos = a.pos AND b.k = 1 WHERE a.k = 0),
t AS (SELECT id, -1::BIGINT AS pos, 0::BIGINT AS fresh, 0e0 AS at, []::STRUCT(t BIGINT, x DOUBLE, y DOUBLE)[] AS now, NULL::BIGINT AS t0, NULL::BIGINT AS t1 FROM (SELECT DISTINCT id FROM f)
  UNION ALL
  SELECT id, pos, fresh + (b1 IS NULL AND x1 IS NOT NULL)::INT, at1, CASE WHEN x1 IS NULL THEN [{{'t': t0, 'x': x0, 'y': y0}}] WHEN {{split}} THEN [{{'t': coalesce(b1, fresh), 'x': x1, 'y': y1}}] ELSE [{{'t': t0, 'x': x0, 'y': y0}}, {{'t': coalesce(b1, fresh), 'x': x1, 'y': y1}}] END, t0, CASE WHEN x1 IS NOT NULL THEN coalesce(b1, fresh) END
  FROM (SELECT *, list_sort(list_filter(list_transform(CASE WHEN {{split}} THEN [] ELSE free END, lambda u: {{'d': (u.x - x1) * (u.x - x1) + (u.y - y1) * (u.y - y1), 't': u.t}}), lambda u: u.d <= 16 AND u.t <> t0))[1].t AS b1
        FROM (SELECT * EXCLUDE (fresh), coalesce(b0, fresh) AS t0, fresh + (b0 IS NULL)::INT AS fresh
              FROM (SELECT *, list_sort(list_filter(list_transform(free, lambda u: {{'d': (u.x - x0) * (u.x - x0) + (u.y - y0) * (u.y - y0), 't': u.t}}), lambda u: u.d <= 16))[1].t AS b0
                    FROM (SELECT f.*, t.fresh, CASE WHEN {{stale}} THEN [] ELSE t.now END AS free FROM t JOIN f ON f.id = t.id AND f.pos = t.pos + 1)))))
SELECT id, pos, 0::BIGINT AS k, t0 AS track FROM t WHERE pos >= 0 UNION ALL SELECT id, pos, 1, t1 FROM t WHERE t1 IS NOT NULL"""


@query("WITH " + TRACKS.replace("{stale}", "false").replace("{split}", "false"))
def join_greedy_tracking(spark, d):
    return J.track(points(spark, d), REACH)


@query("WITH " + TRACKS.replace("{stale}", f"at0 - t.at > {STALE}").replace("{split}", f"at1 - at0 > {STALE}"))
def stream_tracks(spark, d):
    """Tracks of a stream of points in three arrivals by time, each a run from the checkpoint of the one before; tracks end after twelve hours without a point."""
    part = F.least(F.lit(2), F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 11))
    return streams.replayed(arrivals(points(spark, d).withColumn("arrival", part), "arrival", 3), lambda p: tracks.tracked(p, REACH, STALE), folder(spark, "tracks")).select("id", "pos", "k", "track")
