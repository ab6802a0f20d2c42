"""Window computations over trips and stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import relational, resolve, timetable
from tramline.plans.registry import query

POS = "SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq, stop_id, platform) AS pos FROM calls"
HOP = f"SELECT p.*, s.lat, s.lng, {geo.distance_sql('lag(s.lat) OVER w', 'lag(s.lng) OVER w', 's.lat', 's.lng')} AS metres FROM p LEFT JOIN stops s ON s.id = p.stop_id WINDOW w AS (PARTITION BY p.trip_id ORDER BY p.pos)"


@query("SELECT trip_id, seq, stop_id, platform FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, seq ORDER BY stop_id, platform) AS n FROM calls) WHERE n = 1")
def win_distinct_on(v):
    return relational.distinct_on(v.calls, ["trip_id", "seq"], [F.col("stop_id"), F.col("platform")]).select("trip_id", "seq", "stop_id", "platform")


@query("SELECT trip_id, stop_id, seq, departs, time_source FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_id, seq ORDER BY (CASE WHEN departs IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN time_source = 'SCRAPED' THEN 1 ELSE 0 END) DESC, platform, departs NULLS LAST, time_source) AS n FROM calls) WHERE n = 1")
def win_dedupe_preferred(v):
    return timetable.prefer(v.calls).select("trip_id", "stop_id", "seq", "departs", "time_source")


@query("WITH b AS (SELECT stop_id, count(*) AS n FROM calls GROUP BY stop_id) SELECT name, id AS survivor FROM (SELECT s.name, s.id, row_number() OVER (PARTITION BY s.name ORDER BY coalesce(b.n, 0) DESC, (s.state IS NOT NULL) DESC, s.id) AS k FROM stops s LEFT JOIN b ON b.stop_id = s.id) WHERE k = 1")
def win_survivor_order(v):
    busy = v.calls.groupBy(F.col("stop_id").alias("id")).agg(F.count("*").alias("n"))
    s = v.stops.join(busy, "id", "left")
    return s.groupBy("name").agg(F.min_by("id", F.struct(-F.coalesce("n", F.lit(0)), F.col("state").isNull(), "id")).alias("survivor"))


@query(f"WITH p AS ({POS}), h AS ({HOP}) SELECT trip_id, pos, CAST(floor(metres + 0.5) AS BIGINT) AS metres FROM h")
def win_lag_hop(v):
    return timetable.hop_metres(v.calls, v.stops).select("trip_id", F.col("pos").cast("bigint").alias("pos"), F.floor(F.col("metres") + 0.5).cast("bigint").alias("metres"))


@query(f"WITH p AS ({POS}), h AS ({HOP}) SELECT trip_id, pos, CAST(floor(sum(coalesce(metres, 0)) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / 10 + 0.5) AS BIGINT) AS dam FROM h")
def win_cumulative_distance(v):
    return timetable.cumulative(v.calls, v.stops).select("trip_id", F.col("pos").cast("bigint").alias("pos"), F.floor(F.col("total") / 10 + 0.5).cast("bigint").alias("dam"))


@query(f"WITH p AS ({POS}), t AS (SELECT *, CASE WHEN departs IS NOT NULL THEN minute END AS timed FROM p) SELECT trip_id, pos, last_value(timed IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS before, first_value(timed IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM t")
def win_prev_next_anchor(v):
    return timetable.anchors(v.calls).select("trip_id", F.col("pos").cast("bigint").alias("pos"), "before", "after")


@query(f"""WITH p AS ({POS}), h AS ({HOP}),
c AS (SELECT *, CASE WHEN departs IS NOT NULL THEN minute END AS timed, sum(coalesce(metres, 0)) OVER u AS total, sum((metres IS NULL)::INT) OVER u AS holes FROM h WINDOW u AS (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, last_value(timed IGNORE NULLS) OVER b AS t0, first_value(timed IGNORE NULLS) OVER f AS t1, last_value(CASE WHEN timed IS NOT NULL THEN total END IGNORE NULLS) OVER b AS d0, first_value(CASE WHEN timed IS NOT NULL THEN total END IGNORE NULLS) OVER f AS d1,
 last_value(CASE WHEN timed IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN timed IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, last_value(CASE WHEN timed IS NOT NULL THEN holes END IGNORE NULLS) OVER b AS h0, first_value(CASE WHEN timed IS NOT NULL THEN holes END IGNORE NULLS) OVER f AS h1
 FROM c WINDOW b AS (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, CASE WHEN t1 < t0 THEN t1 - t0 + 1440 ELSE t1 - t0 END AS span, CASE WHEN d1 - d0 > 0 THEN (total - d0) / (d1 - d0) ELSE (pos - p0) / (p1 - p0) END AS share FROM a),
m AS (SELECT *, timed IS NULL AND span > 0 AND h0 = h1 AS ok, CASE WHEN timed IS NULL AND span > 0 AND h0 = h1 THEN CAST(floor(t0 + span * share + 0.5) AS BIGINT) % 1440 END AS mm FROM s)
SELECT trip_id, pos, stop_id, CASE WHEN ok THEN lpad(CAST(mm // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(mm % 60 AS VARCHAR), 2, '0') ELSE departs END AS departs, CASE WHEN ok THEN 'INTERPOLATED' WHEN departs IS NOT NULL THEN time_source END AS time_source FROM m""")
def win_interpolate(v):
    return timetable.interpolate(v.calls, v.stops).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT trip_id, seq, stop_id, minute FROM (SELECT *, max(minute) OVER (PARTITION BY trip_id ORDER BY seq, stop_id, platform ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM calls) WHERE top IS NULL OR minute >= top")
def win_monotonic_filter(v):
    return timetable.monotonic(v.calls).select("trip_id", "seq", "stop_id", "minute")


@query(f"SELECT trip_id, seq, stop_id, pos FROM ({POS})")
def win_dense_resequence(v):
    return timetable.resequence(v.calls).select("trip_id", "seq", "stop_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT trip_id, CAST(coalesce(sum((timed < last)::INT), 0) AS BIGINT) AS backwards FROM (SELECT trip_id, timed, last_value(timed IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY seq, stop_id, platform ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM (SELECT *, CASE WHEN departs IS NOT NULL THEN minute END AS timed FROM calls)) GROUP BY trip_id")
def win_forward_check(v):
    return timetable.backwards(v.calls)


@query("SELECT provider, arg_max(content_hash, (size, id)) AS content_hash FROM raw_records GROUP BY provider")
def win_latest_per_key(v):
    return v.raw_records.groupBy("provider").agg(F.max_by("content_hash", F.struct("size", "id")).alias("content_hash"))


@query("SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM stops) WHERE n <= 3")
def win_top_places(v):
    return resolve.top_places(v.stops).select("name", "id")
