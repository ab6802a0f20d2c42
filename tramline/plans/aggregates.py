"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import lifecycle, outlines, relational, spatial
from tramline.operators.polygons import MICRO
from tramline.plans.registry import query


@query("SELECT provider, state, count(*) AS n FROM stops GROUP BY ALL")
def agg_count_group(v):
    return v.stops.groupBy("provider", "state").agg(F.count("*").alias("n"))


@query("SELECT provider, count(*) AS total, count(CASE WHEN lat IS NOT NULL THEN 1 END) AS located, CAST(floor(count(lat) * 10000 / count(*)) AS BIGINT) AS per_10000 FROM stops GROUP BY provider")
def agg_count_conditional(v):
    return v.stops.groupBy("provider").agg(F.count("*").alias("total"), F.count(F.when(F.col("lat").isNotNull(), 1)).alias("located"), F.floor(F.count("lat") * 10000 / F.count("*")).cast("bigint").alias("per_10000"))


@query("SELECT direction, count(*) FILTER (WHERE vehicle LIKE '1%') AS urgent, count(*) FILTER (WHERE vehicle LIKE '5%') AS low FROM trips GROUP BY direction")
def agg_count_filter(v):
    return v.trips.groupBy("direction").agg(F.count_if(F.col("vehicle").startswith("1")).alias("urgent"), F.count_if(F.col("vehicle").startswith("5")).alias("low"))


@query("SELECT r.state, count(DISTINCT r.id) AS routes, count(DISTINCT t.id) AS trips FROM routes r LEFT JOIN trips t ON t.route_id = r.id GROUP BY r.state")
def agg_count_distinct(v):
    """Trips are counted by route first, so that neither count needs a distinct pass over the join."""
    per = v.trips.groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("trips"))
    return v.routes.select("id", "state").join(per, "id", "left").groupBy("state").agg(F.count("*").alias("routes"), F.coalesce(F.sum("trips"), F.lit(0)).alias("trips"))


@query("SELECT provider, count(*) - count(DISTINCT lower(name)) AS same_name, count(*) - count(DISTINCT (lat, lng)) AS same_point FROM dense_stops GROUP BY provider")
def agg_dup_count(v):
    names = v.dense_stops.groupBy("provider", F.lower("name").alias("k")).agg(F.count("*").alias("n")).groupBy("provider").agg((F.sum("n") - F.count("*")).alias("same_name"))
    points = v.dense_stops.groupBy("provider", "lat", "lng").agg(F.count("*").alias("n")).groupBy("provider").agg((F.sum("n") - F.count("*")).alias("same_point"))
    return names.join(points, "provider")


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM (SELECT name, state, count(*) AS n FROM stops GROUP BY name, state HAVING count(*) > 1)")
def agg_dup_groups(v):
    return v.stops.groupBy("name", "state").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@query("SELECT trip_id, count(*) AS n, count(DISTINCT seq) AS steps, min(seq) AS low, max(seq) AS high FROM calls GROUP BY trip_id HAVING count(*) <> count(DISTINCT seq) OR min(seq) <> 1 OR max(seq) <> count(*)")
def agg_having_sequence(v):
    per = v.calls.groupBy("trip_id", "seq").agg(F.count("*").alias("n"))
    return per.groupBy("trip_id").agg(F.sum("n").alias("n"), F.count("*").alias("steps"), F.min("seq").alias("low"), F.max("seq").alias("high")).filter("n <> steps or low <> 1 or high <> n")


@query("SELECT t.route_id, t.direction, min(c.departs) AS first_departure FROM trips t JOIN calls c ON c.trip_id = t.id GROUP BY ALL")
def agg_min_departure(v):
    per = v.calls.groupBy("trip_id").agg(F.min("departs").alias("departs"))
    return v.trips.join(per, F.col("trip_id") == F.col("id")).groupBy("route_id", "direction").agg(F.min("departs").alias("first_departure"))


@query("SELECT direction, count(*) AS n, strftime(max(created_at), '%Y-%m-%d') AS latest FROM trips GROUP BY direction")
def agg_max_updated(v):
    return v.trips.groupBy("direction").agg(F.count("*").alias("n"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("latest"))


@query("SELECT route_id, array_to_string(list_sort(array_agg(DISTINCT vehicle)), ',') AS vehicles FROM trips GROUP BY route_id")
def agg_array_distinct(v):
    return v.trips.groupBy("route_id").agg(F.array_join(F.sort_array(F.collect_set("vehicle")), ",").alias("vehicles"))


@query("SELECT trip_id, '[' || string_agg('{\"seq\":' || seq || ',\"stop\":' || stop_id || ',\"at\":' || minute || '}', ',' ORDER BY seq, stop_id, minute) || ']' AS calls_json FROM calls GROUP BY trip_id")
def agg_json(v):
    each = F.struct("seq", F.col("stop_id").alias("stop"), F.col("minute").alias("at"))
    return v.calls.groupBy("trip_id").agg(F.to_json(F.sort_array(F.collect_list(each))).alias("calls_json"))


@query("WITH n AS (SELECT c.stop_id, t.vehicle, count(DISTINCT t.route_id) AS n FROM calls c JOIN trips t ON c.trip_id = t.id GROUP BY ALL) SELECT stop_id, arg_min(vehicle, (-n, vehicle)) AS mode FROM n GROUP BY stop_id")
def agg_mode_by_support(v):
    t = v.trips.select(F.col("id").alias("trip_id"), "vehicle", "route_id")
    each = v.calls.select("stop_id", "trip_id").join(t, "trip_id").select("stop_id", "vehicle", "route_id").distinct()
    n = each.groupBy("stop_id", "vehicle").agg(F.count("*").alias("n"))
    return n.groupBy("stop_id").agg(F.min_by("vehicle", F.struct(-F.col("n"), "vehicle")).alias("mode"))


@query("WITH n AS (SELECT route_id, vehicle, count(*) AS n, min(id) AS first FROM trips GROUP BY ALL) SELECT route_id, arg_min(vehicle, (-n, first)) AS vehicle FROM n GROUP BY route_id")
def agg_modal_vote(v):
    n = v.trips.groupBy("route_id", "vehicle").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.groupBy("route_id").agg(F.min_by("vehicle", F.struct(-F.col("n"), "first")).alias("vehicle"))


@query("""WITH n AS (SELECT r.state, t.vehicle, count(*) AS n FROM trips t JOIN routes r ON t.route_id = r.id GROUP BY ALL)
SELECT state, CAST(sum(n) AS BIGINT) AS trips, string_agg(vehicle || ':' || n, ',' ORDER BY n DESC, vehicle DESC) AS by_mode FROM n GROUP BY state""")
def agg_two_level_city_mode(v):
    r = v.routes.select(F.col("id").alias("route_id"), "state")
    n = v.trips.join(r, "route_id").groupBy("state", "vehicle").agg(F.count("*").alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "vehicle")), asc=False), lambda x: F.concat(x["vehicle"], F.lit(":"), x["n"].cast("string")))
    return n.groupBy("state").agg(F.sum("n").alias("trips"), F.array_join(listed, ",").alias("by_mode"))


@query("SELECT state, CAST(sum(fare_inr) AS BIGINT) AS fares, count(*) AS routes FROM routes GROUP BY state")
def agg_sum(v):
    return v.routes.groupBy("state").agg(F.sum("fare_inr").alias("fares"), F.count("*").alias("routes"))


@query("SELECT agency, CAST(sum(nullif(fare_inr, 0)) AS BIGINT) AS fare, count(nullif(fare_inr, 0)) < count(*) AS incomplete FROM routes GROUP BY agency")
def agg_sum_nullable(v):
    fare = F.nullif("fare_inr", F.lit(0))
    return v.routes.groupBy("agency").agg(F.sum(fare).alias("fare"), (F.count(fare) < F.count("*")).alias("incomplete"))


@query("SELECT trip_id, arg_min(stop_id, (seq, stop_id)) AS origin, arg_max(stop_id, (seq, stop_id)) AS destination FROM calls GROUP BY trip_id")
def agg_first_last(v):
    order = F.struct("seq", "stop_id")
    return v.calls.groupBy("trip_id").agg(F.min_by("stop_id", order).alias("origin"), F.max_by("stop_id", order).alias("destination"))


@query("SELECT name, arg_min(id, ((lat IS NULL)::INT, id)) AS id FROM stops GROUP BY name")
def agg_richest_record(v):
    return v.stops.groupBy("name").agg(F.min_by("id", F.struct(F.col("lat").isNull().cast("int"), "id")).alias("id"))


@query("WITH n AS (SELECT t.route_id, t.direction, t.id, count(c.trip_id) AS n FROM trips t LEFT JOIN calls c ON c.trip_id = t.id GROUP BY ALL) SELECT route_id, direction, arg_min(id, (-n, id)) AS trip_id, max(n) AS calls FROM n GROUP BY ALL")
def agg_longest_representative(v):
    n = v.calls.groupBy(F.col("trip_id").alias("id")).agg(F.count("*").alias("n"))
    t = v.trips.select("id", "route_id", "direction").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t.groupBy("route_id", "direction").agg(F.min_by("id", F.struct(-F.col("n"), "id")).alias("trip_id"), F.max("n").alias("calls"))


@query("SELECT name, array_to_string(list_sort(array_agg(DISTINCT provider)), ',') AS providers, count(DISTINCT provider) AS n FROM stops GROUP BY name")
def agg_merge_sets(v):
    """Sets of each state are merged to one for the name."""
    part = v.stops.groupBy("name", "state").agg(F.collect_set("provider").alias("s"))
    merged = F.sort_array(F.array_distinct(F.flatten(F.collect_list("s"))))
    return part.groupBy("name").agg(merged.alias("p")).select("name", F.array_join("p", ",").alias("providers"), F.size("p").cast("bigint").alias("n"))


@query("SELECT provider, arg_max(status, (created_at, id)) AS latest, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'COMPLETED') AS completed FROM runs GROUP BY provider")
def agg_run_status_rollup(v):
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return v.runs.groupBy("provider").agg(F.max_by("status", F.struct("created_at", "id")).alias("latest"), n("RUNNING"), n("FAILED"), n("COMPLETED"))


@query("SELECT id, CAST(least(100, floor((parsed + failed) * 100 / greatest(parsed + failed + 10, 1) + 0.5)) AS BIGINT) AS pct FROM runs")
def agg_progress_pct(v):
    done = F.col("parsed") + F.col("failed")
    return v.runs.select("id", F.least(F.lit(100), F.floor(done * 100 / F.greatest(done + 10, F.lit(1)) + 0.5)).cast("bigint").alias("pct"))


DBSCAN = """WITH RECURSIVE p AS (SELECT id, {provider} AS provider, lat, lng FROM stops WHERE lat IS NOT NULL),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.provider = b.provider AND (a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng) <= 0.25e0),
full_ AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM full_) AND b IN (SELECT id FROM full_)),
reached AS (SELECT id, id AS r FROM full_ UNION SELECT reached.id, link.b FROM reached JOIN link ON link.a = reached.r),
own AS (SELECT id, min(r) AS cluster FROM reached GROUP BY id),
edge AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN own ON own.id = near.b WHERE a NOT IN (SELECT id FROM full_) GROUP BY a)
SELECT p.id, p.provider, own.id IS NOT NULL AS core, coalesce(own.cluster, edge.cluster) AS cluster FROM p LEFT JOIN own ON own.id = p.id LEFT JOIN edge ON edge.id = p.id"""


@query(f"""{DBSCAN.format(provider="left(provider, 7)").replace("SELECT p.id, p.provider, own.id", ", found AS (SELECT p.lat, p.lng, p.provider, own.id")}),
pts AS (SELECT DISTINCT provider, cluster, CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS y, CAST(floor(lng * 1000000 + 0.5) AS BIGINT) AS x FROM found WHERE cluster IS NOT NULL),
tops AS (SELECT provider, cluster, 1 AS s, x, max(y) AS y FROM pts GROUP BY ALL UNION ALL SELECT provider, cluster, -1, x, min(y) FROM pts GROUP BY ALL),
slopes AS (SELECT p.provider, p.cluster, p.x, p.y, p.s, min(CASE WHEN o.x < p.x THEN p.s * (p.y - o.y) / (p.x - o.x) END) AS before, max(CASE WHEN o.x > p.x THEN p.s * (o.y - p.y) / (o.x - p.x) END) AS after FROM tops p JOIN tops o ON o.provider = p.provider AND o.cluster = p.cluster AND o.s = p.s GROUP BY ALL),
corners AS (SELECT provider, cluster, CAST(count(DISTINCT (x, y)) AS INTEGER) AS corners FROM slopes WHERE before IS NULL OR after IS NULL OR before > after GROUP BY ALL),
box AS (SELECT provider, cluster, min(y) / 1000000 - 0.1e0 AS south, max(y) / 1000000 + 0.1e0 AS north, min(x) / 1000000 - 0.1e0 AS west, max(x) / 1000000 + 0.1e0 AS east FROM pts GROUP BY ALL)
SELECT box.*, corners FROM box JOIN corners ON corners.provider = box.provider AND corners.cluster = box.cluster""")
def agg_spatial_hull(v):
    """An outline for each cluster of stops, by the first digit of their providers."""
    stops = v.stops.withColumn("provider", F.substring("provider", 1, 7))
    found = spatial.hulls(spatial.dbscan(stops, "provider").filter("cluster is not null"), ["provider", "cluster"])
    return found.select("provider", "cluster", "corners", "south", "north", "west", "east")


@query()
def agg_concave_outline(v):
    """A concave outline for each cluster of stops, by the first digit of their providers."""
    stops = v.stops.withColumn("provider", F.substring("provider", 1, 7))
    found = outlines.concave_outlines(spatial.dbscan(stops, "provider").filter("cluster is not null"), ["provider", "cluster"])
    ring = F.array_join(F.transform("ring", lambda p: F.concat((p["x"] / MICRO).cast("string"), F.lit(" "), (p["y"] / MICRO).cast("string"))), ", ")
    first = F.get("ring", F.lit(0))
    closed = F.concat(F.lit("POLYGON (("), ring, F.lit(", "), (first["x"] / MICRO).cast("string"), F.lit(" "), (first["y"] / MICRO).cast("string"), F.lit("))"))
    return found.select("provider", "cluster", "points", "corners", F.round("area", 9).alias("area"), F.when(F.col("corners") > 2, closed).alias("wkt"))


@query(DBSCAN.format(provider="provider"))
def win_dbscan(v):
    return spatial.dbscan(v.stops, "provider").select("id", "provider", "core", "cluster")


@query("SELECT provider, count(*) AS versions, count(DISTINCT content_hash) AS distinct_hashes FROM raw_records GROUP BY provider")
def agg_dataset_hash(v):
    per = v.raw_records.groupBy("provider", "content_hash").agg(F.count("*").alias("n"))
    return per.groupBy("provider").agg(F.sum("n").alias("versions"), F.count("*").alias("distinct_hashes"))


FIELD = "coalesce(length({0}) || ':' || {0}, 'n')"
ROW = " || ".join(FIELD.format(c) for c in ("CAST(id AS VARCHAR)", "name", "provider", "state"))


@query(f"""WITH h AS (SELECT provider, sha256({ROW}) AS h FROM stops), p AS (SELECT provider, count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS p{i}" for i in range(4))} FROM h GROUP BY provider)
SELECT provider, n AS rows, sha256(p0 || '|' || p1 || '|' || p2 || '|' || p3 || '|' || n) AS content_hash FROM p""")
def hash_of_dataset(v):
    return lifecycle.content_hash(v.stops, ["id", "name", "provider", "state"], ["provider"])


@query("WITH k AS (SELECT stop_id, trip_id, departs, row_number() OVER (PARTITION BY stop_id ORDER BY departs, trip_id, seq, platform) AS n FROM calls WHERE departs IS NOT NULL) SELECT stop_id, trip_id, departs FROM k WHERE n <= 8")
def win_top_n_per_group(v):
    order = [F.col(c) for c in ("departs", "trip_id", "seq", "platform")]
    return relational.top_n(v.calls.filter("departs is not null"), ["stop_id"], order, 8).select("stop_id", "trip_id", "departs")
