"""Scans, projections, filters, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import relational as R, repair
from tramline.plans.registry import query


@query("SELECT id, name, provider, state, lat, lng FROM stops")
def scan_table(v):
    return v.stops


@query("SELECT id, name FROM stops WHERE id = 42 LIMIT 1")
def scan_by_pk(v):
    return v.stops.filter("id = 42").select("id", "name").limit(1)


@query("SELECT id, provider, content_hash FROM raw_records WHERE provider = 'src3'")
def src_raw_records(v):
    return v.raw_records.filter("provider = 'src3'").select("id", "provider", "content_hash")


@query("SELECT id, coalesce(nullif(agency, 'FRANCE'), long_name) AS label FROM routes")
def proj_coalesce_nullif(v):
    return v.routes.select("id", F.coalesce(F.nullif("agency", F.lit("FRANCE")), "long_name").alias("label"))


COORD_CASE = "CASE WHEN lat IS NULL THEN 'missing' WHEN lat < 22 OR lat > 27 THEN 'outside' ELSE 'ok' END"


@query(f"SELECT id, {COORD_CASE} AS reason FROM stops")
def proj_case(v):
    return v.stops.select("id", F.when(F.col("lat").isNull(), "missing").when(~F.col("lat").between(22, 27), "outside").otherwise("ok").alias("reason"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def proj_json_extract(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def proj_cast_float(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("SELECT id, name FROM stops WHERE state LIKE 'ECON%' AND provider IN ('Brand#11', 'Brand#12', 'Brand#13')")
def flt_eq_in_scope(v):
    return v.stops.filter(F.col("state").startswith("ECON") & F.col("provider").isin("Brand#11", "Brand#12", "Brand#13")).select("id", "name")


@query("SELECT id, name FROM stops WHERE name ILIKE '%red%' OR state ILIKE '%red%'")
def flt_contains_ci(v):
    return v.stops.filter(R.contains_ci(["name", "state"], "red")).select("id", "name")


@query("SELECT id, long_name FROM routes WHERE starts_with(long_name, 'Customer#00000001')")
def flt_prefix(v):
    return v.routes.filter(F.col("long_name").startswith("Customer#00000001")).select("id", "long_name")


@query("SELECT id, lat, lng FROM stops WHERE lat BETWEEN 23 AND 24 AND lng BETWEEN 87 AND 88")
def flt_bbox(v):
    return v.stops.filter(F.col("lat").between(23, 24) & F.col("lng").between(87, 88)).select("id", "lat", "lng")


@query(f"""WITH RECURSIVE near AS (SELECT id, lat, lng FROM stops WHERE {geo.distance_sql('22.57', '88.36', 'lat', 'lng')} <= 51000), {geo.geodesic_sql('near', '22.57e0', '88.36e0')}
SELECT id, CAST(floor(metres + 0.5) AS BIGINT) AS metres FROM geodesic WHERE metres <= 50000""")
def flt_radius(v):
    """Stops within 50 km on the ellipsoid: a box that reaches the scan, then the sphere with room for the difference, then the geodesic."""
    most = 50000 * geo.SPHERE_SLACK
    south, north, west, east = geo.bearing_box(22.57, 88.36, most)
    here = F.lit(22.57), F.lit(88.36), F.col("lat"), F.col("lng")
    near = v.stops.filter(F.col("lat").between(south, north) & F.col("lng").between(west, east)).filter(geo.distance_m(*here) <= most)
    return near.withColumn("m", geo.geodesic_m(*here)).filter("m <= 50000").select("id", F.floor(F.col("m") + 0.5).cast("bigint").alias("metres"))


@query("SELECT id FROM stops WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)")
def flt_null(v):
    return v.stops.filter("lat is not null and lng is not null and not (lat = 0 and lng = 0)").select("id")


@query("SELECT trip_id, stop_id, seq, departs FROM calls WHERE departs IS NULL OR NOT regexp_full_match(departs, '0[0-9]:[0-5][0-9]')")
def flt_regex(v):
    return v.calls.filter(F.col("departs").isNull() | ~F.col("departs").rlike("^0[0-9]:[0-5][0-9]$")).select("trip_id", "stop_id", "seq", "departs")


SNAP = "CAST(floor(lat * 5000) AS BIGINT), CAST(floor(lng * 5000) AS BIGINT)"


@query(f"SELECT id, lat, lng FROM dense_stops WHERE ({SNAP}) IN (SELECT (y, x) FROM (SELECT CAST(floor(lat * 5000) AS BIGINT) AS y, CAST(floor(lng * 5000) AS BIGINT) AS x FROM dense_stops) GROUP BY y, x HAVING count(*) > 1)")
def flt_tuple_in(v):
    p = v.dense_stops.withColumn("y", F.floor(F.col("lat") * 5000)).withColumn("x", F.floor(F.col("lng") * 5000))
    shared = p.groupBy("y", "x").count().filter("count > 1")
    return p.join(shared, ["y", "x"], "left_semi").select("id", "lat", "lng")


@query("SELECT id, lat IS DISTINCT FROM 21.5e0 AS differs FROM stops")
def flt_is_distinct_from(v):
    return v.stops.select("id", (~F.col("lat").eqNullSafe(21.5)).alias("differs"))


@query("SELECT doc_id FROM documents WHERE length(text) > 120 AND (contains(text, chr(10)) OR contains(text, 'Reg No') OR contains(text, 'Service Charges') OR contains(text, 'Reservation charges'))")
def flt_garbage_name(v):
    t = F.col("text")
    return v.table("documents").filter((F.length(t) > 120) & (t.contains("\n") | t.contains("Reg No") | t.contains("Service Charges") | t.contains("Reservation charges"))).select("doc_id")


@query("SELECT id, lat IS NULL OR NOT (lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180) AS quarantined FROM stops")
def flt_coordinate_domain(v):
    return v.stops.select("id", (F.col("lat").isNull() | ~(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))).alias("quarantined"))


@query("SELECT provider, max_by(id, (created_at, id)) AS version_id FROM runs WHERE status = 'COMPLETED' GROUP BY provider")
def flt_latest_active_version(v):
    return v.runs.filter("status = 'COMPLETED'").groupBy("provider").agg(F.max_by("id", F.struct("created_at", "id")).alias("version_id"))


@query("SELECT id FROM runs WHERE status IS NULL OR status NOT IN ('FAILED', 'RUNNING')")
def flt_lifecycle(v):
    return v.runs.filter("status is null or status not in ('FAILED', 'RUNNING')").select("id")


@query(f"SELECT id, name, round({geo.distance_sql('22.57', '88.36', 'lat', 'lng')} / 1000, 3) AS km FROM stops WHERE lat IS NOT NULL ORDER BY {geo.distance_sql('22.57', '88.36', 'lat', 'lng')}, id LIMIT 20")
def topk_nearest(v):
    d = geo.distance_m(F.lit(22.57), F.lit(88.36), F.col("lat"), F.col("lng"))
    return v.stops.filter("lat is not null").select("id", "name", d.alias("d")).orderBy("d", "id").limit(20).select("id", "name", F.round(F.col("d") / 1000, 3).alias("km"))


@query(f"SELECT state, min_by(id, ({geo.distance_sql('24.5', '87.9', 'lat', 'lng')}, id)) AS stop_id, CAST(floor(min({geo.distance_sql('24.5', '87.9', 'lat', 'lng')}) / 5000 * 60 + 0.5) AS BIGINT) AS walk_min FROM stops WHERE lat IS NOT NULL GROUP BY state")
def top1_nearest_walk(v):
    d = geo.distance_m(F.lit(24.5), F.lit(87.9), F.col("lat"), F.col("lng"))
    near = v.stops.filter("lat is not null").withColumn("d", d).groupBy("state").agg(F.min_by("id", F.struct("d", "id")).alias("stop_id"), F.min("d").alias("d"))
    return near.select("state", "stop_id", F.floor(F.col("d") / 5000 * 60 + 0.5).cast("bigint").alias("walk_min"))


@query("SELECT id, long_name, (SELECT count(*) FROM routes WHERE provider = 'BUILDING') AS total FROM routes WHERE provider = 'BUILDING' ORDER BY long_name, id LIMIT 20 OFFSET 40")
def page_offset(v):
    some = v.routes.filter("provider = 'BUILDING'")
    return R.page(some, [F.col("long_name"), F.col("id")], 3, 20).select("id", "long_name").crossJoin(F.broadcast(some.agg(F.count("*").alias("total"))))  # one row


@query("SELECT trip_id, stop_id, seq, departs FROM calls ORDER BY departs NULLS LAST, trip_id, seq, stop_id, platform LIMIT 100")
def sort_nulls_last(v):
    return v.calls.orderBy(F.asc_nulls_last("departs"), "trip_id", "seq", "stop_id", "platform").limit(100).select("trip_id", "stop_id", "seq", "departs")


@query("WITH t AS (SELECT trip_id, max(minute) - min(minute) AS duration, min(departs) AS departs FROM calls GROUP BY trip_id) SELECT trip_id, duration, departs FROM t ORDER BY duration, coalesce(departs, '99:99'), trip_id LIMIT 50")
def sort_multi_key(v):
    t = v.calls.groupBy("trip_id").agg((F.max("minute") - F.min("minute")).alias("duration"), F.min("departs").alias("departs"))
    return t.orderBy("duration", F.coalesce("departs", F.lit("99:99")), "trip_id").limit(50)


@query("""WITH c AS (SELECT id, name, lat, CASE WHEN name = 'red widget' THEN 0 WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = 'redwidget' THEN 1 ELSE 3 + 2 * (NOT starts_with(name, 'red'))::INT + (lat IS NULL)::INT END AS rank FROM stops WHERE name ILIKE '%red%')
SELECT id, name, CAST(rank AS INTEGER) AS rank FROM c ORDER BY rank, length(name), id LIMIT 25""")
def rank_place_name(v):
    from tramline.operators.resolve import name_rank

    c = v.stops.filter(F.col("name").ilike("%red%"))
    return c.select("id", "name", name_rank(F.col("name"), "red widget", F.col("lat").isNull()).alias("rank")).orderBy("rank", F.length("name"), "id").limit(25)


@query("SELECT stop_id, count(*) AS departures FROM calls WHERE departs IS NOT NULL AND time_source = 'OFFICIAL' GROUP BY stop_id ORDER BY departures DESC, stop_id LIMIT 50")
def top_busiest_stops(v):
    busy = v.calls.filter("departs is not null and time_source = 'OFFICIAL'").groupBy("stop_id").agg(F.count("*").alias("departures"))
    return busy.orderBy(F.desc("departures"), "stop_id").limit(50)


@query("SELECT id, name FROM stops WHERE name ILIKE '%blue%' ORDER BY name, id LIMIT 10")
def limit_unordered(v):
    return v.stops.filter(F.col("name").ilike("%blue%")).select("id", "name").orderBy("name", "id").limit(10)


@query("SELECT id, name, 'stop' AS kind, lat FROM stops UNION ALL SELECT id, long_name, 'route', NULL FROM routes")
def set_union_all(v):
    return v.stops.select("id", "name", F.lit("stop").alias("kind"), "lat").unionByName(v.routes.select("id", F.col("long_name").alias("name"), F.lit("route").alias("kind")), allowMissingColumns=True)


@query("SELECT id FROM stops WHERE name ILIKE '%red%' UNION SELECT id FROM stops WHERE lat BETWEEN 23 AND 24 UNION SELECT stop_id FROM calls WHERE seq = 1")
def set_union_ids_distinct(v):
    s = v.stops
    return s.filter(F.col("name").ilike("%red%")).select("id").union(s.filter(F.col("lat").between(23, 24)).select("id")).union(v.calls.filter("seq = 1").select("stop_id")).distinct()


@query("""SELECT id, label, src FROM (SELECT id, name AS label, 1 AS src FROM stops WHERE name ILIKE '%red%' UNION ALL SELECT id, long_name, 2 FROM routes WHERE long_name LIKE '%11%') ORDER BY src, label, id LIMIT 120""")
def set_concat_ordered(v):
    a = v.stops.filter(F.col("name").ilike("%red%")).select("id", F.col("name").alias("label"), F.lit(1).alias("src"))
    b = v.routes.filter(F.col("long_name").contains("11")).select("id", F.col("long_name").alias("label"), F.lit(2).alias("src"))
    return a.union(b).orderBy("src", "label", "id").limit(120)


@query("SELECT DISTINCT provider, state FROM stops")
def set_distinct(v):
    return v.stops.select("provider", "state").distinct()


@query("""WITH s AS (SELECT id, CASE WHEN id % 5 = 0 THEN upper(provider) || ' old' ELSE long_name END AS seed_name FROM routes WHERE id % 3 <> 0), n AS (SELECT r.id, long_name AS live_name, count(t.id) AS uses FROM routes r LEFT JOIN trips t ON t.route_id = r.id AND t.direction = 'P' WHERE r.id % 4 <> 1 GROUP BY ALL)
SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'STALE' WHEN s.id IS NULL THEN 'MISSING' WHEN seed_name <> live_name THEN 'RENAMED' ELSE 'SAME' END AS status, seed_name, live_name, coalesce(uses = 0, false) AS idle FROM s FULL JOIN n ON n.id = s.id""")
def set_difference(v):
    """A seed list against the live routes, in both directions."""
    seed = v.routes.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.upper("provider"), F.lit(" old"))).otherwise(F.col("long_name")).alias("name"))
    uses = v.trips.filter("direction = 'P'").groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("uses"))
    live = v.routes.filter("id % 4 <> 1").join(uses, "id", "left").select("id", F.col("long_name").alias("name"), F.coalesce("uses", F.lit(0)).alias("uses"))
    return repair.reconcile(seed, live, "id", "name", "uses")


@query("SELECT DISTINCT id FROM routes WHERE id IN (SELECT route_id FROM trips)")
def set_intersection(v):
    return v.routes.select("id").distinct().join(v.trips.select(F.col("route_id").alias("id")), "id", "left_semi")


@query("SELECT page_id, CASE WHEN regexp_matches(p, '^https?://[^/]+/?$') THEN 'HOMEPAGE' WHEN contains(p, '/routes') THEN 'ROUTE_INDEX' WHEN contains(p, '/district') THEN 'DISTRICT_PAGE' WHEN contains(p, '/bus/') OR contains(p, '/route/') THEN 'ROUTE_DETAIL' WHEN contains(p, '/search') THEN 'SEARCH' ELSE 'OTHER' END AS kind FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)")
def src_page_type(v):
    return v.table("pages").select("page_id", text.page_kind(F.col("url")).alias("kind"))
