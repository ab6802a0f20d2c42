"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import journey, polygons, relational
from tramline.operators.spatial import radius_pairs
from tramline.plans.registry import query


@query("SELECT t.id AS trip_id, r.long_name, r.agency FROM trips t JOIN routes r ON t.route_id = r.id")
def join_inner_route_stops(v):
    return v.trips.join(v.routes, v.trips.route_id == v.routes.id).select(v.trips.id.alias("trip_id"), "long_name", "agency")


@query("SELECT c.trip_id, c.seq, s.name AS stop, r.long_name AS route, c.departs FROM calls c JOIN trips t ON c.trip_id = t.id JOIN routes r ON t.route_id = r.id JOIN stops s ON c.stop_id = s.id WHERE r.state = 'ASIA'")
def join_4way_services(v):
    t, r, s = v.trips.select(F.col("id").alias("trip_id"), "route_id"), v.routes.filter("state = 'ASIA'").select(F.col("id").alias("route_id"), F.col("long_name").alias("route")), v.stops.select(F.col("id").alias("stop_id"), F.col("name").alias("stop"))
    return v.calls.join(t.join(r, "route_id"), "trip_id").join(s, "stop_id").select("trip_id", "seq", "stop", "route", "departs")


@query("SELECT r.id, count(t.id) AS trips, count(c.trip_id) AS first_calls FROM routes r LEFT JOIN trips t ON t.route_id = r.id LEFT JOIN calls c ON c.trip_id = t.id AND c.seq = 1 GROUP BY r.id")
def join_left_outer(v):
    first = v.calls.filter("seq = 1").select(F.col("trip_id").alias("c"))
    t = v.trips.select(F.col("id").alias("t"), "route_id")
    j = v.routes.join(t, F.col("route_id") == F.col("id"), "left").join(first, F.col("c") == F.col("t"), "left")
    return j.groupBy("id").agg(F.count("t").alias("trips"), F.count("c").alias("first_calls"))


@query("SELECT n.n_nationkey AS id, n.n_name AS name, r.r_name AS parent FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_self_hierarchy(v):
    return v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))


@query("SELECT s.id FROM stops s LEFT JOIN calls c ON c.stop_id = s.id AND c.seq = 1 WHERE c.stop_id IS NULL")
def join_anti_left_null(v):
    return v.stops.join(v.calls.filter("seq = 1"), F.col("stop_id") == F.col("id"), "left_anti").select("id")


@query("SELECT t.id FROM trips t WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.trip_id = t.id)")
def join_anti_not_exists(v):
    return v.trips.join(v.calls, F.col("trip_id") == F.col("id"), "left_anti").select("id")


@query("SELECT id FROM routes WHERE id NOT IN (SELECT route_id FROM trips WHERE direction = 'F' AND route_id IS NOT NULL)")
def join_anti_not_in(v):
    return v.routes.join(v.trips.filter("direction = 'F' and route_id is not null"), v.routes.id == v.trips.route_id, "left_anti").select("id")


@query("SELECT id FROM routes r WHERE EXISTS (SELECT 1 FROM trips t WHERE t.route_id = r.id AND t.direction = 'P')")
def join_semi_exists(v):
    return v.routes.join(v.trips.filter("direction = 'P'"), v.routes.id == v.trips.route_id, "left_semi").select("id")


@query("SELECT trip_id, stop_id, seq FROM calls WHERE trip_id IN (SELECT trip_id FROM calls GROUP BY trip_id HAVING count(*) > 6)")
def join_semi_in(v):
    long = v.calls.groupBy("trip_id").agg(F.count("*").alias("n")).filter("n > 6")
    return v.calls.join(long, "trip_id", "left_semi").select("trip_id", "stop_id", "seq")


@query("SELECT a.id, min_by(b.id, b.id) AS donor, min_by(b.lat, b.id) AS lat, min_by(b.lng, b.id) AS lng FROM stops a JOIN stops b ON lower(a.name) = lower(b.name) AND b.lat IS NOT NULL WHERE a.lat IS NULL GROUP BY a.id")
def join_self_name(v):
    from tramline.operators.resolve import donate_coordinates

    return donate_coordinates(v.stops)


SEQ_SQL = "SELECT o.trip_id, o.stop_id AS origin, d.stop_id AS destination, CAST(d.seq - o.seq AS INTEGER) AS hops FROM calls o JOIN calls d ON o.trip_id = d.trip_id AND d.seq > o.seq JOIN stops so ON so.id = o.stop_id JOIN stops sd ON sd.id = d.stop_id WHERE starts_with(so.name, 'red') AND starts_with(sd.name, 'blue')"


@query(SEQ_SQL)
def join_sequence_theta(v):
    return journey.later_calls(v.calls, v.stops, "red", "blue")


@query("SELECT o.stop_id AS origin, d.stop_id AS destination, CAST(min(greatest(8, 3 * (d.seq - o.seq))) AS INTEGER) AS minutes, count(*) AS rides FROM calls o JOIN calls d ON o.trip_id = d.trip_id AND o.seq < d.seq GROUP BY ALL")
def join_direct_legs(v):
    return journey.direct_legs(v.calls)


@query("SELECT o.stop_id AS origin, d.stop_id AS destination, CAST(min(greatest(6, 2 * abs(d.seq - o.seq) + 3)) AS INTEGER) AS minutes, count(*) AS rides FROM calls o JOIN calls d ON o.trip_id = d.trip_id AND o.seq <> d.seq GROUP BY ALL")
def join_direct_legs_metro(v):
    return journey.line_legs(v.calls)


@query("SELECT trip_id, min(seq) FILTER (WHERE stop_id % 10 < 3) AS board, max(seq) FILTER (WHERE stop_id % 10 > 6) AS alight FROM calls GROUP BY trip_id HAVING min(seq) FILTER (WHERE stop_id % 10 < 3) < max(seq) FILTER (WHERE stop_id % 10 > 6)")
def join_earliest_latest(v):
    some = lambda c, f: f(F.when(c, F.col("seq")))
    return v.calls.groupBy("trip_id").agg(some(F.col("stop_id") % 10 < 3, F.min).alias("board"), some(F.col("stop_id") % 10 > 6, F.max).alias("alight")).filter("board < alight")


KEY_SQL = "array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('metro', 'station', 'bus', 'stand', 'platform') THEN '' WHEN w IN ('kbs', 'kempegowda') THEN 'majestic' ELSE w END), lambda w: w <> ''), ' ')"


@query(f"WITH k AS (SELECT id, provider, {KEY_SQL.format('name')} AS k FROM stops) SELECT a.id AS station, b.id AS stop, 0.8e0 AS confidence FROM k a JOIN k b USING (k) WHERE length(k) >= 4 AND a.provider = 'Brand#11' AND b.provider = 'Brand#22'")
def join_transfer_name(v):
    return journey.name_transfers(v.stops.filter("provider = 'Brand#11'"), v.stops.filter("provider = 'Brand#22'"))


LEGS = "legs AS (SELECT o.stop_id AS origin, d.stop_id AS destination, min(greatest(8, 3 * (d.seq - o.seq))) AS m FROM calls o JOIN calls d ON o.trip_id = d.trip_id AND o.seq < d.seq GROUP BY ALL)"


@query(f"WITH {LEGS} SELECT x.origin, y.destination, CAST(min(x.m + 4 + y.m) AS INTEGER) AS minutes FROM legs x JOIN legs y ON x.destination = y.origin WHERE x.origin % 20 = 0 AND x.origin <> y.destination GROUP BY ALL")
def join_transfer_compose(v):
    """Searches from every stop whose id is divisible by 20, to all stops."""
    return journey.two_legs(v.calls, F.col("origin") % 20 == 0)


@query("SELECT t.id, max_by(c.stop_id, (c.seq, c.stop_id)) AS headsign_stop FROM trips t LEFT JOIN calls c ON c.trip_id = t.id GROUP BY t.id")
def join_lateral_last(v):
    last = v.calls.groupBy("trip_id").agg(F.max_by("stop_id", F.struct("seq", "stop_id")).alias("headsign_stop"))
    return v.trips.join(last, F.col("trip_id") == F.col("id"), "left").select("id", "headsign_stop")


@query("SELECT s.id, (SELECT min(c.time_source) || '_STOP' FROM calls c WHERE c.stop_id = s.id) AS kind FROM stops s")
def join_scalar_subquery(v):
    kind = v.calls.groupBy("stop_id").agg(F.concat(F.min("time_source"), F.lit("_STOP")).alias("kind"))
    return v.stops.join(kind, F.col("stop_id") == F.col("id"), "left").select("id", "kind")


SERVED = "SELECT DISTINCT c.stop_id, r.id AS route_id, r.long_name FROM calls c JOIN trips t ON c.trip_id = t.id JOIN routes r ON t.route_id = r.id"


@query(f"WITH s AS ({SERVED}), k AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY long_name, route_id) AS n FROM s) SELECT stop_id, '[' || string_agg('{{\"name\":\"' || long_name || '\",\"id\":' || route_id || '}}', ',' ORDER BY n) || ']' AS services FROM k WHERE n <= 8 GROUP BY stop_id")
def join_json_agg_nested(v):
    return journey.services_of_stops(v.calls, v.trips, v.routes)


NEAR = geo.distance_sql("lat0", "lng0", "s.lat", "s.lng")


@query(f"SELECT s.id, s.name, CAST(floor({geo.distance_sql('22.57', '88.36', 's.lat', 's.lng')} + 0.5) AS BIGINT) AS metres, count(DISTINCT t.route_id) AS services FROM stops s LEFT JOIN calls c ON c.stop_id = s.id LEFT JOIN trips t ON c.trip_id = t.id WHERE {geo.distance_sql('22.57', '88.36', 's.lat', 's.lng')} <= 30000 GROUP BY ALL")
def stops_nearby(v):
    south, north, west, east = geo.bearing_box(22.57, 88.36, 30000)
    d = geo.distance_m(F.lit(22.57), F.lit(88.36), F.col("lat"), F.col("lng"))
    near = v.stops.filter(F.col("lat").between(south, north) & F.col("lng").between(west, east)).withColumn("d", d).filter("d <= 30000")
    t = v.trips.select(F.col("id").alias("trip_id"), "route_id")
    served = v.calls.join(near.select(F.col("id").alias("stop_id")), "stop_id", "left_semi").join(t, "trip_id").groupBy("stop_id").agg(F.countDistinct("route_id").alias("services"))
    return near.join(served, F.col("stop_id") == F.col("id"), "left").select("id", "name", F.floor(F.col("d") + 0.5).cast("bigint").alias("metres"), F.coalesce("services", F.lit(0)).cast("bigint").alias("services"))


@query(f"SELECT a.id AS a, b.id AS b, CAST(floor({geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} + 0.5) AS BIGINT) AS metres FROM stops a JOIN stops b ON a.id < b.id AND abs(a.lat - b.lat) < 0.2 AND {geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 20000")
def join_spatial_radius(v):
    return radius_pairs(v.stops, 20000)


@query("""WITH s AS (SELECT id, name, provider FROM stops), x AS (SELECT a.id, b.id AS twin, b.provider AS twin_provider, row_number() OVER (PARTITION BY a.id ORDER BY length(b.provider), b.provider, b.id) AS n FROM s a JOIN s b ON a.name = b.name AND a.provider <> b.provider WHERE a.provider = 'Brand#11')
SELECT id, twin, twin_provider FROM x WHERE n = 1""")
def join_twin_place(v):
    a = v.stops.filter("provider = 'Brand#11'").select("id", "name")
    b = v.stops.filter("provider <> 'Brand#11'").select(F.col("id").alias("twin"), "name", F.col("provider").alias("twin_provider"))
    order = [F.length("twin_provider"), F.col("twin_provider"), F.col("twin")]
    best = relational.top_n(b, ["name"], order, 1)  # one twin for each name serves all its stops
    return a.join(best, "name").select("id", "twin", "twin_provider")


SURVIVOR = "SELECT id, min(id) OVER (PARTITION BY name, state, CAST(floor(lat * 1000 + 0.5) AS BIGINT), CAST(floor(lng * 1000 + 0.5) AS BIGINT)) AS survivor FROM dense_stops"


@query(f"WITH m AS ({SURVIVOR}) SELECT c.trip_id, c.seq, coalesce(m.survivor, c.stop_id) AS stop_id FROM calls c LEFT JOIN m ON m.id = c.stop_id")
def join_canonical_remap(v):
    from tramline.operators.resolve import grid_survivors

    m = grid_survivors(v.dense_stops).filter("id <> survivor").select(F.col("id").alias("stop_id"), "survivor")
    return v.calls.join(m, "stop_id", "left").select("trip_id", "seq", F.coalesce("survivor", "stop_id").alias("stop_id"))


@query("SELECT c.trip_id, c.seq, s.id AS canonical, s.id IS NULL AS unmatched FROM calls c LEFT JOIN stops s ON s.id = c.stop_id AND s.lat IS NOT NULL")
def join_external_id(v):
    known = v.stops.filter("lat is not null").select(F.col("id").alias("canonical"))
    return v.calls.join(known, F.col("canonical") == F.col("stop_id"), "left").select("trip_id", "seq", "canonical", F.col("canonical").isNull().alias("unmatched"))


@query("""WITH t AS (SELECT id FROM trips WHERE route_id IN (SELECT id FROM routes WHERE state <> 'ASIA')), c AS (SELECT trip_id, stop_id FROM calls WHERE stop_id IN (SELECT id FROM stops WHERE lat IS NOT NULL) AND trip_id IN (SELECT id FROM t))
SELECT count(DISTINCT trip_id) AS trips, count(*) AS calls, (SELECT count(*) FROM trips) - count(DISTINCT trip_id) AS dropped_trips, (SELECT count(*) FROM calls) - count(*) AS dropped_calls FROM c""")
def join_landable(v):
    from tramline.operators.lifecycle import landable

    return landable(v.routes.filter("state <> 'ASIA'"), v.trips, v.stops.filter("lat is not null"), v.calls)[1]


@query("""WITH RECURSIVE p AS (SELECT id, name FROM places WHERE id % 3 <> 0), al AS (SELECT name || ' alias' AS wanted, min(id) AS id FROM places WHERE id % 3 = 1 GROUP BY ALL),
q AS (SELECT DISTINCT CASE id % 4 WHEN 0 THEN name WHEN 1 THEN 'x' || name WHEN 2 THEN regexp_replace(name, 'e', 'a') ELSE name || ' alias' END AS wanted FROM stops),
ex AS (SELECT q.wanted, p.name AS place, 'exact' AS how FROM q JOIN p ON p.name = q.wanted),
ali AS (SELECT q.wanted, (SELECT name FROM p WHERE p.id = al.id) AS place, 'alias' AS how FROM q JOIN al USING (wanted) WHERE q.wanted NOT IN (SELECT wanted FROM ex) AND al.id IN (SELECT id FROM p)),
r AS (SELECT wanted FROM q WHERE wanted NOT IN (SELECT wanted FROM ex) AND wanted NOT IN (SELECT wanted FROM ali)),
f AS (SELECT r.wanted, p.id, p.name, (greatest(length(wanted), length(name)) - levenshtein(wanted, name)) / greatest(length(wanted), length(name)) AS s FROM r, p),
fz AS (SELECT wanted, name AS place, 'fuzzy' AS how FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY s DESC, id) AS n FROM f WHERE s >= 0.85) WHERE n = 1),
l AS (SELECT wanted, row_number() OVER (ORDER BY wanted) AS n FROM r WHERE wanted NOT IN (SELECT wanted FROM fz)),
pr AS (SELECT a.wanted AS early, b.wanted AS late, (greatest(length(a.wanted), length(b.wanted)) - levenshtein(a.wanted, b.wanted)) / greatest(length(a.wanted), length(b.wanted)) AS s FROM l a JOIN l b ON a.n < b.n AND (greatest(length(a.wanted), length(b.wanted)) - levenshtein(a.wanted, b.wanted)) / greatest(length(a.wanted), length(b.wanted)) >= 0.85),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS heads UNION ALL SELECT w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.late = l.wanted AND list_contains(w.heads, pr.early)) THEN w.heads ELSE list_append(w.heads, l.wanted) END FROM w JOIN l ON l.n = w.n + 1),
hd AS (SELECT unnest(heads) AS wanted FROM (SELECT heads FROM w ORDER BY n DESC LIMIT 1)),
mg AS (SELECT late AS wanted, early AS place, 'merged' AS how FROM (SELECT late, early, row_number() OVER (PARTITION BY late ORDER BY s DESC, early) AS n FROM pr WHERE early IN (SELECT wanted FROM hd) AND late NOT IN (SELECT wanted FROM hd)) WHERE n = 1)
FROM ex UNION ALL FROM ali UNION ALL FROM fz UNION ALL FROM mg UNION ALL SELECT wanted, NULL, 'created' FROM hd""")
def join_fuzzy_cascade(v):
    """Names as they are, with a letter put in front, with another letter inside, and under an alias, against two thirds of the places."""
    from tramline.operators.resolve import resolve_names

    kind = F.col("id") % 4
    name = F.when(kind == 0, F.col("name")).when(kind == 1, F.concat(F.lit("x"), "name")).when(kind == 2, F.regexp_replace("name", "^([^e]*)e", "$1a")).otherwise(F.concat("name", F.lit(" alias")))
    aliases = v.places.filter("id % 3 = 1").select(F.concat("name", F.lit(" alias")).alias("alias"), F.col("id").alias("place_id"))
    return resolve_names(v.stops.select(name.alias("wanted")), v.places.filter("id % 3 <> 0"), aliases).select("wanted", "place", "how")


@query("""WITH c AS (SELECT a.id, b.id AS candidate, (greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) / greatest(length(a.name), length(b.name)) - CASE WHEN a.state = b.state THEN 0 ELSE 0.3e0 END AS s FROM stops a JOIN (SELECT min(id) AS id, name, state FROM stops WHERE lat IS NOT NULL GROUP BY name, state) b ON left(a.name, 5) = left(b.name, 5) WHERE a.lat IS NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, candidate) AS n FROM c WHERE s >= 0.6)
SELECT id, candidate, CASE WHEN s >= 1 THEN 0.98e0 WHEN s >= 0.8 THEN 0.92e0 ELSE 0.84e0 END AS confidence FROM d WHERE n = 1""")
def join_geocode_candidates(v):
    from tramline.operators.resolve import geocode

    return geocode(v.stops)


@query("SELECT r.provider, count(DISTINCT r.id) AS routes, count(DISTINCT c.c_custkey) AS customers FROM routes r LEFT JOIN customer c ON c.c_mktsegment = r.provider AND c.c_acctbal > 5000 GROUP BY r.provider")
def join_fanout_bug(v):
    """Both sides are counted before they meet, so nothing fans out."""
    a = v.routes.groupBy("provider").agg(F.count("id").alias("routes"))
    b = v.table("customer").filter("c_acctbal > 5000").groupBy(F.col("c_mktsegment").alias("provider")).agg(F.count("*").alias("customers"))
    return a.join(b, "provider", "left").select("provider", "routes", F.coalesce("customers", F.lit(0)).alias("customers"))


ZONE_EDGES = "SELECT a.poly, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM zone_corners a JOIN zone_corners b ON b.poly = a.poly AND b.i = (a.i + 1) % 8"
EAST_OF = "(e.y1 > p.y) <> (e.y2 > p.y) AND CASE WHEN e.y2 > e.y1 THEN (p.x - e.x1) * (e.y2 - e.y1) < (p.y - e.y1) * (e.x2 - e.x1) ELSE (p.x - e.x1) * (e.y2 - e.y1) > (p.y - e.y1) * (e.x2 - e.x1) END"


def _zone_side(a: str, y: str, x: str) -> str:
    return f"sign(({a}.x2 - {a}.x1) * ({y} - {a}.y1) - ({a}.y2 - {a}.y1) * ({x} - {a}.x1))"


def _zone_on(a: str, y: str, x: str) -> str:
    return f"({_zone_side(a, y, x)} = 0 AND {y} BETWEEN least({a}.y1, {a}.y2) AND greatest({a}.y1, {a}.y2) AND {x} BETWEEN least({a}.x1, {a}.x2) AND greatest({a}.x1, {a}.x2))"


MEET = f"({_zone_side('a', 'b.y1', 'b.x1')} * {_zone_side('a', 'b.y2', 'b.x2')} < 0 AND {_zone_side('b', 'a.y1', 'a.x1')} * {_zone_side('b', 'a.y2', 'a.x2')} < 0 OR {_zone_on('a', 'b.y1', 'b.x1')} OR {_zone_on('a', 'b.y2', 'b.x2')} OR {_zone_on('b', 'a.y1', 'a.x1')} OR {_zone_on('b', 'a.y2', 'a.x2')})"


@query(f"""WITH e AS MATERIALIZED ({ZONE_EDGES}),
inside AS (SELECT p.poly AS id, e.poly FROM zone_corners p JOIN e ON e.poly <> p.poly AND {EAST_OF} WHERE p.i = 0 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT DISTINCT a.poly AS a, b.poly AS b FROM e a JOIN e b ON a.poly < b.poly AND {MEET} UNION SELECT least(id, poly), greatest(id, poly) FROM inside""")
def join_spatial_overlap(v):
    return polygons.overlaps(v.zones)


EDGE = "CAST(p.y - e.y1 AS DOUBLE) AS py, CAST(p.x - e.x1 AS DOUBLE) AS px, CAST(e.y2 - e.y1 AS DOUBLE) AS dy, CAST(e.x2 - e.x1 AS DOUBLE) AS dx, CAST(p.y - e.y2 AS DOUBLE) AS qy, CAST(p.x - e.x2 AS DOUBLE) AS qx"


@query(f"""WITH e AS MATERIALIZED ({ZONE_EDGES}), p AS (SELECT id, CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS y, CAST(floor(lng * 1000000 + 0.5) AS BIGINT) AS x FROM stops),
held AS (SELECT p.id, e.poly FROM p JOIN e ON {EAST_OF} GROUP BY ALL HAVING count(*) % 2 = 1),
d AS (SELECT p.id, e.poly, {EDGE} FROM p JOIN e ON true)
SELECT id, poly FROM held UNION SELECT id, poly FROM d WHERE CASE WHEN py * dy + px * dx <= 0 THEN py * py + px * px <= 1e10 WHEN py * dy + px * dx >= dy * dy + dx * dx THEN qy * qy + qx * qx <= 1e10 ELSE (dx * py - dy * px) * (dx * py - dy * px) <= 1e10 * (dy * dy + dx * dx) END""")
def join_region_reach(v):
    """Each stop with the zones that it is inside of or at most a tenth of a degree away from."""
    p = v.stops.select("id", polygons.micro(F.col("lat")).alias("y"), polygons.micro(F.col("lng")).alias("x"))
    return polygons.within(p, v.zones.select("poly", "ring"), 100_000)


@query(f"""WITH e AS MATERIALIZED ({ZONE_EDGES}), p AS (SELECT id, CAST(floor(lat * 1000000 + 0.5) AS BIGINT) AS y, CAST(floor(lng * 1000000 + 0.5) AS BIGINT) AS x FROM stops),
held AS (SELECT p.id, e.poly FROM p JOIN e ON {EAST_OF} GROUP BY ALL HAVING count(*) % 2 = 1),
area AS (SELECT poly, abs(sum(x1 * y2 - x2 * y1)) AS area FROM e GROUP BY poly),
best AS (SELECT id, arg_min(held.poly, (area, held.poly)) AS poly FROM held JOIN area ON area.poly = held.poly GROUP BY id)
SELECT p.id, best.poly FROM p LEFT JOIN best ON best.id = p.id""")
def flt_point_in_polygon(v):
    """The smallest zone around each stop."""
    return polygons.smallest_around(v.stops.select("id", polygons.micro(F.col("lat")).alias("y"), polygons.micro(F.col("lng")).alias("x")), v.zones)
