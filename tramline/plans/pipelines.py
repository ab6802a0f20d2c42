"""Graph search, quality, entity resolution, mapping, lifecycle, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import journey, lifecycle, mapping, quality, relational, repair, resolve
from tramline.plans.registry import query
from tramline.plans.windows import POS
from tramline.session import cut

HOPS = f"""p AS ({POS}), h0 AS (SELECT p.*, s.lat, s.lng FROM p LEFT JOIN stops s ON s.id = p.stop_id),
h1 AS (SELECT *, {geo.distance_sql('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS metres, CASE WHEN departs IS NOT NULL AND lag(departs) OVER w IS NOT NULL THEN minute - lag(minute) OVER w END AS tt FROM h0 WINDOW w AS (PARTITION BY trip_id ORDER BY pos)),
h2 AS (SELECT *, CAST(CASE WHEN pos = 1 THEN 0 WHEN tt > 0 THEN tt WHEN metres <= 150000 THEN greatest(1, floor(metres / (22e0 * 1000 / 60) + 0.5)) END AS BIGINT) AS hop_min FROM h1),
hops AS (SELECT *, sum((hop_min IS NULL)::INT) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM h2)"""
CUM = "cum AS (SELECT trip_id, segment, pos, stop_id, sum(coalesce(hop_min, 0)) OVER (PARTITION BY trip_id, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM hops)"


@query(f"WITH {HOPS} SELECT trip_id, pos, stop_id, hop_min, CAST(segment AS BIGINT) AS segment FROM hops")
def graph_hop_minutes(v):
    return journey.hops(v.calls, v.stops).select("trip_id", F.col("pos").cast("bigint").alias("pos"), "stop_id", "hop_min", "segment")


@query(f"WITH {HOPS} SELECT trip_id, CAST(sum(CASE WHEN metres IS NULL THEN 0 ELSE floor(metres + 0.5) END) AS BIGINT) AS metres FROM hops GROUP BY trip_id")
def graph_route_length(v):
    from tramline.operators.timetable import hop_metres

    return hop_metres(v.calls, v.stops).groupBy("trip_id").agg(F.sum(F.coalesce(F.floor(F.col("metres") + 0.5), F.lit(0))).cast("bigint").alias("metres"))


@query(f"""WITH {HOPS}, e AS (SELECT a, count(DISTINCT b) AS edges FROM (SELECT lag(stop_id) OVER (PARTITION BY trip_id ORDER BY pos) AS a, stop_id AS b, hop_min FROM hops) WHERE hop_min IS NOT NULL AND a <> b GROUP BY a), n AS (SELECT stop_id, count(*) AS calls FROM calls GROUP BY stop_id)
SELECT s.id AS stop_id, CASE WHEN lat <= 26 AND lng >= 86 THEN CAST(floor(lat / 0.01e0) AS BIGINT) END AS cy, CASE WHEN lat <= 26 AND lng >= 86 THEN CAST(floor(lng / 0.01e0) AS BIGINT) END AS cx, coalesce(n.calls, 0) AS calls, coalesce(e.edges, 0) AS edges FROM stops s LEFT JOIN n ON n.stop_id = s.id LEFT JOIN e ON e.a = s.id""")
def graph_build(v):
    """The stop graph, its grid held to a box that leaves some stops out."""
    return journey.stop_graph(v.calls, v.stops, (6.0, 26.0, 86.0, 98.0))


def _round(labels: str) -> str:
    return f"SELECT stop_id, min(minutes) AS minutes FROM (SELECT c.stop_id, c.cum + 6 + min(l.minutes - c.cum) OVER (PARTITION BY c.trip_id, c.segment ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS minutes FROM cum c LEFT JOIN {labels} l ON l.stop_id = c.stop_id) WHERE minutes IS NOT NULL GROUP BY stop_id"


ORIGIN = "l0 AS (SELECT 1 AS stop_id, 0 AS minutes)"


@query(f"WITH {HOPS}, {CUM}, {ORIGIN}, r AS ({_round('l0')}) SELECT stop_id, CAST(minutes AS BIGINT) AS minutes FROM r")
def graph_ride_round(v):
    origin = v.spark.range(1, 2).select(F.col("id").alias("stop_id"), F.lit(0).cast("bigint").alias("minutes"))
    return journey.ride_round(origin, journey.hops(v.calls, v.stops))


WALKS = f"walks AS (SELECT a.id AS a, b.id AS b, CAST(floor({geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} + 0.5) AS BIGINT) AS metres FROM stops a JOIN stops b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.01 AND {geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 600)"


def _walk(labels: str) -> str:
    return f"SELECT w.b AS stop_id, min(l.minutes + CAST(greatest(1, floor(w.metres / 75 + 0.5)) AS BIGINT)) AS minutes FROM {labels} l JOIN walks w ON w.a = l.stop_id GROUP BY w.b"


@query(f"WITH {WALKS.replace('<= 600', '<= 20000').replace('< 0.01', '< 0.2')}, l0 AS (SELECT id AS stop_id, id % 50 AS minutes FROM stops) SELECT stop_id, CAST(minutes AS BIGINT) AS minutes FROM ({_walk('l0')})")
def graph_walk_round(v):
    return journey.walk_round(v.stops.select(F.col("id").alias("stop_id"), (F.col("id") % 50).alias("minutes")), journey.Walks(v.stops, 20000))


def _each_round(n: int) -> str:
    """One ride and one walk of each search from the labels l{n - 1}; gives l{n}."""
    return f"""r{n} AS MATERIALIZED (SELECT l.origin, g.b AS stop_id, min(l.minutes + g.m) AS minutes FROM l{n - 1} l JOIN g ON g.a = l.stop_id GROUP BY ALL),
w{n} AS (SELECT r.origin, w.b AS stop_id, min(r.minutes + CAST(greatest(1, floor(w.metres / 75 + 0.5)) AS BIGINT)) AS minutes FROM r{n} r JOIN walks w ON w.a = r.stop_id GROUP BY ALL),
l{n} AS MATERIALIZED (SELECT origin, stop_id, min(minutes) AS minutes FROM (FROM l{n - 1} UNION ALL FROM r{n} UNION ALL FROM w{n}) GROUP BY ALL)"""


@query(f"""WITH {HOPS}, {CUM}, {WALKS.replace('walks AS (', 'walks AS MATERIALIZED (')}, g AS MATERIALIZED (SELECT x.stop_id AS a, y.stop_id AS b, min(y.cum - x.cum) + 6 AS m FROM cum x JOIN cum y ON y.trip_id = x.trip_id AND y.segment = x.segment AND y.pos > x.pos GROUP BY ALL),
l0 AS (SELECT p.id AS origin, s.id AS stop_id, 0 AS minutes FROM places p JOIN stops s ON s.name = p.name), {_each_round(1)}, {_each_round(2)}, {_each_round(3)} SELECT origin, stop_id, CAST(minutes AS BIGINT) AS minutes FROM l3""")
def graph_plan(v):
    """From every place, which is all stops of a name, to all stops, over up to three rides."""
    places = v.places.select(F.col("id").alias("origin"), "name")
    origins = v.stops.join(places, "name").select("origin", F.col("id").alias("stop_id"), F.lit(0).alias("minutes"))
    return journey.reach_each(origins, v.calls, v.stops)


@query(f"SELECT a.id AS a, b.id AS b, CAST(greatest(1, floor({geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} / CASE WHEN {geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2000 THEN 84 ELSE 499.8e0 END + 0.5)) AS INTEGER) AS minutes FROM stops a JOIN stops b ON a.id < b.id AND abs(a.lat - b.lat) < 0.15 AND {geo.distance_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 15000")
def graph_transfer_edge(v):
    from tramline.operators.spatial import near_pairs

    return near_pairs(v.stops, 15000).select("a", "b", F.greatest(F.lit(1), F.floor(F.col("d") / F.when(F.col("d") <= 2000, 84.0).otherwise(499.8) + 0.5)).cast("int").alias("minutes"))


@query(f"""WITH RECURSIVE {HOPS}, g AS MATERIALIZED (SELECT a, b, min(hop_min) AS weight FROM (SELECT lag(stop_id) OVER (PARTITION BY trip_id ORDER BY pos) AS a, stop_id AS b, hop_min FROM hops) WHERE a IS NOT NULL AND hop_min IS NOT NULL AND a <> b GROUP BY ALL),
q AS (SELECT CAST(n_nationkey AS BIGINT) AS query, CAST(n_nationkey * 7 + 1 AS BIGINT) AS origin, CAST(n_nationkey * 11 + 60 AS BIGINT) AS target FROM nation),
w AS (SELECT query, target, origin AS here, [origin] AS path, CAST(0 AS BIGINT) AS weight FROM q UNION ALL SELECT w.query, w.target, g.b, list_append(w.path, g.b), w.weight + g.weight FROM w JOIN g ON g.a = w.here WHERE w.here <> w.target AND NOT list_contains(w.path, g.b) AND w.weight + g.weight <= 720)
SELECT query, array_to_string(path, '>') AS path, weight, CAST(row_number() OVER (PARTITION BY query ORDER BY weight, path) AS INTEGER) AS rank FROM w WHERE here = target""")
def graph_all_paths_dfs(v):
    """All ways of at most twelve hours between each nation's pair of stops, lightest first."""
    k = F.col("n_nationkey").cast("bigint")
    pairs = v.table("nation").select(k.alias("query"), (k * 7 + 1).alias("origin"), (k * 11 + 60).alias("target"))
    found = journey.paths_within(cut(journey.hop_edges(v.calls, v.stops)), pairs, 720)
    return found.withColumn("path", F.array_join("path", ">"))


@query("""WITH legs AS (SELECT o.stop_id AS origin, d.stop_id AS destination, min(greatest(8, 3 * (d.seq - o.seq))) AS m FROM calls o JOIN calls d ON o.trip_id = d.trip_id AND o.seq < d.seq GROUP BY ALL),
d AS (SELECT origin, destination, m FROM legs WHERE origin % 20 = 0 AND origin <> destination),
t AS (SELECT x.origin, y.destination, min(x.m + 4 + y.m) AS m FROM legs x JOIN legs y ON x.destination = y.origin WHERE x.origin % 20 = 0 AND x.origin <> y.destination GROUP BY ALL)
SELECT origin, destination, CAST(m AS INTEGER) AS minutes, 'direct' AS how FROM d UNION ALL SELECT t.origin, t.destination, CAST(t.m AS INTEGER), 'transfer' FROM t ANTI JOIN d ON d.origin = t.origin AND d.destination = t.destination""")
def graph_regional_plan(v):
    """From every stop whose id is divisible by 20 to all stops: direct rides, and rides with a transfer where there is none."""
    return journey.direct_or_change(v.calls, F.col("origin") % 20 == 0)


@query("""SELECT 'COORDINATE_COVERAGE_MIN_90' AS rule, 'WARNING' AS severity, CAST(floor(count(lat) * 10000 / count(*)) AS BIGINT) AS actual, floor(count(lat) * 10000 / count(*)) >= 9000 AS passed FROM stops
UNION ALL SELECT 'DUPLICATE_STOPS_EXIST', 'WARNING', count(*), count(*) = 0 FROM (SELECT 1 FROM stops GROUP BY provider, lower(name) HAVING count(*) > 1)
UNION ALL SELECT 'ORPHAN_STOPS', 'WARNING', count(*), count(*) = 0 FROM stops WHERE id NOT IN (SELECT stop_id FROM calls)
UNION ALL SELECT 'ROUTE_DISCONNECTED', 'ERROR', count(*), count(*) = 0 FROM routes WHERE id NOT IN (SELECT route_id FROM trips)
UNION ALL SELECT 'STOP_SEQUENCE_INVALID', 'ERROR', count(*), count(*) = 0 FROM (SELECT 1 FROM calls GROUP BY trip_id HAVING count(*) <> count(DISTINCT seq) OR min(seq) <> 1 OR max(seq) <> count(*))
UNION ALL SELECT 'STOP_SEQUENCE_TOO_SHORT', 'WARNING', count(*), count(*) = 0 FROM (SELECT 1 FROM calls GROUP BY trip_id HAVING count(*) < 2)
UNION ALL SELECT 'TIMETABLE_COVERAGE_LOW', 'WARNING', CAST(floor(count(departs) * 10000 / count(*)) AS BIGINT), floor(count(departs) * 10000 / count(*)) >= 1000 FROM calls
UNION ALL SELECT 'FARE_COVERAGE_LOW', 'WARNING', CAST(floor(count(nullif(fare_inr, 0)) * 10000 / count(*)) AS BIGINT), floor(count(nullif(fare_inr, 0)) * 10000 / count(*)) >= 1000 FROM routes""")
def dq_gates(v):
    return quality.gates(v.stops, v.routes, v.trips, v.calls)


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY provider, lat, lng) AS k FROM dense_stops) SELECT provider, count(*) AS total, count(*) FILTER (WHERE lat IS NULL) AS missing, count(*) FILTER (WHERE lat NOT BETWEEN 6 AND 38 OR lng NOT BETWEEN 68 AND 98) AS outside, count(*) FILTER (WHERE k > 1 AND lat IS NOT NULL) AS shared FROM n GROUP BY provider""")
def dq_coordinate_audit(v):
    return quality.coordinate_audit(v.dense_stops)


@query("""WITH s AS (SELECT state, count(*) AS stops, count(lat) AS located FROM stops GROUP BY state), r AS (SELECT state, count(*) AS routes FROM routes GROUP BY state)
SELECT coalesce(s.state, r.state) AS state, coalesce(stops, 0) AS stops, coalesce(located, 0) AS located, coalesce(routes, 0) AS routes, CAST(CASE WHEN stops > 0 THEN floor(located * 10000 / stops) ELSE 0 END AS BIGINT) AS per_10000 FROM s FULL JOIN r ON s.state = r.state""")
def dq_coverage_report(v):
    return quality.coverage(v.stops, v.routes)


@query("""WITH l AS (SELECT provider, arg_max(status, (created_at, id)) AS last, max(created_at) AS synced FROM runs GROUP BY provider), s AS (SELECT CASE id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' ELSE 'other' END AS provider, count(*) AS stops, count(lat) AS located FROM stops GROUP BY ALL)
SELECT l.provider, coalesce(stops, 0) AS stops, coalesce(located, 0) AS located, CAST(0 AS BIGINT) AS raw, CASE WHEN last = 'RUNNING' THEN 'SYNCING' WHEN date_diff('day', CAST(synced AS DATE), DATE '2024-01-01') > 7 THEN 'STALE' WHEN coalesce(stops, 0) = 0 THEN 'DEGRADED' WHEN located * 5 < stops THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM l LEFT JOIN s USING (provider)""")
def dq_provider_health(v):
    kind = F.when(F.col("id") % 3 == 0, "click").when(F.col("id") % 3 == 1, "purchase").otherwise("other")
    age = F.datediff(F.lit("2024-01-01").cast("date"), F.col("synced").cast("date"))
    return quality.health(v.stops.withColumn("provider", kind), v.raw_records, v.runs, age)


@query("SELECT kind, count(*) AS n, array_to_string(list_sort(list(id) FILTER (WHERE k <= 20)), ',') AS examples FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM (SELECT id, CASE WHEN lat IS NULL THEN 'missing' WHEN lat NOT BETWEEN 22 AND 27 OR lng NOT BETWEEN 86 AND 89 THEN 'outside' END AS kind FROM stops) WHERE kind IS NOT NULL) GROUP BY kind")
def dq_gap_categories(v):
    return quality.gap_examples(v.stops)


@query("SELECT 'stops' AS metric, count(*) AS n FROM stops UNION ALL SELECT 'located', count(lat) FROM stops UNION ALL SELECT 'routes', count(*) FROM routes UNION ALL SELECT 'trips', count(*) FROM trips UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'timed', count(departs) FROM calls UNION ALL SELECT 'raw', count(*) FROM raw_records")
def dq_baseline_audit(v):
    return quality.counts({"s": (v.stops, {"stops": "*", "located": "lat"}), "r": (v.routes, {"routes": "*"}), "t": (v.trips, {"trips": "*"}), "c": (v.calls, {"calls": "*", "timed": "departs"}), "d": (v.raw_records, {"raw": "*"})})


@query("SELECT id, min(id) OVER (PARTITION BY name, state, CAST(floor(lat * 1000 + 0.5) AS BIGINT), CAST(floor(lng * 1000 + 0.5) AS BIGINT)) AS survivor FROM dense_stops")
def er_grid_canonical(v):
    return resolve.grid_survivors(v.dense_stops)


FIT = f"list_filter(w.heads, lambda h: (h.state = o.state OR h.state = '' OR o.state = '') AND {geo.distance_sql('o.lat', 'o.lng', 'h.lat', 'h.lng')} <= 150)"


@query(f"""WITH RECURSIVE busy AS (SELECT stop_id, count(*) AS n FROM calls GROUP BY stop_id), s AS (SELECT d.id, regexp_replace(lower(d.name), '[^a-z0-9]', '', 'g') AS k, coalesce(d.state, '') AS state, d.lat, d.lng, coalesce(busy.n, 0) AS services FROM dense_stops d LEFT JOIN busy ON busy.stop_id = d.id),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY services DESC, state = '', id) AS n FROM s),
w AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS survivor, CAST([] AS STRUCT(id BIGINT, state VARCHAR, lat DOUBLE, lng DOUBLE)[]) AS heads FROM o
UNION ALL SELECT o.k, o.n, o.id, CASE WHEN len({FIT}) = 0 THEN o.id ELSE {FIT}[1].id END, CASE WHEN len({FIT}) = 0 THEN list_append(w.heads, {{'id': o.id, 'state': o.state, 'lat': o.lat, 'lng': o.lng}}) ELSE w.heads END FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1)
SELECT id, survivor FROM w WHERE id IS NOT NULL""")
def er_cluster_greedy(v):
    busy = v.calls.groupBy("stop_id").agg(F.count("*").alias("services"))
    return resolve.cluster_greedy(v.dense_stops, busy)


@query("WITH k AS (SELECT id, row_number() OVER (PARTITION BY lower(name) ORDER BY lat IS NULL, id) AS n, first_value(id) OVER (PARTITION BY lower(name) ORDER BY lat IS NULL, id) AS survivor FROM stops) SELECT id, survivor, CASE WHEN n = 1 THEN 'ACTIVE' ELSE 'MERGED' END AS status FROM k")
def er_merge_by_name(v):
    return resolve.merge_by_name(v.stops)


@query("WITH u AS (SELECT DISTINCT stop_id FROM calls WHERE time_source = 'OFFICIAL') SELECT s.id, CASE WHEN u.stop_id IS NOT NULL THEN 'ACTIVE' WHEN lat IS NULL THEN 'PENDING' WHEN s.id % 365 > 180 THEN 'STALE' ELSE 'ORPHAN' END AS status FROM stops s LEFT JOIN u ON u.stop_id = s.id")
def er_orphan_lifecycle(v):
    return resolve.lifecycle(v.stops, v.calls.filter("time_source = 'OFFICIAL'"), F.col("id") % 365)


@query("SELECT DISTINCT p.id AS place, upper(s.name) AS alias FROM stops s JOIN places p ON p.name = s.name WHERE s.id % 2 = 0")
def er_seed_aliases(v):
    shouted = v.stops.filter("id % 2 = 0").withColumn("name", F.upper("name"))
    return resolve.seed_aliases(shouted, v.places)


@query("""WITH m AS (SELECT p.id AS place_id, s.id, s.lat, s.lng, s.id % 100 / 100e0 AS confidence, s.provider FROM places p JOIN stops s ON s.name = p.name WHERE s.lat IS NOT NULL),
b AS (SELECT place_id, arg_min({'lat': lat, 'lng': lng, 'c': confidence, 'p': provider}, (-confidence, id)) AS b FROM m GROUP BY place_id), o AS (SELECT id, 20e0 + id % 7 AS lat, 80e0 AS lng, CASE WHEN id % 3 <> 0 THEN id % 60 / 100e0 END AS confidence, 'OLD' AS source FROM places)
SELECT o.id, CASE WHEN up THEN b.lat ELSE o.lat END AS lat, CASE WHEN up THEN b.lng ELSE o.lng END AS lng, CASE WHEN up THEN b.c ELSE confidence END AS confidence, CASE WHEN up THEN b.p ELSE source END AS source, up AS upgraded FROM (SELECT o.*, b.b, coalesce(b.b.c > coalesce(o.confidence, 0), false) AS up FROM o LEFT JOIN b ON b.place_id = o.id) o""")
def er_resolve_places(v):
    """Places take the coordinates of the surest stop of their name, if it is surer than what they have."""
    i = F.col("id")
    old = v.places.select("id", (F.lit(20.0) + i % 7).alias("lat"), F.lit(80.0).alias("lng"), F.when(i % 3 != 0, i % 60 / 100.0).alias("confidence"), F.lit("OLD").alias("source"))
    matched = v.stops.join(v.places.select("name", F.col("id").alias("place_id")), "name").select("place_id", "id", "lat", "lng", (i % 100 / 100.0).alias("confidence"), "provider")
    return repair.upgrade_places(old, matched)


@query("""WITH a AS (SELECT *, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS rank FROM stops), m AS (SELECT name, state, arg_min(lat, ((lat IS NULL)::INT, rank, id)) FILTER (WHERE lat IS NOT NULL) AS lat, arg_min(lng, ((lng IS NULL)::INT, rank, id)) FILTER (WHERE lng IS NOT NULL) AS lng, array_to_string(list_sort(array_agg(DISTINCT provider)), ',') AS providers, count(*) AS records FROM a GROUP BY ALL)
SELECT *, CAST(least(99, 50 + CASE WHEN lat IS NULL THEN 0 ELSE 30 END + CASE WHEN records > 1 THEN 15 ELSE 0 END + CASE WHEN contains(providers, ',') THEN 5 ELSE 0 END) AS INTEGER) AS percent FROM m""")
def er_enrich_stops(v):
    return resolve.enrich(v.stops.filter("id % 2 = 0"), v.stops.filter("id % 2 <> 0"), ["name", "state"])


@query("SELECT c.trip_id, c.seq, c.stop_id, min(t.departs) AS departs FROM calls c JOIN stops s ON s.id = c.stop_id LEFT JOIN (SELECT trip_id, lower(name) AS k, departs FROM calls JOIN stops ON id = stop_id WHERE departs IS NOT NULL) t ON t.trip_id = c.trip_id AND t.k = lower(s.name) WHERE c.departs IS NULL GROUP BY c.trip_id, c.seq, c.stop_id, c.platform, c.time_source")
def er_backfill_by_name(v):
    names = v.stops.select(F.col("id").alias("stop_id"), F.lower("name").alias("k"))
    named = v.calls.join(names, "stop_id")
    times = named.filter("departs is not null").groupBy("trip_id", "k").agg(F.min("departs").alias("t"))
    return named.filter("departs is null").dropDuplicates(["trip_id", "seq", "stop_id", "platform", "time_source"]).join(times, ["trip_id", "k"], "left").select("trip_id", "seq", "stop_id", F.col("t").alias("departs"))


@query("""WITH r AS (SELECT id, CASE id % 4 WHEN 0 THEN agency || ' (Old) to ' || provider WHEN 1 THEN agency || ' - ' || provider || ' Suburban Railway' WHEN 2 THEN provider || ' to x to ' || lower(agency) ELSE long_name END AS name FROM routes WHERE id NOT IN (SELECT route_id FROM trips WHERE direction = 'P')),
e AS (SELECT id AS route_id, 1 AS sequence, CASE WHEN id % 4 = 2 THEN split_part(name, ' to ', 1) ELSE regexp_extract(name, '^(.*?)( \\(Old\\))?( to | - )', 1) END AS stop FROM r WHERE id % 4 <> 3 UNION ALL SELECT id, 2, replace(regexp_extract(name, '^.*( to | - )(.*)$', 2), ' Suburban Railway', '') FROM r WHERE id % 4 <> 3)
SELECT route_id, sequence, CAST(min(n_nationkey) AS INTEGER) AS stop_id, CASE WHEN min(n_nationkey) IS NULL THEN 'stop_' || replace(lower(stop), ' ', '_') END AS external_id FROM e LEFT JOIN nation ON lower(n_name) = lower(stop) GROUP BY route_id, sequence, stop""")
def er_fix_disconnected(v):
    """Routes without trips get the stops that their names tell: a nation's, or a new one."""
    i = F.col("id")
    name = F.when(i % 4 == 0, F.concat("agency", F.lit(" (Old) to "), "provider")).when(i % 4 == 1, F.concat("agency", F.lit(" - "), "provider", F.lit(" Suburban Railway"))).when(i % 4 == 2, F.concat("provider", F.lit(" to x to "), F.lower("agency"))).otherwise(F.col("long_name"))
    stops = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return repair.connect_routes(v.routes.select("id", name.alias("name")), v.trips.filter("direction = 'P'"), stops)[1]


@query("""WITH d AS (SELECT id, name, provider, CASE WHEN id % 10 <> 0 THEN lat + CASE WHEN id % 17 = 0 THEN 9 ELSE 0 END END AS lat, lng FROM dense_stops), shared AS (SELECT lat, lng FROM d WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT id, name, CASE WHEN lat IS NULL THEN 'missing' WHEN lat NOT BETWEEN 21.4e0 AND 27.3e0 OR lng NOT BETWEEN 85.7e0 AND 89.95e0 THEN 'outside' WHEN (lat, lng) IN (SELECT (lat, lng) FROM shared) THEN 'shared' END AS reason FROM d WHERE provider <> 'Brand#11')
SELECT id, name, reason, CAST(row_number() OVER (PARTITION BY reason ORDER BY name, id) AS INTEGER) AS rank FROM c WHERE reason IS NOT NULL""")
def er_coord_candidates(v):
    i = F.col("id")
    stops = v.dense_stops.withColumn("lat", F.when(i % 10 != 0, F.col("lat") + F.when(i % 17 == 0, 9).otherwise(0)))
    return repair.coordinate_candidates(stops, (21.4, 27.3, 85.7, 89.95), F.col("provider") == "Brand#11")


@query("SELECT trip_id, seq, stop_id, platform FROM calls WHERE trip_id NOT IN (SELECT id FROM trips WHERE route_id IN (SELECT id FROM routes WHERE agency = 'FRANCE' OR fare_inr < 5))")
def sink_cascade_delete(v):
    doomed = (F.col("agency") == "FRANCE") | (F.col("fare_inr") < 5)
    return relational.prune(v.routes, doomed, [(v.trips, "route_id"), (v.calls, "trip_id")])[2].select("trip_id", "seq", "stop_id", "platform")


OLD, NEW = "(SELECT id, long_name, provider, fare_inr FROM routes WHERE id % 3 <> 0)", "(SELECT id, upper(long_name) AS long_name, 'NEW' AS provider, fare_inr + 1 AS fare_inr FROM routes WHERE id % 2 = 0)"


@query(f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.long_name ELSE o.long_name END AS long_name, CASE WHEN o.id IS NULL THEN n.provider ELSE o.provider END AS provider, CASE WHEN n.id IS NOT NULL THEN n.fare_inr ELSE o.fare_inr END AS fare_inr FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def sink_upsert(v):
    some = v.routes.select("id", "long_name", "provider", "fare_inr")
    new = some.filter("id % 2 = 0").select("id", F.upper("long_name").alias("long_name"), F.lit("NEW").alias("provider"), (F.col("fare_inr") + 1).alias("fare_inr"))
    return relational.upsert(some.filter("id % 3 <> 0"), new, "id", ["long_name", "fare_inr"])


@query("SELECT trip_id, seq, stop_id, platform FROM calls WHERE trip_id NOT IN (SELECT trip_id FROM calls WHERE time_source = 'OFFICIAL') UNION ALL SELECT trip_id, seq, stop_id, platform FROM calls WHERE time_source = 'OFFICIAL'")
def sink_replace_children(v):
    rows = v.calls.select("trip_id", "seq", "stop_id", "platform")
    return relational.replace_children(rows, v.calls.filter("time_source = 'OFFICIAL'").select("trip_id", "seq", "stop_id", "platform"), "trip_id")


@query("SELECT r.id, coalesce(x.n, r.fare_inr) AS fare_inr FROM routes r LEFT JOIN (SELECT route_id, count(*) AS n FROM trips WHERE direction = 'F' GROUP BY route_id) x ON x.route_id = r.id")
def sink_update_from_values(v):
    values = v.trips.filter("direction = 'F'").groupBy(F.col("route_id").alias("id")).agg(F.count("*").alias("fare_inr"))
    return relational.update_values(v.routes.select("id", "fare_inr"), values, "id", "fare_inr")


@query("SELECT name, id FROM places WHERE id % 2 = 0 UNION ALL SELECT DISTINCT name, CAST(NULL AS BIGINT) FROM stops WHERE name NOT IN (SELECT name FROM places WHERE id % 2 = 0)")
def sink_find_or_create(v):
    return relational.find_or_create(v.places.filter("id % 2 = 0").select("name", "id"), v.stops.select("name"), "name")


@query("WITH k AS (SELECT provider, arg_max(content_hash, id) AS h FROM raw_records WHERE id % 2 = 0 GROUP BY provider) SELECT r.id, r.content_hash FROM raw_records r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.provider = r.provider AND k.h = r.content_hash)")
def lc_skip_unchanged(v):
    known = v.raw_records.filter("id % 2 = 0")
    return lifecycle.skip_unchanged(v.raw_records, known, ["provider"], "id").select("id", "content_hash")


@query("SELECT provider, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) AS total, count(*) FILTER (WHERE status = 'FAILED') > greatest(5, count(*) * 0.1) AS abort FROM runs GROUP BY provider")
def lc_failure_threshold(v):
    n = v.runs.groupBy("provider").agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count("*").alias("total"))
    return n.withColumn("abort", lifecycle.over_threshold(F.col("failed"), F.col("total")))


@query("SELECT trip_id, seq, stop_id, platform FROM calls WHERE trip_id IN (SELECT id FROM trips WHERE route_id IN (SELECT id FROM routes WHERE NOT (right(long_name, 1) IN ('1', '2') AND long_name <> 'Customer#000000021' AND id NOT IN (SELECT route_id FROM trips WHERE direction = 'P'))))")
def er_prune_experimental(v):
    """Routes of an experimental mark (here a last digit) without a trip in service go with what hangs on them, but for those on the list to keep."""
    gone = relational.experimental(v.routes, v.trips.filter("direction = 'P'"), F.right("long_name", F.lit(1)).isin("1", "2"), F.col("long_name").isin("Customer#000000021"))
    return relational.prune(gone, F.col("doomed"), [(v.trips, "route_id"), (v.calls, "trip_id")])[2].select("trip_id", "seq", "stop_id", "platform")


@query("SELECT trip_id, CASE WHEN n < 2 THEN 'TOO_SHORT' WHEN located < n THEN 'UNLOCATED' END AS reason FROM (SELECT c.trip_id, count(*) AS n, count(s.lat) AS located FROM calls c LEFT JOIN stops s ON s.id = c.stop_id GROUP BY c.trip_id) WHERE n < 2 OR located < n")
def lc_quarantine(v):
    s = v.stops.select(F.col("id").alias("stop_id"), "lat")
    trips = v.calls.join(s, "stop_id", "left").groupBy("trip_id").agg(F.count("*").alias("n"), F.count("lat").alias("located"))
    return lifecycle.quarantine(trips, [("TOO_SHORT", F.col("n") < 2), ("UNLOCATED", F.col("located") < F.col("n"))])[1].select("trip_id", "reason")


@query("SELECT 'NO_NAME' AS rule, 'ERROR' AS severity, count(*) FILTER (WHERE name = '') AS violations FROM stops UNION ALL SELECT 'UNLOCATED', 'WARNING', count(*) FILTER (WHERE lat IS NULL) FROM stops UNION ALL SELECT 'OUT_OF_BOX', 'WARNING', count(*) FILTER (WHERE lat > 27) FROM stops")
def lc_validate(v):
    return lifecycle.findings(v.stops, [("NO_NAME", "ERROR", F.col("name") == ""), ("UNLOCATED", "WARNING", F.col("lat").isNull()), ("OUT_OF_BOX", "WARNING", F.col("lat") > 27)])


@query("SELECT trip_id, seq, stop_id, platform, CASE WHEN time_source = 'OFFICIAL' THEN 'OFFICIAL' WHEN time_source = 'INTERPOLATED' THEN 'INTERPOLATED' WHEN departs IS NOT NULL THEN 'SCRAPED' END AS source FROM calls")
def lc_time_source(v):
    s = lifecycle.time_source(F.when(F.col("time_source") == "OFFICIAL", F.col("time_source")), F.col("time_source") == "INTERPOLATED", F.col("departs"))
    return v.calls.select("trip_id", "seq", "stop_id", "platform", s.alias("source"))


SERVE = "SELECT c.trip_id, CAST(row_number() OVER (PARTITION BY c.trip_id ORDER BY c.seq, c.stop_id, c.platform) AS BIGINT) AS stop_sequence, coalesce(m.survivor, c.stop_id) AS stop_id, r.agency FROM calls c JOIN trips t ON t.id = c.trip_id JOIN routes r ON r.id = t.route_id LEFT JOIN m ON m.id = c.stop_id"


@query(f"WITH m AS (SELECT id, min(id) OVER (PARTITION BY name, state, CAST(floor(lat * 1000 + 0.5) AS BIGINT), CAST(floor(lng * 1000 + 0.5) AS BIGINT)) AS survivor FROM dense_stops) {SERVE}")
def lc_project(v):
    from tramline.operators.timetable import resequence

    m = resolve.grid_survivors(v.dense_stops).filter("id <> survivor").select(F.col("id").alias("stop_id"), "survivor")
    t = v.trips.select(F.col("id").alias("trip_id"), "route_id").join(v.routes.select(F.col("id").alias("route_id"), "agency"), "route_id")
    return resequence(v.calls).join(t, "trip_id").join(m, "stop_id", "left").select("trip_id", F.col("pos").cast("bigint").alias("stop_sequence"), F.coalesce("survivor", "stop_id").alias("stop_id"), "agency")


UPDOWN = "SELECT route_id AS id, seq, name || ' ' || seq AS stop, CASE WHEN seq % 2 = 1 THEN 'u' || seq END AS up, CASE WHEN seq % 3 = 1 THEN 'd' || seq END AS down FROM patterns"


@query(f"WITH r AS ({UPDOWN}), n AS (SELECT *, max(seq) OVER (PARTITION BY id) AS n FROM r) SELECT id, 'UP' AS direction, seq, stop, up AS at FROM n UNION ALL SELECT id, 'DOWN', n + 1 - seq, stop, down FROM n")
def map_up_down(v):
    return mapping.up_down(_records(v))


def _records(v):
    s = F.col("seq")
    return v.patterns.select(F.col("route_id").alias("id"), "seq", F.concat_ws(" ", "name", s.cast("string")).alias("stop"), F.when(s % 2 == 1, F.concat(F.lit("u"), s.cast("string"))).alias("up"), F.when(s % 3 == 1, F.concat(F.lit("d"), s.cast("string"))).alias("down"))


@query(f"WITH r AS ({UPDOWN}), n AS (SELECT *, max(seq) OVER (PARTITION BY id) AS n FROM r), c AS (SELECT id, 'UP' AS direction, seq, stop, up AS at FROM n UNION ALL SELECT id, 'DOWN', n + 1 - seq, stop, down FROM n) SELECT id, direction, seq, stop, c.at FROM c WHERE (id, direction) IN (SELECT (id, direction) FROM c WHERE c.at IS NOT NULL) AND starts_with(stop, 'user')")
def map_detail_timetable(v):
    calls = mapping.up_down(_records(v))
    return mapping.timed_trips(calls, calls.filter(F.col("stop").startswith("user"))).select("id", "direction", "seq", "stop", "at")


@query("SELECT id, unnest([1, 2, 3]) AS seq, unnest([agency, provider, long_name]) AS stop, unnest(['07:15', NULL, NULL]) AS at, unnest([false, true, true]) AS estimated FROM routes")
def map_gov_routes(v):
    rows = mapping.via_rows(v.routes, F.col("agency"), F.concat(F.lit("via "), "provider", F.lit(", ")), F.col("long_name"), F.lit("07:15"))
    return rows.select("id", "seq", "stop", "at", "estimated")


@query(f"""WITH n AS (SELECT t.route_id, t.direction, t.id, count(*) AS n FROM trips t JOIN calls c ON c.trip_id = t.id GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT route_id, direction, arg_min(id, (-n, id)) AS trip_id FROM n GROUP BY ALL)
SELECT b.route_id, b.direction, p.stop_id, p.pos AS seq FROM b JOIN ({POS}) p USING (trip_id)""")
def map_gtfs(v):
    return mapping.gtfs_patterns(v.trips, v.calls).withColumn("seq", F.col("seq").cast("bigint"))


@query("SELECT CAST(id AS VARCHAR) AS stop_id, name, lat, lng FROM stops WHERE lat IS NOT NULL AND id % 4 IN (0, 1) AND id % 6 <> 5 AND id % 15 <> 14")
def map_gtfs_nodes(v):
    """Stops of an open feed with every kind of location, blanks around numbers, places that are none, and names of blanks."""
    i = F.col("id")
    kind = F.when(i % 8 == 0, "").when(i % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), (i % 4 - 1).cast("string")))
    lat = F.when(i % 6 == 5, "n/a").otherwise(F.concat(F.lit(" "), F.coalesce(F.col("lat").cast("string"), F.lit("")), F.lit(" ")))
    feed = v.stops.select(i.cast("string").alias("stop_id"), F.when(i % 15 == 14, "  ").otherwise(F.concat("name", F.lit(" "))).alias("stop_name"), lat.alias("stop_lat"), F.col("lng").cast("string").alias("stop_lon"), kind.alias("location_type"))
    return repair.feed_nodes(feed)


@query("WITH l AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k, provider AS line, min(id) AS seq FROM stops GROUP BY ALL) SELECT k, count(*) > 1 AS interchange, string_agg(line || ':' || seq, ',' ORDER BY line, seq) AS lines FROM l GROUP BY k")
def map_metro_interchange(v):
    return mapping.interchanges(v.stops.select("name", F.col("provider").alias("line"), F.col("id").alias("seq")))


@query("SELECT c.trip_id AS route_id, CAST(row_number() OVER (PARTITION BY c.trip_id ORDER BY CASE WHEN c.stop_id % 9 = 0 THEN 0 ELSE c.seq * 3 END, c.stop_id * 100 + c.platform) AS INTEGER) AS sequence, c.stop_id * 100 + c.platform AS station_id, s.name, s.lat, CASE WHEN s.lat IS NOT NULL THEN s.lng END AS lng FROM calls c JOIN stops s ON s.id = c.stop_id")
def map_api_route(v):
    """Stops of routes as an API tells them: orders with gaps or missing, blanks around names, 0,0 for no place."""
    at = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    told = v.calls.join(v.stops.select(F.col("id").alias("stop_id"), "name", "lat", "lng"), "stop_id")
    told = told.select(F.col("trip_id").alias("route_id"), (F.col("stop_id") * 100 + F.col("platform")).alias("station_id"), F.concat(F.lit(" "), "name").alias("name"), F.when(F.col("stop_id") % 9 != 0, F.col("seq") * 3).alias("route_order"), at("lat"), at("lng"))
    return repair.api_pattern(told)


@query("""WITH RECURSIVE c AS (SELECT trip_id, platform, seq, stop_id, CASE WHEN stop_id % 4 <> 0 THEN minute END AS arrives, CASE WHEN stop_id % 3 <> 0 THEN minute + stop_id % 7 END AS departs FROM calls),
n AS (SELECT trip_id, seq, stop_id, coalesce(arrives, departs) AS came, coalesce(departs, arrives) AS leaves, row_number() OVER (PARTITION BY trip_id ORDER BY seq, stop_id, coalesce(arrives, departs), coalesce(departs, arrives)) AS i FROM c WHERE arrives IS NOT NULL OR departs IS NOT NULL),
f AS (SELECT n.*, true AS kept, leaves AS last FROM n WHERE i = 1 UNION ALL SELECT n.*, n.came >= f.last, CASE WHEN n.came >= f.last THEN n.leaves ELSE f.last END FROM f JOIN n ON n.trip_id = f.trip_id AND n.i = f.i + 1)
SELECT trip_id AS vehicle, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY i) AS BIGINT) AS seq, stop_id, came AS arrives, leaves AS departs FROM f WHERE kept QUALIFY count(*) OVER (PARTITION BY trip_id) > 1""")
def map_vehicle_transpose(v):
    i = F.col("stop_id")
    calls = v.calls.select(F.col("trip_id").alias("vehicle"), F.lit(0).alias("started"), F.col("seq").alias("place"), "stop_id", F.when(i % 4 != 0, F.col("minute")).alias("arrives"), F.when(i % 3 != 0, F.col("minute") + i % 7).alias("departs"))
    return mapping.vehicle_runs(calls).select("vehicle", F.col("seq").cast("bigint").alias("seq"), "stop_id", "arrives", "departs")


@query("SELECT id, 'FLAT' AS kind, CAST(NULL AS INTEGER) AS to_seq, fare_inr AS amount FROM routes UNION ALL SELECT id, 'STAGE', 2, fare_inr // 2 FROM routes UNION ALL SELECT id, 'STAGE', 3, fare_inr + 1 FROM routes")
def map_operator_fares(v):
    f = F.col("fare_inr")
    return mapping.stage_fares(v.routes.select("id", f.alias("flat"), F.array(F.floor(f / 2).cast("bigint"), f + 1).alias("stages")))


@query("SELECT min(id) AS id, agency AS origin, provider AS destination FROM routes GROUP BY ALL")
def map_route_from_text(v):
    return mapping.routes_from_links(v.routes.select("id", F.concat("agency", F.lit(" to "), "provider").alias("label")))


@query("""WITH t AS (SELECT route_id, min(id) AS trip_id FROM trips GROUP BY route_id), st AS (SELECT t.route_id, string_agg(c.seq || ' ' || s.name || ' ' || coalesce(c.departs, '-'), '|' ORDER BY c.seq, s.name, c.departs NULLS FIRST) AS stops FROM t JOIN calls c ON c.trip_id = t.trip_id JOIN stops s ON s.id = c.stop_id GROUP BY t.route_id)
SELECT r.id, r.long_name AS name, r.agency AS operator, r.fare_inr AS fare, coalesce(st.stops, '') AS stops FROM routes r JOIN nation ON n_name = r.agency AND n_nationkey % 3 <> 1 LEFT JOIN st ON st.route_id = r.id WHERE r.fare_inr > 40""")
def src_operator_submitted(v):
    """Published routes of verified operators, with their stops in order: nations are the operators, a route's first trip has its stops."""
    operators = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 1, "PENDING").otherwise("VERIFIED").alias("status"))
    routes = v.routes.join(operators.select(F.col("id").alias("operator_id"), F.col("name").alias("agency")), "agency").select("id", F.col("long_name").alias("name"), "operator_id", F.when(F.col("fare_inr") > 40, "PUBLISHED").otherwise("DRAFT").alias("state"), F.col("fare_inr").alias("fare"))
    first = v.trips.groupBy("route_id").agg(F.min("id").alias("trip_id"))
    stops = v.calls.join(first, "trip_id").join(v.stops.select(F.col("id").alias("stop_id"), F.col("name").alias("stop_name")), "stop_id").select("route_id", F.col("seq").alias("sequence"), "stop_name", "departs")
    shown = F.array_join(F.transform("stops", lambda x: F.concat_ws(" ", x["sequence"].cast("string"), x["stop_name"], F.coalesce(x["departs"], F.lit("-")))), "|")
    return repair.submitted_routes(routes, operators, stops).select("id", "name", "operator", "fare", shown.alias("stops"))
