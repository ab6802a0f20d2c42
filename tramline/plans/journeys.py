"""Ways with their legs, repairs, versions and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.functions import geo, text, timeofday
from tramline.operators import journey, lifecycle, mapping, relational, search, timetable
from tramline.plans.pipelines import CUM, HOPS, ORIGIN, WALKS, _round, _walk
from tramline.plans.registry import query
from tramline.session import shared_dir
from tramline.streaming import landing


def _origin(v, stop: int = 1):
    return v.spark.range(stop, stop + 1).select(F.col("id").alias("stop_id"), F.lit(0).cast("bigint").alias("minutes"))


def _endpoints(v, keys, times: int, plus: int):
    """A point beside a stop for each of `keys` (query), with the stop's name: what a rider would ask for."""
    at = v.stops.select(((F.col("id") - plus) / times).alias("query"), "name", "lat", "lng")
    return keys.join(at, "query").select("query", (F.col("lat") + 0.002).alias("lat"), (F.col("lng") + 0.001).alias("lng"), F.lit(None).cast("bigint").alias("place_id"), F.array("name").alias("names"))


def _asked(v, table: str, key: str):
    keys = v.table(table).select(F.col(key).cast("bigint").alias("query"))
    return _endpoints(v, keys, 7, 1), _endpoints(v, keys, 11, 60)


def _network(v):
    return search.Network(v.calls, v.trips, v.stops)


def _fares(v):
    return v.routes.select("id", F.expr("nullif(fare_inr, 0)").alias("fare"))


AWAY = geo.distance_sql("e.lat", "e.lng", "s.lat", "s.lng")
HOP_D = geo.distance_sql("a.lat", "a.lng", "b.lat", "b.lng")
ASKED = f"""q AS (SELECT CAST(n_nationkey AS BIGINT) AS query FROM nation),
ep AS (SELECT query, 'o' AS side, name, lat + 0.002e0 AS lat, lng + 0.001e0 AS lng FROM q JOIN stops ON id = query * 7 + 1 UNION ALL SELECT query, 'd', name, lat + 0.002e0, lng + 0.001e0 FROM q JOIN stops ON id = query * 11 + 60),
nm AS (SELECT query, side, s.id, coalesce({AWAY}, 0) AS m, row_number() OVER (PARTITION BY query, side ORDER BY lower(s.name) <> lower(trim(e.name)), s.id) AS n FROM ep e JOIN stops s ON contains(lower(s.name), lower(trim(e.name)))),
cand AS (SELECT query, side, s.id, {AWAY} AS m FROM ep e JOIN stops s ON {AWAY} <= 1500 UNION SELECT query, side, id, m FROM nm WHERE n <= 12),
acc AS MATERIALIZED (SELECT query, side, id, m, CAST(CASE WHEN m > 0 THEN greatest(1, floor(m / 75 + 0.5)) ELSE 0 END AS BIGINT) AS minutes FROM cand QUALIFY m <= 1500 OR (min(m) OVER (PARTITION BY query, side) > 1500 AND row_number() OVER (PARTITION BY query, side ORDER BY m, id) = 1))"""


@query(f"WITH {ASKED} SELECT query, side, id AS stop_id, minutes FROM acc")
def graph_access_stops(v):
    """The stops at either end of each nation's pair: those near, and those of the name."""
    starts, ends = (search.access_stops(p, v.stops) for p in _asked(v, "nation", "n_nationkey"))
    return starts.withColumn("side", F.lit("o")).unionByName(ends.withColumn("side", F.lit("d")))


HOP_TYPE = 'STRUCT(frm BIGINT, "to" BIGINT, trip BIGINT, departs VARCHAR, arrives VARCHAR)'
RIDES = "on_ride AS MATERIALIZED (SELECT trip_id, segment, pos, stop_id, coalesce(departs, '') AS departs, sum(coalesce(hop_min, 0)) OVER (PARTITION BY trip_id, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM hops)"


def _search_round(n: int) -> str:
    """One ride and one walk from the labels l{n - 1}, with the hops so far in a list; gives l{n}."""
    old = f"l{n - 1}"
    return f"""s{n} AS (SELECT q.query, c.trip_id, c.stop_id, c.pos, c.departs, c.cum, min(CASE WHEN l.minutes IS NOT NULL THEN {{'k': l.minutes - c.cum, 'pos': c.pos, 'frm': c.stop_id, 'dep': c.departs}} END) OVER (PARTITION BY q.query, c.trip_id, c.segment ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM on_ride c CROSS JOIN q LEFT JOIN {old} l ON l.query = q.query AND l.stop_id = c.stop_id),
c{n} AS (SELECT query, stop_id, min({{'m': cum + 6 + b.k, 'frm': b.frm, 'trip': trip_id, 'fp': b.pos, 'tp': pos, 'dep': b.dep, 'arr': departs}}) AS b FROM s{n} WHERE b IS NOT NULL GROUP BY query, stop_id),
r{n} AS MATERIALIZED (SELECT c.query, c.stop_id, CAST(c.b.m AS BIGINT) AS minutes, list_append(p.path, CAST({{'frm': c.b.frm, 'to': c.stop_id, 'trip': c.b.trip, 'departs': nullif(c.b.dep, ''), 'arrives': nullif(c.b.arr, '')}} AS {HOP_TYPE})) AS path FROM c{n} c LEFT JOIN {old} l ON l.query = c.query AND l.stop_id = c.stop_id JOIN {old} p ON p.query = c.query AND p.stop_id = c.b.frm WHERE l.minutes IS NULL OR c.b.m < l.minutes),
k{n} AS MATERIALIZED (SELECT * FROM r{n} UNION ALL SELECT l.* FROM {old} l ANTI JOIN r{n} r ON r.query = l.query AND r.stop_id = l.stop_id),
w{n} AS (SELECT r.query, w.b AS stop_id, min({{'m': r.minutes + CAST(greatest(1, floor(w.metres / 75 + 0.5)) AS BIGINT), 'frm': w.a}}) AS b FROM r{n} r JOIN walks w ON w.a = r.stop_id GROUP BY ALL),
v{n} AS MATERIALIZED (SELECT w.query, w.stop_id, w.b.m AS minutes, list_append(p.path, CAST({{'frm': w.b.frm, 'to': w.stop_id, 'trip': NULL, 'departs': NULL, 'arrives': NULL}} AS {HOP_TYPE})) AS path FROM w{n} w LEFT JOIN k{n} k ON k.query = w.query AND k.stop_id = w.stop_id JOIN r{n} p ON p.query = w.query AND p.stop_id = w.b.frm WHERE k.minutes IS NULL OR w.b.m < k.minutes),
l{n} AS MATERIALIZED (SELECT * FROM v{n} UNION ALL SELECT k.* FROM k{n} k ANTI JOIN v{n} v ON v.query = k.query AND v.stop_id = k.stop_id)"""


@query(f"""WITH {HOPS}, {RIDES}, {WALKS}, {ASKED}, l0 AS MATERIALIZED (SELECT query, id AS stop_id, minutes, CAST([] AS {HOP_TYPE}[]) AS path FROM acc WHERE side = 'o'), {_search_round(1)}, {_search_round(2)}, {_search_round(3)},
g AS (SELECT query, arg_min(stop_id, (minutes, stop_id)) AS last_stop, arg_min(path, (minutes, stop_id)) AS path FROM l3 WHERE (query, stop_id) IN (SELECT (query, id) FROM acc WHERE side = 'd') GROUP BY query),
whole AS (SELECT trip_id, sum(coalesce(metres, 0)) AS whole FROM hops GROUP BY trip_id),
x AS (SELECT query, i, path[i] AS h FROM (SELECT query, path, unnest(range(1, len(path) + 1)) AS i FROM g)),
y AS (SELECT query, i, h.frm AS frm, h."to" AS to_stop, h.trip AS trip, h.departs AS departs, h.arrives AS arrives, coalesce({HOP_D}, 0) AS m, t.route_id, nullif(r.fare_inr, 0) AS fare, w.whole, coalesce(t.route_id = lag(t.route_id) OVER (PARTITION BY query ORDER BY i), false) AS again
  FROM x LEFT JOIN stops a ON a.id = h.frm LEFT JOIN stops b ON b.id = h."to" LEFT JOIN trips t ON t.id = h.trip LEFT JOIN routes r ON r.id = t.route_id LEFT JOIN whole w ON w.trip_id = h.trip),
z AS (SELECT *, sum((NOT again)::INT) OVER (PARTITION BY query ORDER BY i ROWS UNBOUNDED PRECEDING) AS part, greatest(1, floor(m / CASE WHEN trip IS NULL THEN 75 ELSE 22e0 * 1000 / 60 END + 0.5)) + CASE WHEN trip IS NOT NULL AND NOT again THEN 6 ELSE 0 END AS mins, CASE WHEN fare IS NULL THEN NULL WHEN coalesce(whole, 0) = 0 OR m >= whole THEN fare ELSE greatest(1, ceil(fare * (m / whole))) END AS part_fare FROM y),
legs AS (SELECT query, part, CASE WHEN min(trip) IS NULL THEN 'WALK' ELSE 'RIDE' END AS mode, arg_min(frm, i) AS from_stop, arg_max(to_stop, i) AS to_stop, min(route_id) AS route_id, CAST(floor(sum(m) + 0.5) AS BIGINT) AS metres, CAST(sum(mins) AS BIGINT) AS minutes, arg_min_null(departs, i) AS departs, arg_max(arrives, i) AS arrives, CAST(arg_min_null(part_fare, i) AS BIGINT) AS fare FROM z GROUP BY query, part),
ends AS (SELECT g.query, 0 AS part, NULL AS from_stop, coalesce(g.path[1].frm, g.last_stop) AS to_stop, 'o' AS side FROM g UNION ALL SELECT query, 1000000, last_stop, last_stop, 'd' FROM g),
far AS (SELECT ends.*, {AWAY} AS m FROM ends JOIN ep e ON e.query = ends.query AND e.side = ends.side JOIN stops s ON s.id = ends.to_stop),
every AS (SELECT * FROM legs UNION ALL SELECT query, part, 'WALK', from_stop, to_stop, NULL, CAST(floor(m + 0.5) AS BIGINT), CAST(greatest(1, floor(m / 75 + 0.5)) AS BIGINT), NULL, NULL, NULL FROM far WHERE m > 50)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY part) AS INTEGER) AS leg, mode, from_stop, to_stop, route_id, metres, minutes, departs, arrives, fare FROM every""")
def graph_reconstruct(v):
    """The legs of the best way for each nation's pair of endpoints, all found by one search."""
    return search.plan(*_asked(v, "nation", "n_nationkey"), _network(v), _fares(v))


@query()
def graph_alternatives(v):
    """Up to four ways for each region's pair of endpoints, ranked."""
    legs = search.alternatives(*_asked(v, "region", "r_regionkey"), _network(v), _fares(v))
    return search.ranked(search.totals(legs, ["query", "option"]))


@query(f"""WITH {HOPS}, {CUM}, {WALKS}, {ORIGIN}, r1 AS ({_round('l0')}), w1 AS ({_walk('r1')}), l1 AS (SELECT stop_id, min(minutes) AS minutes FROM (FROM l0 UNION ALL FROM r1 UNION ALL FROM w1) GROUP BY stop_id)
SELECT name, arg_min(id, (id % 5, minutes, id)) AS stop_id, CAST(arg_min(minutes, (id % 5, minutes, id)) AS BIGINT) AS minutes FROM l1 JOIN stops ON id = stop_id GROUP BY name""")
def graph_candidate_fallthrough(v):
    candidates = v.stops.select("name", F.col("id").alias("stop_id"), (F.col("id") % 5).alias("rank"))
    return journey.best_candidate(journey.reach(_origin(v), v.calls, v.stops, rounds=1), candidates)


D = geo.distance_sql("24.5", "87.9", "lat", "lng")


@query(f"WITH n AS (SELECT id, {D} AS d FROM stops WHERE lat IS NOT NULL ORDER BY {D}, id LIMIT 3) SELECT n.id, CAST(floor(n.d + 0.5) AS BIGINT) AS metres, count(r.id) AS routes FROM n LEFT JOIN routes r ON r.long_name LIKE '%' || (n.id % 10) GROUP BY ALL")
def graph_constant_multimodal(v):
    """The three nearest stops and the routes named after them; nothing is made up."""
    d = geo.distance_m(F.lit(24.5), F.lit(87.9), F.col("lat"), F.col("lng"))
    near = v.stops.filter("lat is not null").select("id", d.alias("d")).orderBy("d", "id").limit(3).withColumn("k", (F.col("id") % 10).cast("string"))
    per = v.routes.groupBy(F.right("long_name", F.lit(1)).alias("k")).agg(F.count("*").alias("n"))
    return near.join(per, "k", "left").select("id", F.floor(F.col("d") + 0.5).cast("bigint").alias("metres"), F.coalesce("n", F.lit(0)).alias("routes"))


@query("SELECT trip_id, seq, stop_id, departs FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_id, seq ORDER BY (CASE WHEN departs IS NOT NULL THEN 4 ELSE 0 END) + (CASE WHEN time_source = 'SCRAPED' THEN 1 ELSE 0 END) DESC, platform, departs NULLS LAST, time_source) AS n FROM calls) WHERE n = 1")
def er_time_cleanup(v):
    """Odd times first, then the repeats that cleaning makes equal."""
    odd = F.when(F.col("seq") % 2 == 0, F.concat("departs", F.lit(":00"))).otherwise(F.concat(F.lit(" "), F.col("departs")))
    clean = v.calls.withColumn("departs", odd).withColumn("departs", timeofday.normalise(F.col("departs")))
    return timetable.prefer(clean).select("trip_id", "seq", "stop_id", "departs")


@query("SELECT trip_id, seq, stop_id, platform FROM calls WHERE stop_id NOT IN (SELECT id FROM stops WHERE length(name) > 12 OR contains(name, 'Reg No'))")
def er_prune_garbage(v):
    garbage = (F.length("name") > 12) | F.contains("name", F.lit("Reg No"))
    return relational.prune(v.stops, garbage, [(v.calls, "stop_id")])[1].select("trip_id", "seq", "stop_id", "platform")


@query("SELECT s.id, p.id AS origin, q.id AS destination FROM stops s LEFT JOIN places p ON p.name = s.name LEFT JOIN places q ON q.name = CASE WHEN s.id % 2 = 0 THEN s.name END")
def er_repair_endpoints(v):
    """Ends from a scraped block, matched to places by name; no match stays null."""
    block = F.when(F.col("id") % 2 == 0, F.concat(F.lit("OP \n Reg No : X \n "), "name", F.lit(" ( "), "name", F.lit(" \n 9 )"))).otherwise(F.concat(F.lit("OP \n Reg No : X \n "), "name", F.lit(" \n")))
    _, a, b = text.recover_ends(block)
    ends = v.stops.select("id", a.alias("a"), b.alias("b"))
    place = lambda c, k: v.places.select(F.col("name").alias(c), F.col("id").alias(k))
    return ends.join(place("a", "origin"), "a", "left").join(place("b", "destination"), "b", "left").select("id", "origin", "destination")


@query("""WITH n AS (SELECT t.route_id, t.id, t.direction, count(*) AS n FROM trips t JOIN calls c ON c.trip_id = t.id WHERE t.direction IN ('O', 'F') GROUP BY ALL)
SELECT route_id, arg_min(id, (-n, direction = 'F', id)) AS trip_id, max(n) AS calls FROM n GROUP BY route_id""")
def er_enrich_routes(v):
    """A route takes the longer of the lists that its feeds have; on a tie the older feed's."""
    n = v.calls.groupBy(F.col("trip_id").alias("id")).agg(F.count("*").alias("n"))
    t = v.trips.filter("direction in ('O', 'F')").join(n, "id")
    return t.groupBy("route_id").agg(F.min_by("id", F.struct(-F.col("n"), F.col("direction") == "F", "id")).alias("trip_id"), F.max("n").alias("calls"))


@query("SELECT count(*) AS rows, CAST(sum(fare_inr + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fares_once, CAST(sum(fare_inr + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fares_twice, true AS same FROM routes")
def dq_idempotency(v):
    """What an upsert leaves after it has run once and twice."""
    some = v.routes.select("id", "long_name", "fare_inr")
    new = some.filter("id % 2 = 0").withColumn("fare_inr", F.col("fare_inr") + 1)
    once = relational.upsert(some, new, "id", ["fare_inr"])
    twice = relational.upsert(once, new, "id", ["fare_inr"])
    sums = [df.agg(F.count("*").alias(f"n{i}"), F.sum("fare_inr").alias(f"f{i}")).crossJoin(lifecycle.content_hash(df, ["id", "fare_inr"]).select(F.col("content_hash").alias(f"h{i}"))) for i, df in enumerate((once, twice))]
    return sums[0].crossJoin(sums[1]).select(F.col("n0").alias("rows"), F.col("f0").alias("fares_once"), F.col("f1").alias("fares_twice"), ((F.col("h0") == F.col("h1")) & (F.col("n0") == F.col("n1"))).alias("same"))  # one row each


@query("SELECT provider, count(*) AS harvested, count(*) FILTER (WHERE parsed > 0) AS timed, count(*) FILTER (WHERE parsed > 0) = 0 OR count(*) < 100 AS refused FROM runs GROUP BY provider")
def lc_refuse_shrink(v):
    return lifecycle.refuse_shrink(v.runs, "provider", F.col("parsed") > 0, 100)


@query("""WITH n AS (SELECT provider, id, created_at, row_number() OVER (PARTITION BY provider ORDER BY created_at, id) AS done, count(*) OVER (PARTITION BY provider) AS n, min(CASE WHEN status = 'FAILED' THEN (created_at, id) END) OVER (PARTITION BY provider) AS broke FROM runs),
saved AS (SELECT * FROM n WHERE (done % 25 = 0 OR done = n) AND (broke IS NULL OR (created_at, id) < broke))
SELECT 'saved' AS what, provider, id, done FROM saved UNION ALL SELECT 'rest', n.provider, n.id, n.done FROM n WHERE n.done > coalesce((SELECT max(done) FROM saved s WHERE s.provider = n.provider), 0)""")
def lc_checkpoint(v):
    """Each provider's runs break off at the first failure: the checkpoints they leave, and what the next start takes up."""
    order = ["created_at", "id"]
    n = v.runs.withColumn("done", F.row_number().over(W.partitionBy("provider").orderBy(*order)).cast("bigint"))
    broke = v.runs.filter("status = 'FAILED'").groupBy("provider").agg(F.min(F.struct(*order)).alias("broke"))
    saved = lifecycle.progress(v.runs, "provider", order).join(broke, "provider", "left").filter("broke is null or at < broke")
    again = lifecycle.rest(n, "provider", order, saved)
    return saved.select(F.lit("saved").alias("what"), "provider", "at.id", "done").unionByName(again.select(F.lit("rest").alias("what"), "provider", "id", "done"))


@query("SELECT provider, min(CASE WHEN status = 'FAILED' THEN id END) AS first_failure, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, arg_max(status, (created_at, id)) <> 'RUNNING' AS settled FROM runs GROUP BY provider")
def lc_run_order(v):
    """A failed run doesn't keep the others of its provider from completing."""
    return v.runs.groupBy("provider").agg(F.min(F.when(F.col("status") == "FAILED", F.col("id"))).alias("first_failure"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), (F.max_by("status", F.struct("created_at", "id")) != "RUNNING").alias("settled"))


@query("SELECT id, provider, content_hash, 'RAW_SAVED' AS status FROM raw_records")
def sink_append_raw(v):
    """Rows are appended once, however often they are sent: half of them, then all, then a third again."""
    folder = f"{shared_dir(v.spark)}/raw-{uuid.uuid4().hex}"
    rows = v.raw_records.select("id", "provider", "content_hash", F.lit("RAW_SAVED").alias("status"))
    for sent in (rows.filter("id % 2 = 0"), rows, rows.filter("id % 3 = 0")):
        landing.land(sent, folder, ["id"])
    return v.spark.read.parquet(folder)


@query("SELECT s.name, o.name IS NULL AS inserted FROM (SELECT DISTINCT name FROM stops) s LEFT JOIN (SELECT name FROM places WHERE id % 2 = 0) o ON o.name = s.name")
def sink_on_conflict(v):
    """Which wanted rows an upsert adds and which it updates."""
    old = v.places.filter("id % 2 = 0").select("name", F.lit(True).alias("old"))
    return v.stops.select("name").distinct().join(old, "name", "left").select("name", F.col("old").isNull().alias("inserted"))


@query("SELECT max(id) AS id, CASE WHEN provider = 'BUILDING' THEN agency ELSE state END AS origin, CASE WHEN provider = 'BUILDING' THEN state ELSE agency END AS destination FROM routes GROUP BY 2, 3")
def src_gov_route_table(v):
    """Column layouts differ by provider; of rows with one external id the last wins."""
    own = F.col("provider") == "BUILDING"
    rows = v.routes.select("id", F.when(own, F.col("agency")).otherwise(F.col("state")).alias("origin"), F.when(own, F.col("state")).otherwise(F.col("agency")).alias("destination"))
    return rows.groupBy(text.external_id("GOV", F.col("origin"), F.col("destination")).alias("k")).agg(F.max("id").alias("id"), F.max_by("origin", "id").alias("origin"), F.max_by("destination", "id").alias("destination")).drop("k")


@query("SELECT id, CASE id % 7 WHEN 2 THEN 'RAILWAY_STATION' WHEN 3 THEN 'METRO_STATION' WHEN 4 THEN 'METRO_STATION' WHEN 5 THEN 'FERRY_TERMINAL' WHEN 6 THEN 'TRAM_STOP' ELSE 'BUS_STOP' END AS node_type, CASE id % 3 WHEN 0 THEN 'T ' || name WHEN 1 THEN name ELSE 'OSM Stop ' || id END AS name, CASE id % 3 WHEN 0 THEN 't ' || lower(name) WHEN 1 THEN lower(name) ELSE 'osm stop ' || id END AS normal_name, CASE WHEN id % 2 = 0 THEN 'B' || id ELSE '' END AS aliases, coalesce(lat, 22.5726e0) AS lat, coalesce(lng, 88.3639e0) AS lng, 0.95e0 AS confidence FROM stops")
def src_osm(v):
    """Map elements of each kind, with a name among the tags, beside them or nowhere."""
    pairs = [("highway", "bus_stop"), ("public_transport", "platform"), ("railway", "station"), ("station", "subway"), ("railway", "subway_entrance"), ("amenity", "ferry_terminal"), ("railway", "tram_stop")]
    kinds = F.array(*[F.create_map(F.lit(k), F.lit(x)) for k, x in pairs])
    i, name = F.col("id"), F.col("name")
    tags = F.map_concat(F.get(kinds, (i % 7).cast("int")), F.create_map(F.lit("name"), F.when(i % 3 == 0, F.concat(F.lit("T "), name)), F.lit("name:bn"), F.when(i % 2 == 0, F.concat(F.lit("B"), i.cast("string"))), F.lit("alt_name"), F.lit("")))
    out = mapping.osm_nodes(v.stops.select("id", F.when(i % 3 == 1, name).alias("name"), tags.alias("tags"), "lat", F.col("lng").alias("lon")))
    return out.select("id", "node_type", "name", "normal_name", F.array_join("aliases", "|").alias("aliases"), "lat", "lng", "confidence")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'Nominatim Place ' || id WHEN id % 4 = 1 THEN name ELSE name || ', ' || state END AS name, CASE WHEN id % 2 = 0 THEN 'V' || id || '|S' || id ELSE 'T' || id END AS aliases, coalesce(lat, 0e0) AS lat, CASE WHEN lng IS NULL THEN 0e0 ELSE lng END AS lng, CASE WHEN id % 3 = 0 THEN 'OD' ELSE 'WB' END AS state, CASE WHEN id % 5 = 0 THEN 'D' || id ELSE 'C' || id END AS district, 'C' || id AS block, CASE WHEN id % 2 = 0 THEN 'V' || id ELSE 'T' || id END AS city FROM stops")
def src_nominatim(v):
    i = F.col("id")
    of = lambda letter, c: F.when(c, F.concat(F.lit(letter), i.cast("string")))
    address = F.create_map(F.lit("village"), of("V", i % 2 == 0), F.lit("town"), of("T", i % 2 != 0), F.lit("suburb"), of("S", i % 2 == 0), F.lit("county"), of("C", F.lit(True)), F.lit("state_district"), of("D", i % 5 == 0), F.lit("ISO3166-2-lvl4"), F.when(i % 3 == 0, "IN-OD"))
    shown = F.when(i % 4 >= 2, F.concat("name", F.lit(", "), "state"))
    rows = v.stops.select("id", shown.alias("display_name"), F.when(i % 4 == 1, F.col("name")).otherwise("").alias("name"), address.alias("address"), F.concat(F.col("lat").cast("string"), F.lit(" N")).alias("lat"), F.coalesce(F.col("lng").cast("string"), F.lit("none")).alias("lon"))
    return mapping.nominatim_nodes(rows).select("id", "name", F.array_join("aliases", "|").alias("aliases"), "lat", "lng", "state", "district", "block", "city")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'Village ' || id ELSE name END || CASE WHEN id % 2 = 0 THEN ' (' || provider || ' GP)' ELSE '' END AS name, CASE WHEN id % 3 = 0 THEN 'village ' || id ELSE lower(name) END AS normal_name, CASE WHEN id % 3 = 0 THEN 'Village ' || id ELSE name END || '|' || CASE WHEN id % 3 = 0 THEN 'Village ' || id ELSE name END || ' Village' AS aliases, coalesce(lat, 0e0) AS lat, state AS district, CASE WHEN id % 2 = 0 THEN provider END AS locality FROM stops")
def src_census(v):
    i = F.col("id")
    rows = v.stops.select("id", F.when(i % 3 != 0, F.col("name")).alias("village_name"), F.when(i % 2 == 0, F.col("provider")).otherwise("").alias("gp"), F.col("state").alias("district"), F.col("lat").cast("string").alias("lat"), F.col("lng").cast("string").alias("lon"))
    return mapping.census_nodes(rows).select("id", "name", "normal_name", F.array_join("aliases", "|").alias("aliases"), "lat", "district", "locality")


@query("SELECT id, 'datagov_' || id AS external_id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN provider ELSE 'OGD Infrastructure ' || id END AS name, coalesce(lat, 22.57e0) AS lat, coalesce(lng, 88.36e0) AS lng, 0.9e0 AS confidence FROM stops")
def src_datagov(v):
    i = F.col("id")
    rows = v.stops.select("id", F.when(i % 3 == 0, F.col("name")).otherwise("").alias("title"), F.when(i % 3 == 1, F.col("provider")).alias("facility_name"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))
    return mapping.portal_nodes(rows).select("id", "external_id", "name", "lat", "lng", "confidence")
