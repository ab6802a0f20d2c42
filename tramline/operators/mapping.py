"""From parsed provider records to the canonical model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.operators.relational import distinct_on


def up_down(records: DataFrame) -> DataFrame:
    """Rows (id, seq, stop, up, down) as calls of two patterns: UP in order, DOWN reversed with the other times."""
    n = F.max("seq").over(W.partitionBy("id"))
    up = records.select("id", F.lit("UP").alias("direction"), "seq", "stop", F.col("up").alias("at"))
    down = records.select("id", F.lit("DOWN").alias("direction"), (n + 1 - F.col("seq")).alias("seq"), "stop", F.col("down").alias("at"))
    return up.unionByName(down)


def timed_trips(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls of known stops in (id, direction) patterns with at least one time."""
    timed = calls.groupBy("id", "direction").agg(F.count("at").alias("n")).filter("n > 0").select("id", "direction")
    return calls.join(timed, ["id", "direction"], "left_semi").join(known.select("stop").distinct(), "stop", "left_semi")


def via_rows(routes: DataFrame, origin: Column, via: Column, destination: Column, starts: Column) -> DataFrame:
    """One row for each stop of "from, via, to"; the first one has the time, the others are estimated."""
    stops = F.posexplode(text.stop_list(origin, text.split_via(via), destination)).alias("pos", "stop")
    rows = routes.select("id", starts.alias("starts"), stops)
    first = F.col("pos") == 0
    return rows.select("id", (F.col("pos") + 1).alias("seq"), "stop", F.when(first, F.col("starts")).alias("at"), (~first).alias("estimated"))


def gtfs_patterns(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The longest trip of each (route, direction) as its pattern, in order and renumbered; shorter than two stops are left out."""
    sizes = stop_times.groupBy("trip_id").agg(F.count("*").alias("n")).filter("n >= 2")
    t = trips.join(sizes, F.col("trip_id") == F.col("id")).select("id", "route_id", "direction", "n")
    best = t.groupBy("route_id", "direction").agg(F.min_by("id", F.struct(-F.col("n"), "id")).alias("trip_id"))
    w = W.partitionBy("route_id", "direction").orderBy("seq", "stop_id", "platform")
    return stop_times.join(best, "trip_id").select("route_id", "direction", "stop_id", F.row_number().over(w).alias("seq"))


def interchanges(stations: DataFrame) -> DataFrame:
    """Stations of several lines (name, line, seq) by normalised name: the lines and whether there are more than one."""
    lines = stations.groupBy(text.alnum_space(F.col("name")).alias("k"), "line").agg(F.min("seq").alias("seq"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "seq"))), lambda x: F.concat_ws(":", x["line"], x["seq"].cast("string"))), ",")
    return lines.groupBy("k").agg((F.count("*") > 1).alias("interchange"), listed.alias("lines"))


def vehicle_runs(calls: DataFrame) -> DataFrame:
    """Calls by stop (vehicle, started, place, stop_id, arrives, departs) as runs of a vehicle: numbered, two calls at least.

    In the order of places, a call stays if it arrives no earlier than the last call that stayed departs; so one call
    that goes back is dropped, and those after it are held against the call before it. A call with one of the two times
    has it for both, one without any is left out. Times are any type in the order of time; after midnight they go on
    beyond 24 hours. A run's calls are folded in one row, as many as a vehicle makes on one run.
    """
    timed = calls.filter("arrives is not null or departs is not null")
    call = F.struct("place", "stop_id", F.coalesce("arrives", "departs").alias("at"), F.coalesce("departs", "arrives").alias("leaves"))
    runs = timed.groupBy("vehicle", "started").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    kinds = runs.schema["calls"].dataType.elementType
    start = F.struct(F.lit(None).cast(kinds["leaves"].dataType).alias("last"), F.filter("calls", lambda c: F.lit(False)).alias("kept"))

    def step(run: Column, c: Column) -> Column:
        stays = run["last"].isNull() | (c["at"] >= run["last"])
        return F.struct(F.when(stays, c["leaves"]).otherwise(run["last"]).alias("last"), F.when(stays, F.array_append(run["kept"], c)).otherwise(run["kept"]).alias("kept"))

    kept = runs.select("vehicle", "started", F.aggregate("calls", start, step)["kept"].alias("kept")).filter(F.size("kept") > 1)
    return kept.select("vehicle", "started", F.posexplode("kept").alias("i", "c")).select("vehicle", "started", (F.col("i") + 1).alias("seq"), "c.stop_id", F.col("c.at").alias("arrives"), F.col("c.leaves").alias("departs"))


def stage_fares(fares: DataFrame) -> DataFrame:
    """A flat fare, and a fare from the first stop to each later one: rows (id, kind, to_seq, amount)."""
    stages = F.explode(F.concat(F.array(F.struct(F.lit("FLAT").alias("kind"), F.lit(None).cast("int").alias("to_seq"), F.col("flat").alias("amount"))), F.transform("stages", lambda a, i: F.struct(F.lit("STAGE").alias("kind"), (i + 2).cast("int").alias("to_seq"), a.alias("amount")))))
    return fares.select("id", stages.alias("f")).select("id", "f.*").filter("amount is not null")


def routes_from_links(links: DataFrame) -> DataFrame:
    """Link texts "A to B", one of each in lower case, the first by id."""
    origin, destination = text.route_ends(F.col("label"))
    rows = links.withColumn("origin", origin).withColumn("destination", destination).filter("origin is not null").withColumn("k", text.route_key(F.col("origin"), F.col("destination")))
    return distinct_on(rows, ["k"], [F.col("id")]).select("id", "origin", "destination")


def api_trips(trips: DataFrame, calls: DataFrame) -> DataFrame:
    """Timed calls of each trip; of a trip without any, its first and last stop with the trip's own times.

    Calls without a stop are dropped, and so are trips of fewer than two calls that have no times.
    """
    known = calls.filter("stop_id is not null")
    at = F.struct("seq", "stop_id", "platform")
    ends = known.groupBy("trip_id").agg(F.count("at").alias("timed"), F.count("*").alias("n"), F.min_by("stop_id", at).alias("a"), F.max_by("stop_id", at).alias("b")).filter("timed = 0 and n >= 2")
    two = F.array(F.struct(F.col("a").alias("stop_id"), F.lit(1).cast("bigint").alias("seq"), F.col("starts").alias("at")), F.struct(F.col("b").alias("stop_id"), F.lit(2).cast("bigint").alias("seq"), F.col("ends").alias("at")))
    own = ends.join(trips, "trip_id").select("trip_id", F.explode(two).alias("c")).select("trip_id", "c.*").filter("at is not null")
    return known.filter("at is not null").select("trip_id", "stop_id", "seq", "at").unionByName(own)


def _first(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _some(*texts: Column) -> Column:
    return F.filter(F.array(*texts), lambda t: t.isNotNull() & (t != ""))


def _number(c: Column, default: float) -> Column:
    """The number that a text starts with; the default where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(default))


def _node(df: DataFrame, provider: str, kind: Column, name: Column, normal: Column, aliases: Column, lat: Column, lng: Column, confidence: float, **area: Column) -> DataFrame:
    low = F.trim(F.lower(normal))
    return df.select("id", F.lit(provider).alias("provider"), kind.alias("node_type"), name.alias("name"), low.alias("normal_name"), aliases.alias("aliases"), lat.alias("lat"), lng.alias("lng"), F.lit(confidence).alias("confidence"), *[c.alias(k) for k, c in area.items()])


# The codes of the open feeds, their confidence, and the place of records without one.
CITY = (22.5726, 88.3639)
PORTAL = (22.57, 88.36)


def osm_nodes(elements: DataFrame) -> DataFrame:
    """Map elements (id, name, tags, lat, lon) as nodes; the kind is that of the first tag that says one."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    kind = text.first_match(
        [
            ((tag("highway") == "bus_stop") | (tag("public_transport") == "platform"), "BUS_STOP"),
            (tag("railway") == "station", "RAILWAY_STATION"),
            ((tag("station") == "subway") | (tag("railway") == "subway_entrance"), "METRO_STATION"),
            (tag("amenity") == "ferry_terminal", "FERRY_TERMINAL"),
            (tag("railway") == "tram_stop", "TRAM_STOP"),
        ],
        "BUS_STOP",
    )
    name = _first(tag("name"), tag("name:en"), F.col("name"), F.concat(F.lit("OSM Stop "), F.col("id").cast("string")))
    return _node(elements, "OPENSTREETMAP", kind, name, name, _some(tag("name:bn"), tag("alt_name")), F.coalesce("lat", F.lit(CITY[0])), F.coalesce("lon", F.lit(CITY[1])), 0.95)


def nominatim_nodes(items: DataFrame) -> DataFrame:
    """Geocoder answers (id, display_name, name, address, and lat and lon as texts) as nodes with their area."""
    part = lambda k: F.try_element_at("address", F.lit(k))
    name = _first(F.col("display_name"), F.col("name"), F.concat(F.lit("Nominatim Place "), F.col("id").cast("string")))
    state = _first(F.regexp_replace(part("ISO3166-2-lvl4"), "^(.*?)IN-", "$1"), F.lit("WB"))
    return _node(items, "NOMINATIM", F.lit("BUS_STOP"), name, name, _some(*[part(k) for k in ("village", "town", "suburb", "healthcare")]), _number(F.col("lat"), 0.0), _number(F.col("lon"), 0.0), 0.92, state=state, district=_first(part("state_district"), part("county")), block=part("county"), city=_first(part("city"), part("town"), part("village")))


def census_nodes(rows: DataFrame) -> DataFrame:
    """Village directory rows (texts, with either feed's column names) as nodes; a village is named with its council."""
    has = lambda *names: _first(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    village = _first(has("village_name", "name"), F.concat(F.lit("Village "), F.col("id").cast("string")))
    council = has("gram_panchayat", "gp")
    name = F.when(council.isNotNull(), F.concat(village, F.lit(" ("), council, F.lit(" GP)"))).otherwise(village)
    return _node(rows, "CENSUS_INDIA", F.lit("BUS_STOP"), name, village, F.array(village, F.concat(village, F.lit(" Village"))), _number(F.col("lat"), 0.0), _number(F.col("lon"), 0.0), 0.98, district=has("district_name", "district"), block=has("subdistrict_name", "block"), locality=council)


def portal_nodes(rows: DataFrame) -> DataFrame:
    """Open-data portal rows (id, title, facility_name, latitude, longitude) as nodes."""
    name = _first(F.col("title"), F.col("facility_name"), F.concat(F.lit("OGD Infrastructure "), F.col("id").cast("string")))
    out = _node(rows, "DATA_GOV_INDIA", F.lit("BUS_STOP"), name, name, F.array().cast("array<string>"), F.coalesce("latitude", F.lit(PORTAL[0])), F.coalesce("longitude", F.lit(PORTAL[1])), 0.9)
    return out.withColumn("external_id", F.concat(F.lit("datagov_"), F.col("id").cast("string")))
