"""Repairs of a network: reconciling two lists, doubtful coordinates, routes without stops, better places, submitted routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.operators.quality import outside


def reconcile(seed: DataFrame, live: DataFrame, key: str, name: str, uses: str) -> DataFrame:
    """key, status and both names for every row of either list: STALE (only in `seed`), MISSING (only live), RENAMED or SAME; idle: live without any of its `uses`.

    Keys are taken once a list; a null name differs from any other.
    """
    s = seed.dropDuplicates([key]).select(key, F.col(name).alias("seed_name"), F.lit(True).alias("_s"))
    n = live.dropDuplicates([key]).select(key, F.col(name).alias("live_name"), F.col(uses).alias("_uses"), F.lit(True).alias("_l"))
    status = F.when(F.col("_l").isNull(), "STALE").when(F.col("_s").isNull(), "MISSING").when(~F.col("seed_name").eqNullSafe(F.col("live_name")), "RENAMED").otherwise("SAME")
    return s.join(n, key, "full").select(key, status.alias("status"), "seed_name", "live_name", F.coalesce((F.col("_uses") == 0) & F.col("_l"), F.lit(False)).alias("idle"))


def coordinate_candidates(stops: DataFrame, box: tuple[float, float, float, float], trusted: Column) -> DataFrame:
    """id, name, reason and rank of stops to be located again: without a place, outside the box, or on a point that several stops share.

    Points are shared among all stops, but those of `trusted` feeds aren't candidates. Ranks go by reason, name and id, over
    ranges of reason and name, so no task holds all.
    """
    both = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    shared = stops.filter(both).groupBy("lat", "lng").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = stops.filter(~F.coalesce(trusted, F.lit(False))).join(shared, ["lat", "lng"], "left")
    reason = F.when(~both, "missing").when(outside(box), "outside").when(F.col("_n") > 1, "shared")
    return rows.select("id", "name", reason.alias("reason")).filter("reason is not null").withColumn("rank", F.row_number().over(W.partitionBy("reason").orderBy("name", "id")))


def connect_routes(routes: DataFrame, linked: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New stops (external_id, name) and route stops (route_id, sequence, stop_id, external_id) for routes (id, name) that `linked` (route_id) lacks.

    A name "X to Y" or else "X - Y" gives the ends, the last part being the destination; brackets go, and "Suburban
    Railway" in the destination. An end is the stop of that name in any case, the smallest id first, or a new one, one for
    all routes that name it. Names of any other form give nothing.
    """
    lost = routes.join(linked.select(F.col("route_id").alias("id")).distinct(), "id", "left_anti")
    parts = F.when(F.contains("name", F.lit(" to ")), F.split("name", " to ")).when(F.contains("name", F.lit(" - ")), F.split("name", " - "))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"\s*\([^)]*\)\s*", ""))
    ends = F.array(bare(F.get(parts, F.lit(0))), F.trim(F.regexp_replace(bare(F.element_at(parts, -1)), r"(?i)\s*Suburban Railway\s*", "")))
    named = lost.select(F.col("id").alias("route_id"), F.posexplode(F.when(F.size(parts) > 1, ends)).alias("sequence", "stop")).withColumn("k", F.lower("stop"))
    known = stops.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("stop_id"))
    met = named.join(known, "k", "left")
    plain = F.trim(F.regexp_replace("k", r"[^a-z0-9\s]", ""))
    met = met.withColumn("external_id", F.when(F.col("stop_id").isNull(), F.concat(F.lit("stop_"), F.regexp_replace(plain, r"\s+", "_"))))
    new = met.filter("stop_id is null").groupBy("external_id").agg(F.min("stop").alias("name"))
    return new, met.select("route_id", (F.col("sequence") + 1).cast("int").alias("sequence"), "stop_id", "external_id")


def upgrade_places(places: DataFrame, matched: DataFrame) -> DataFrame:
    """`places` (id, lat, lng, confidence, source) with the coordinates of the surest of its `matched` stops (place_id, id, lat, lng, confidence, provider).

    Only a stop that is surer than the place itself counts; a place without confidence has 0. Ties go to the smaller id.
    """
    best = F.max_by(F.struct("lat", "lng", "confidence", "provider"), F.struct("confidence", -F.col("id"))).alias("b")
    won = matched.filter("lat is not null and lng is not null").groupBy("place_id").agg(best).select("place_id", "b")
    up = F.coalesce(F.col("b.confidence") > F.coalesce("confidence", F.lit(0.0)), F.lit(False))
    pick = lambda new, old: F.when(F.col("up"), F.col(new)).otherwise(F.col(old)).alias(old)
    rows = places.join(won, places["id"] == won["place_id"], "left").withColumn("up", up)
    return rows.select("id", pick("b.lat", "lat"), pick("b.lng", "lng"), pick("b.confidence", "confidence"), pick("b.provider", "source"), F.col("up").alias("upgraded"))


def submitted_routes(routes: DataFrame, operators: DataFrame, stops: DataFrame) -> DataFrame:
    """Published routes of verified operators: id, name, operator, fare, stops (an array in order), content_hash of the whole record.

    routes has id, name, operator_id, state, fare; operators id, name, status; stops route_id, sequence, stop_name, departs.
    A route's stops are as many as one route has; a route without stops has an empty list.
    """
    ok = operators.filter("status = 'VERIFIED'").select(F.col("id").alias("operator_id"), F.col("name").alias("operator"))
    listed = stops.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "stop_name", "departs"))).alias("stops"))
    kind = listed.schema["stops"].dataType
    rows = routes.filter("state = 'PUBLISHED'").join(ok, "operator_id").join(listed.withColumnRenamed("route_id", "id"), "id", "left").withColumn("stops", F.coalesce("stops", F.array().cast(kind)))
    record = F.to_json(F.struct("id", "name", "operator", "fare", "stops"))
    return rows.select("id", "name", "operator", "fare", "stops", F.sha2(record, 256).alias("content_hash"))


def api_pattern(stops: DataFrame) -> DataFrame:
    """Stops of an API's routes (route_id, station_id, name, route_order) numbered from 1 without gaps; a missing order counts as 0, names are trimmed, 0,0 is no place."""
    w = W.partitionBy("route_id").orderBy(F.coalesce("route_order", F.lit(0)), "station_id")
    at = lambda c: F.when(~((F.col("lat") == 0) & (F.col("lng") == 0)), F.col(c)).alias(c)
    return stops.select("route_id", F.row_number().over(w).alias("sequence"), "station_id", F.trim("name").alias("name"), at("lat"), at("lng"))


def feed_nodes(stops: DataFrame) -> DataFrame:
    """Boardable stops of an open feed, all of whose columns are text: location_type empty, missing or 0, both coordinates numbers on the globe, a name."""
    lat, lng = F.expr("try_cast(trim(stop_lat) as double)"), F.expr("try_cast(trim(stop_lon) as double)")
    rows = stops.select("stop_id", F.trim("stop_name").alias("name"), lat.alias("lat"), lng.alias("lng"), F.coalesce(F.trim("location_type"), F.lit("")).alias("kind"))
    return rows.filter("kind in ('', '0') and name <> '' and lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng)").drop("kind")
