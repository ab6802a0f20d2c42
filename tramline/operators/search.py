"""Journeys between many pairs of endpoints at once, with the way, its legs and its alternatives.

Labels are keyed by query and stop, so one search serves all queries. A round is one ride and then one walk. What each
half-round lowers is kept as a row of predecessors: (query, stop, step) with the stop it came from and the call it rode.
Steps are odd for rides, even for walks, 0 at the origin, and a way is walked back from its end by joins, one for
each half-round: the label that a row came from is the latest one before its own step. Nothing that grows with a way
travels through the rounds, and nothing comes to the driver.
"""

from __future__ import annotations

import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.functions.geo import distance_m
from tramline.operators.journey import ACCESS_M, BOARD_MIN, BUS_KMH, WALK_KMH, WALK_M, Walks, hops, walked
from tramline.operators.relational import top_n
from tramline.operators.spatial import Bands
from tramline.operators.timetable import hop_metres
from tramline.session import cut, remove_path, shared_dir

ROUNDS, OPTIONS, NAMES, SHORT_WALK_M = 3, 4, 12, 50
HELD = 500_000  # stops or trips that are broadcast to keep other rows out of a shuffle
GRAM = 3  # characters by which a name is looked for inside others


def minutes_of(metres: Column, kmh: float) -> Column:
    return F.greatest(F.lit(1), F.floor(metres / (kmh * 1000 / 60) + 0.5)).cast("bigint")


def stops_by_name(wanted: DataFrame, stops: DataFrame, most: int = NAMES) -> DataFrame:
    """query and stop_id: for each row of `wanted` (query, name), up to `most` stops of that name, then of one that holds it, by id.

    A name meets the names that share its first GRAM characters anywhere, so nothing is compared that has none in
    common; blanks and empty names find nothing. Only distinct names are cut into pieces, and of each at most `most` stops go on.
    """
    needle = F.lower(F.trim("name"))
    w = wanted.select("query", needle.alias("needle")).filter("needle <> ''").distinct().withColumn("gram", F.substring("needle", 1, GRAM))
    low = F.col("low")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - n + 1)), lambda i: F.substring(low, i, n))))
    named = stops.select(F.col("id").alias("stop_id"), F.lower("name").alias("low"))
    names = named.select("low").distinct().select("low", F.explode(F.array_distinct(pieces)).alias("gram"))
    met = w.join(names.hint("merge"), "gram").filter(F.contains("low", "needle")).select("query", "needle", "low")
    few = top_n(named, ["low"], [F.col("stop_id")], most)
    return top_n(met.join(few.hint("merge"), "low"), ["query", "needle"], [F.col("low") != F.col("needle"), F.col("stop_id")], most).select("query", "stop_id")


def access_stops(points: DataFrame, stops: DataFrame, most_m: float = ACCESS_M, links: DataFrame | None = None) -> DataFrame:
    """query, stop_id, minutes: where each of `points` (query, lat, lng, place_id, names) can be boarded or left.

    Candidates are the stops linked to the place (`links`: place_id, stop_id), those within `most_m`, and those of its
    names. A walk that can't be measured counts as none. Candidates beyond `most_m` go unless there is no other; then the
    nearest of them stays. Points without any candidate have no row.
    """
    bands = Bands(most_m)
    located = stops.filter("lat is not null and lng is not null")
    p = points.filter("lat is not null and lng is not null").select("query", F.explode(bands.near(F.col("lat"), F.col("lng"))).alias("c")).select("query", "c.y", "c.x")
    near = p.join(located.select(F.col("id").alias("stop_id"), bands.band(F.col("lat")).alias("y"), "lng").withColumn("x", bands.cell(F.col("lng"), F.col("y"))).hint("merge"), ["y", "x"]).select("query", "stop_id")
    named = stops_by_name(points.select("query", F.explode("names").alias("name")), stops)
    tagged = points.select("query", "place_id").join(links, "place_id").select("query", "stop_id") if links is not None else None
    where = points.select("query", F.col("lat").alias("lat_q"), F.col("lng").alias("lng_q"))
    at = stops.select(F.col("id").alias("stop_id"), "lat", "lng")

    def measured(rows: DataFrame) -> DataFrame:
        return rows.join(where, "query").join(at.hint("merge"), "stop_id").withColumn("m", F.coalesce(distance_m(F.col("lat_q"), F.col("lng_q"), F.col("lat"), F.col("lng")), F.lit(0.0))).select("query", "stop_id", "m")

    both = measured(near).filter(F.col("m") <= most_m).unionByName(measured(named if tagged is None else named.unionByName(tagged))).distinct()
    both = cut(both)
    best = both.groupBy("query").agg(F.min(F.struct("m", "stop_id")).alias("b"))
    kept = both.join(best, "query").filter((F.col("m") <= most_m) | (F.col("stop_id") == F.col("b.stop_id")) & (F.col("b.m") > most_m))
    return kept.select("query", "stop_id", F.when(F.col("m") > 0, minutes_of(F.col("m"), WALK_KMH)).otherwise(0).cast("bigint").alias("minutes"))


class Network:
    """What all rounds read, written once: rides with running minutes (packed, in a folder that goes with the network), walks both ways."""

    def __init__(self, calls: DataFrame, trips: DataFrame, stops: DataFrame, walk_m: float = WALK_M):
        spark, folder = calls.sparkSession, f"{shared_dir(calls.sparkSession)}/rides-{uuid.uuid4().hex}"
        weakref.finalize(self, remove_path, spark, folder).atexit = False
        running = F.sum(F.coalesce("hop_min", F.lit(0))).over(W.partitionBy("trip_id", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        on = hops(calls, stops).join(trips.select(F.col("id").alias("trip_id"), "route_id").hint("merge"), "trip_id")
        on.select("trip_id", "route_id", "segment", "pos", "stop_id", "departs", running.alias("cum")).write.parquet(folder)
        self.ride = spark.read.parquet(folder)
        self.walks = Walks(stops, walk_m).written()
        self.stops, self.calls = stops, calls

    def around(self, at: DataFrame) -> DataFrame:
        """`at` (query, stop_id) and the stops from which a walk leads there."""
        places = at.join(self.walks.at.hint("merge"), "stop_id").select("query", "lat", "lng").distinct()
        near = places.join(self.walks.pairs.hint("merge"), (F.col("lat") == F.col("lat_a")) & (F.col("lng") == F.col("lng_a"))).select("query", F.col("lat_b").alias("lat"), F.col("lng_b").alias("lng"))
        return at.unionByName(places.unionByName(near).distinct().join(self.walks.at.hint("merge"), ["lat", "lng"]).select("query", "stop_id")).distinct()

    def trips_at(self, at: DataFrame) -> DataFrame:
        """query, trip_id, route_id and segment of the rides that call at the stops of `at` (query, stop_id)."""
        calls = _held(self.ride.select("stop_id", "trip_id", "route_id", "segment"), at, "stop_id")
        return at.join(calls.hint("merge"), "stop_id").select("query", "trip_id", "route_id", "segment").distinct()

    def calls_of(self, touched: DataFrame) -> DataFrame:
        """The calls of the rides `touched` (query, trip_id, route_id, segment), for each query that rides them."""
        return touched.join(_held(self.ride.drop("route_id"), touched, "trip_id").hint("merge"), ["trip_id", "segment"])


def _held(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """`rows` whose key `wanted` has, before they are shuffled: only if there are at most HELD keys, which are then broadcast; else all."""
    keys = cut(wanted.select(key).distinct())
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() <= HELD else rows


def _lowered(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """The best candidate of each query and stop, where it is below the label."""
    best = candidates.groupBy("query", "stop_id").agg(F.min("c").alias("c"))
    old = labels.select("query", "stop_id", F.col("minutes").alias("old"))
    return best.join(old, ["query", "stop_id"], "left").filter("old is null or c.minutes < old").select("query", "stop_id", "c.*")


def _best(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select("query", "stop_id", "minutes") for t in tables]).groupBy("query", "stop_id").agg(F.min("minutes").alias("minutes"))


def search(starts: DataFrame, net: Network, rounds: int = ROUNDS, banned: DataFrame | None = None, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels (query, stop_id, minutes) and predecessors (query, stop_id, step, minutes, frm, trip_id, route_id, from_pos, to_pos, departs, arrives).

    `starts` has query, stop_id and minutes; `banned` has query and route_id of routes that a query may not ride. In a
    round only trips through stops that the round before lowered are ridden; on a trip, each query has a running minimum of
    its places to board, so no pair of calls is made. Ties go to the earlier place to board, then to smaller ids.

    With `ends` (query, stop_id) only the ways to those are looked for: the last round rides only what calls at one of them or a walk away,
    and of the round before only what is boarded there, or is an end, goes on. Ways to the ends are the same; other labels aren't all lowered.
    """
    labels = frontier = cut(_best(starts))
    nothing = {c: F.lit(None).cast(t) for c, t in (("frm", "bigint"), ("trip_id", "bigint"), ("route_id", "bigint"), ("from_pos", "int"), ("to_pos", "int"), ("departs", "string"), ("arrives", "string"))}
    found = [labels.withColumns({"step": F.lit(0), **nothing})]
    goal = kept = final = before = None
    if ends is not None:
        goal = cut(ends.select("query", "stop_id").distinct())
        final = cut(net.around(goal))
        last = cut(net.trips_at(final))
        kept = cut(net.calls_of(last).select("query", "stop_id").unionByName(goal).distinct())
        before = cut(net.around(kept))
    for number in range(1, rounds + 1):
        left = rounds - number if ends is not None else None
        touched = last if left == 0 else net.trips_at(frontier)
        if banned is not None:
            touched = touched.join(banned, ["query", "route_id"], "left_anti")
        on = net.calls_of(touched if left == 0 and banned is None else cut(touched)).join(labels, ["query", "stop_id"], "left")
        start = F.when(F.col("minutes").isNotNull(), F.struct((F.col("minutes") - F.col("cum")).alias("k"), "pos", "stop_id", "departs"))
        best = F.min(start).over(W.partitionBy("query", "trip_id", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
        at = on.withColumn("b", best).filter("b is not null")
        ridden = F.struct((F.col("cum") + BOARD_MIN + F.col("b.k")).alias("minutes"), F.col("b.stop_id").alias("frm"), "trip_id", F.col("b.pos").alias("from_pos"), F.col("pos").alias("to_pos"), "route_id", F.col("b.departs").alias("departs"), F.col("departs").alias("arrives"))
        lowered = _lowered(at.select("query", "stop_id", ridden.alias("c")), labels)
        rides = cut(lowered if left not in (0, 1) else lowered.join((before if left else final).hint("merge"), ["query", "stop_id"], "left_semi"))
        labels = cut(_best(labels, rides))
        lowered = _lowered(walked(rides.select("query", "stop_id", "minutes"), net.walks, ("query",)), labels)
        walks = cut(lowered if left not in (0, 1) else lowered.join((kept if left else goal).hint("merge"), ["query", "stop_id"], "left_semi"))
        labels = cut(_best(labels, walks))
        found += [rides.withColumn("step", F.lit(2 * number - 1)), walks.withColumns({"step": F.lit(2 * number)} | {k: v for k, v in nothing.items() if k != "frm"})]
        if number == rounds:
            break
        frontier = cut(rides.select("query", "stop_id").unionByName(walks.select("query", "stop_id")).distinct())
    return labels, cut(reduce(DataFrame.unionByName, found))


def walk_back(labels: DataFrame, before: DataFrame, ends: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """For each query its best of `ends` (query, stop_id): goals (query, first_stop, last_stop, minutes), and the hops on the way there."""
    goals = cut(labels.join(ends.select("query", "stop_id").distinct(), ["query", "stop_id"]).groupBy("query").agg(F.min(F.struct("minutes", "stop_id")).alias("g")).select("query", F.col("g.stop_id").alias("stop_id"), F.col("g.minutes").alias("minutes")))
    at, parts, first = goals.select("query", "stop_id", F.lit(2 * rounds).alias("bound")), [], []
    row = F.struct("step", "stop_id", "frm", "trip_id", "route_id", "from_pos", "to_pos", "departs", "arrives")
    for _ in range(2 * rounds + 1):  # a step less with each row
        came = cut(at.join(before, ["query", "stop_id"]).filter("step <= bound").groupBy("query").agg(F.max(row).alias("r")).select("query", "r.*"))
        first.append(came.filter("step = 0").select("query", F.col("stop_id").alias("first_stop")))
        came = came.filter("step > 0")
        parts.append(came)
        at = came.select("query", F.col("frm").alias("stop_id"), (F.col("step") - 1).alias("bound"))
    goals = goals.join(reduce(DataFrame.unionByName, first), "query").select("query", "first_stop", F.col("stop_id").alias("last_stop"), "minutes")
    return cut(goals), cut(reduce(DataFrame.unionByName, parts).withColumnRenamed("stop_id", "to"))


def legs_of(goals: DataFrame, way: DataFrame, origins: DataFrame, targets: DataFrame, net: Network, routes: DataFrame) -> DataFrame:
    """query, leg (from 1), mode, from_stop, to_stop, route_id, metres, minutes, departs, arrives, fare.

    Hops that go on with the same route are one leg, which keeps the first hop's departure and fare, takes the last known
    arrival, and boards once. A leg's minutes come from its distance; a hop that can't be measured has none, and takes a minute.
    Walks of more than SHORT_WALK_M to the first stop and from the last one are legs. A fare is the route's share of
    the distance ridden, in whole units, one at least; all of it beyond the trip's own length; none if the route has none.
    """
    at = lambda c, k: net.stops.select(F.col("id").alias(c), F.col("lat").alias(f"lat_{k}"), F.col("lng").alias(f"lng_{k}")).hint("merge")
    m = F.coalesce(distance_m(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")), F.lit(0.0))
    ride, speed = F.col("trip_id").isNotNull(), F.when(F.col("trip_id").isNotNull(), BUS_KMH).otherwise(WALK_KMH)
    mine = way.filter("trip_id is not null").select("trip_id").distinct()
    lengths = hop_metres(net.calls.join(mine, "trip_id", "left_semi"), net.stops).groupBy("trip_id").agg(F.sum(F.coalesce("metres", F.lit(0.0))).alias("whole"))
    hop = way.join(at("frm", "a"), "frm", "left").join(at("to", "b"), "to", "left").withColumn("m", m).join(lengths, "trip_id", "left").join(routes.select(F.col("id").alias("route_id"), F.col("fare").alias("all")), "route_id", "left")
    share = F.when((F.coalesce("whole", F.lit(0.0)) == 0) | (F.col("m") >= F.col("whole")), F.col("all")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("all") * (F.col("m") / F.col("whole")))))
    hop = hop.withColumn("fare", F.when(F.col("all").isNotNull(), share).cast("bigint"))
    steps = W.partitionBy("query").orderBy("step")
    again = F.coalesce(F.col("route_id") == F.lag("route_id").over(steps), F.lit(False))
    hop = hop.withColumn("again", again).withColumn("part", F.sum((~F.col("again")).cast("int")).over(steps.rowsBetween(W.unboundedPreceding, 0)))
    hop = hop.withColumn("min", F.greatest(F.lit(1), F.floor(F.col("m") / (speed * 1000 / 60) + 0.5)).cast("bigint") + F.when(ride & ~F.col("again"), BOARD_MIN).otherwise(0))
    main = hop.groupBy("query", "part").agg(
        F.min_by(F.struct("frm", "departs", "fare", "route_id"), "step").alias("f"), F.max_by("to", "step").alias("to_stop"), F.max_by("arrives", F.when(F.col("arrives").isNotNull(), F.col("step"))).alias("arrives"),
        F.floor(F.sum("m") + 0.5).cast("bigint").alias("metres"), F.sum("min").alias("minutes"),
    )
    main = main.select("query", F.col("part").cast("int").alias("part"), F.when(F.col("f.route_id").isNotNull(), "RIDE").otherwise("WALK").alias("mode"), F.col("f.frm").alias("from_stop"), "to_stop", F.col("f.route_id").alias("route_id"), "metres", "minutes", F.col("f.departs").alias("departs"), "arrives", F.col("f.fare").alias("fare"))

    def walk(points: DataFrame, stop: str, part: int) -> DataFrame:
        ends = goals.select("query", F.col(stop).alias("s")).join(points.select("query", F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a")), "query").join(at("s", "b"), "s").withColumn("m", m).filter(F.col("m") > SHORT_WALK_M)
        none = lambda t: F.lit(None).cast(t)
        return ends.select("query", F.lit(part).alias("part"), F.lit("WALK").alias("mode"), (none("bigint") if part == 0 else F.col("s")).alias("from_stop"), F.col("s").alias("to_stop"), none("bigint").alias("route_id"), F.floor(F.col("m") + 0.5).cast("bigint").alias("metres"), minutes_of(F.col("m"), WALK_KMH).alias("minutes"), none("string").alias("departs"), none("string").alias("arrives"), none("bigint").alias("fare"))

    every = walk(origins, "first_stop", 0).unionByName(main).unionByName(walk(targets, "last_stop", 1 << 20))
    return every.withColumn("leg", F.row_number().over(W.partitionBy("query").orderBy("part"))).drop("part")


def plan(origins: DataFrame, targets: DataFrame, net: Network, routes: DataFrame, rounds: int = ROUNDS, banned: DataFrame | None = None, stops: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """legs_of() the best way of each query that has one; `origins` and `targets` have query, lat, lng, place_id, names.

    A query whose best way has no hop and no walk has no leg. `routes` has id and fare.
    """
    starts, ends = stops or (access_stops(origins, net.stops), access_stops(targets, net.stops))
    return cut(legs_of(*walk_back(*search(starts, net, rounds, banned, ends), ends, rounds), origins, targets, net, routes))


def alternatives(origins: DataFrame, targets: DataFrame, net: Network, routes: DataFrame, most: int = OPTIONS, rounds: int = ROUNDS) -> DataFrame:
    """The legs of up to `most` ways of each query, each without the routes that its earlier ones ride first: legs_of() with option (order found).

    A query ends where it has no way, no ride, or the routes of an earlier way again.
    """
    starts, ends = cut(access_stops(origins, net.stops)), cut(access_stops(targets, net.stops))
    banned, seen, out = None, None, []
    for option in range(1, most + 1):
        legs = plan(origins, targets, net, routes, rounds, banned, (starts, ends))
        sign = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leg", F.coalesce(F.col("route_id").cast("string"), F.lit("walk")).alias("r")))), lambda x: x["r"]), ">")  # a way has few legs
        ways = legs.groupBy("query").agg(sign.alias("sign"), F.min_by("route_id", F.when(F.col("route_id").isNotNull(), F.col("leg"))).alias("route_id"))
        fresh = cut(ways if seen is None else ways.join(seen, ["query", "sign"], "left_anti"))
        out.append(legs.join(fresh.select("query"), "query", "left_semi").withColumn("option", F.lit(option)))
        more = fresh.filter("route_id is not null").select("query", "route_id")
        if option == most or more.isEmpty():
            break
        banned = cut(more if banned is None else banned.unionByName(more))
        seen = cut(fresh.select("query", "sign") if seen is None else seen.unionByName(fresh.select("query", "sign")))
        starts = cut(starts.join(more.select("query"), "query", "left_semi"))
    return cut(reduce(DataFrame.unionByName, out))


def totals(legs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a way: legs, metres, minutes, transfers, fare (null if no ride has one), fare_incomplete, departs (of the first timed ride), routes."""
    rides, priced = F.count("route_id"), F.count("fare")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("route_id").isNotNull(), F.struct("leg", "route_id")))), lambda x: x["route_id"].cast("string")), ">")
    return legs.groupBy(*keys).agg(
        F.count("*").alias("legs"), F.sum("metres").alias("metres"), F.sum("minutes").alias("minutes"), F.greatest(F.lit(0), rides - 1).cast("bigint").alias("transfers"), F.sum("fare").alias("fare"),
        ((priced > 0) & (priced < rides)).alias("fare_incomplete"), F.min_by("departs", F.when(F.col("departs").isNotNull(), F.col("leg"))).alias("departs"), listed.alias("routes"),
    )


def ranked(ways: DataFrame) -> DataFrame:
    """totals() of several options of a query with rank: fastest first, then the earliest departure, then as found."""
    return ways.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("minutes", F.asc_nulls_last("departs"), "option")))
