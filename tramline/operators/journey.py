"""Journeys: direct legs, transfers, and round-based search without a driver-side graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.functions import text
from tramline.functions.geo import distance_m
from tramline.operators.relational import dealt, parts, top_n
from tramline.operators.spatial import place_pairs
from tramline.session import cut

BOARD_MIN, WALK_KMH, BUS_KMH = 6, 4.5, 22.0
MAX_HOP_M, WALK_M, ACCESS_M = 150_000, 600, 1500


def later_calls(calls: DataFrame, stops: DataFrame, origin: str, destination: str) -> DataFrame:
    """Calls at stops named `origin...` with later calls of the trip at stops named `destination...`."""
    at = lambda prefix: calls.join(stops.filter(F.col("name").startswith(prefix)).select(F.col("id").alias("stop_id")), "stop_id")
    o = at(origin).select("trip_id", F.col("stop_id").alias("origin"), F.col("seq").alias("s"))
    d = at(destination).select("trip_id", F.col("stop_id").alias("destination"), F.col("seq").alias("e"))
    return o.join(d, "trip_id").filter("e > s").select("trip_id", "origin", "destination", (F.col("e") - F.col("s")).cast("int").alias("hops"))


def _rides(calls: DataFrame, minutes: Column, condition: str) -> DataFrame:
    """Fewest minutes and number of rides between two stops of a trip, s and e being their places on it.

    A trip of n calls makes about n^2 / 2 pairs, which are counted before the shuffle.
    """
    some = dealt(calls.select("trip_id", "stop_id", "seq"), "trip_id")
    o = some.select("trip_id", F.col("stop_id").alias("origin"), F.col("seq").alias("s"))
    d = some.select("trip_id", F.col("stop_id").alias("destination"), F.col("seq").alias("e"))
    each = o.join(d.hint("merge"), "trip_id").filter(condition).withColumn("m", minutes.cast("int"))
    return each.groupBy("origin", "destination").agg(F.min("m").alias("minutes"), F.count("*").alias("rides"))


def direct_legs(calls: DataFrame) -> DataFrame:
    """Rides along a trip's order: three minutes a hop, eight at least."""
    return _rides(calls, F.greatest(F.lit(8), 3 * (F.col("e") - F.col("s"))), "s < e")


def line_legs(calls: DataFrame) -> DataFrame:
    """Rides either way along a line: two minutes a hop and three to start, six at least."""
    return _rides(calls, F.greatest(F.lit(6), 2 * F.abs(F.col("e") - F.col("s")) + 3), "s <> e")


def name_transfers(stations: DataFrame, stops: DataFrame) -> DataFrame:
    """Stations and stops whose names have the same transfer key of four characters or more."""
    key = text.transfer_key(F.col("name")).alias("k")
    return stations.select(F.col("id").alias("station"), key).join(stops.select(F.col("id").alias("stop"), key), "k").filter(F.length("k") >= 4).select("station", "stop", F.lit(0.8).alias("confidence"))


def _changes(calls: DataFrame, origins: DataFrame | Column, walk: int) -> tuple[DataFrame, DataFrame, int]:
    """Direct legs from `origins`; every two legs that meet at a stop, the first of them one of those (origin, destination, minutes); and the tasks for so many.

    A stop makes the product of the legs to it and from it. How many that are is reckoned from the legs of a stop on average, before they are made.
    """
    legs = cut(direct_legs(calls))
    first = cut(legs.filter(origins) if isinstance(origins, Column) else legs.join(origins.hint("merge"), "origin", "left_semi"))
    n, stops = legs.agg(F.count("origin"), F.approx_count_distinct("origin")).first()
    few, made = parts(n), parts(first.count() * n // max(stops, 1))
    come = first.select("origin", F.col("destination").alias("via"), F.col("minutes").alias("m1")).repartition(few, "via")
    go = legs.select(F.col("origin").alias("via"), "destination", F.col("minutes").alias("m2")).repartition(few, "via")
    both = come.join(go.hint("merge"), "via").filter("origin <> destination")
    return first, both.select("origin", "destination", (F.col("m1") + walk + F.col("m2")).cast("int").alias("minutes")), made


def two_legs(calls: DataFrame, origins: DataFrame | Column, walk: int = 4) -> DataFrame:
    """Fewest minutes from each of `origins` (origin; or a condition on it) to every stop over two rides that meet at a stop.

    Both rides are the best ones between their stops (direct_legs()), so what meets at a stop is bounded by the stops
    around it, not by the rides through it.
    """
    _, both, made = _changes(calls, origins, walk)
    return both.repartition(made, "origin", "destination").groupBy("origin", "destination").agg(F.min("minutes").alias("minutes"))


def direct_or_change(calls: DataFrame, origins: DataFrame | Column, walk: int = 4) -> DataFrame:
    """As two_legs(), but with the direct ride where there is one: origin, destination, minutes and how (direct, transfer).

    Direct rides and changes meet in the shuffle that finds the fewest minutes; they aren't joined.
    """
    first, both, made = _changes(calls, origins, walk)
    none = F.lit(None).cast("int")
    direct = first.filter("origin <> destination").select("origin", "destination", F.col("minutes").alias("d"), none.alias("c"))
    every = direct.unionByName(both.select("origin", "destination", none.alias("d"), F.col("minutes").alias("c")))
    best = every.repartition(made, "origin", "destination").groupBy("origin", "destination").agg(F.min("d").alias("d"), F.min("c").alias("c"))
    return best.select("origin", "destination", F.coalesce("d", "c").alias("minutes"), F.when(F.col("d").isNull(), "transfer").otherwise("direct").alias("how"))


def services_of_stops(calls: DataFrame, trips: DataFrame, routes: DataFrame, most: int = 8) -> DataFrame:
    """Per stop, up to `most` of its routes by name as a JSON array; the list is bounded before it is collected."""
    t = trips.select(F.col("id").alias("trip_id"), "route_id")
    served = calls.select("stop_id", "trip_id").join(t, "trip_id").select("stop_id", "route_id").distinct()
    named = served.join(routes.select(F.col("id").alias("route_id"), "long_name"), "route_id")
    few = top_n(named, ["stop_id"], [F.col("long_name"), F.col("route_id")], most)
    listed = F.sort_array(F.collect_list(F.struct(F.col("long_name").alias("name"), F.col("route_id").alias("id"))))
    return few.groupBy("stop_id").agg(F.to_json(listed).alias("services"))


def hops(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """Calls with hop_min: minutes from the call before, null where a ride can't be costed, and segment: a count of such gaps.

    The timetable's difference counts where both times are known and it is positive; else the distance at bus speed.
    """
    along = W.partitionBy("trip_id").orderBy("seq", "stop_id", "platform")
    few = parts(calls.count())
    p = calls.repartition(few, "stop_id").join(stops.select(F.col("id").alias("stop_id"), "lat", "lng").repartition(few, "stop_id").hint("merge"), "stop_id", "left").repartition(few, "trip_id")
    before = lambda c: F.lag(c).over(along)
    metres = distance_m(before("lat"), before("lng"), F.col("lat"), F.col("lng"))
    table = F.when(F.col("departs").isNotNull() & before("departs").isNotNull(), F.col("minute") - before("minute"))
    near = F.when(metres <= MAX_HOP_M, F.greatest(F.lit(1), F.floor(metres / (BUS_KMH * 1000 / 60) + 0.5)))
    first = F.row_number().over(along) == 1
    p = p.withColumn("pos", F.row_number().over(along)).withColumn("hop_min", F.when(first, 0).when(table > 0, table).otherwise(near).cast("bigint"))
    return p.withColumn("segment", F.sum(F.col("hop_min").isNull().cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))


def ride_round(labels: DataFrame, ride: DataFrame) -> DataFrame:
    """One ride from every labelled stop: at each later call the fewest minutes over all places to board.

    With cum the minutes along a segment, that is cum + BOARD_MIN + min(label - cum) over the calls before: a running
    minimum, so no pair of calls is ever made. Columns stop_id and minutes.
    """
    along = W.partitionBy("trip_id", "segment").orderBy("pos")
    cum = F.sum(F.coalesce("hop_min", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0))
    on = ride.join(labels, "stop_id", "left").repartition(parts(ride.count()), "trip_id", "segment").withColumn("cum", cum)
    best = F.min(F.col("minutes") - F.col("cum")).over(along.rowsBetween(W.unboundedPreceding, -1))
    return on.select("stop_id", (F.col("cum") + BOARD_MIN + best).alias("minutes")).filter("minutes is not null").groupBy("stop_id").agg(F.min("minutes").alias("minutes"))


class Walks:
    """Walks of at most `metres` between stops, kept by place: `at` (stop_id, lat, lng) and `pairs` of different places, both ways, with their minutes.

    Stops of one place have the same walks, so pairs grow with the places, not with the stops that share them.
    """

    def __init__(self, stops: DataFrame, metres: float):
        self.at, self.metres, self.pairs = stops.filter("lat is not null and lng is not null").select(F.col("id").alias("stop_id"), "lat", "lng").distinct(), metres, None

    def written(self) -> Walks:
        """Itself with `at` and `pairs` cut, for several rounds; for a single one the pairs are never written."""
        places = self.at.select("lat", "lng").distinct().withColumn("part", F.lit(0))
        one = self._apart(places).select("lat_a", "lng_a", "lat_b", "lng_b", "walk")
        self.pairs = cut(one.unionByName(one.select(F.col("lat_b").alias("lat_a"), F.col("lng_b").alias("lng_a"), F.col("lat_a").alias("lat_b"), F.col("lng_a").alias("lng_b"), "walk")))
        self.at = cut(self.at)
        return self

    def _apart(self, places: DataFrame) -> DataFrame:
        return place_pairs(places, self.metres).filter("lat_a <> lat_b or lng_a <> lng_b").withColumn("walk", walk_minutes(F.floor(F.col("d") + 0.5)))

    def fewest(self, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """lat, lng and the fewest minutes there from the places of `labels` (lat, lng, minutes), other than itself; for each of `keys` if the walks are written."""
        if self.pairs is not None:
            went = labels.join(self.pairs.hint("merge"), (F.col("lat") == F.col("lat_a")) & (F.col("lng") == F.col("lng_a"))).select(*keys, F.col("lat_b").alias("lat"), F.col("lng_b").alias("lng"), (F.col("minutes") + F.col("walk")).alias("minutes"))
        else:
            places = self.at.select("lat", "lng").distinct().join(labels, ["lat", "lng"], "left").withColumn("part", F.lit(0))
            way = lambda a, b: F.struct(F.col(f"lat_{b}").alias("lat"), F.col(f"lng_{b}").alias("lng"), (F.col(f"minutes_{a}") + F.col("walk")).alias("minutes"))
            went = self._apart(places).select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.*").filter("minutes is not null")
        return went.groupBy(*keys, "lat", "lng").agg(F.min("minutes").alias("minutes"))


def walk_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(metres / (WALK_KMH * 1000 / 60) + 0.5)).cast("bigint")


def _best_two(labels: DataFrame, walks: Walks, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Of each place that is labelled: p and q, its two best (minutes, stop_id); and of its stops: s, the best of another stop there.

    Only these matter to a walk: the first for all other places and for its own stops, the second for the first one's own stop.
    """
    place, best = [*keys, "lat", "lng"], F.struct("minutes", "stop_id")
    mine = labels.groupBy(*keys, "stop_id").agg(F.min("minutes").alias("minutes")).join(walks.at.hint("merge"), "stop_id")
    two = top_n(mine, place, [F.col("minutes"), F.col("stop_id")], 2).groupBy(*place).agg(F.min(best).alias("p"), F.max(best).alias("q"))
    s = F.when(F.col("p.stop_id") == F.col("stop_id"), F.col("q")).otherwise(F.col("p"))
    return two, two.join(walks.at.hint("merge"), ["lat", "lng"]).select(*keys, "stop_id", s.alias("s")).filter("s.stop_id <> stop_id")


def walked(labels: DataFrame, walks: Walks, keys: tuple[str, ...]) -> DataFrame:
    """One walk from every labelled stop over written `walks`: keys, stop_id and c, the least (minutes, frm) over all stops to come from."""
    two, own = _best_two(labels, walks, keys)
    came = lambda s, walk: F.struct((F.col(f"{s}.minutes") + walk).alias("minutes"), F.col(f"{s}.stop_id").alias("frm")).alias("c")
    over = two.join(walks.pairs.hint("merge"), (F.col("lat") == F.col("lat_a")) & (F.col("lng") == F.col("lng_a"))).select(*keys, F.col("lat_b").alias("lat"), F.col("lng_b").alias("lng"), came("p", F.col("walk")))
    over = over.groupBy(*keys, "lat", "lng").agg(F.min("c").alias("c")).join(walks.at.hint("merge"), ["lat", "lng"]).select(*keys, "stop_id", "c")
    return over.unionByName(own.select(*keys, "stop_id", came("s", F.lit(1)))).groupBy(*keys, "stop_id").agg(F.min("c").alias("c"))


def walk_round(labels: DataFrame, walks: Walks, keys: tuple[str, ...] = ()) -> DataFrame:
    """One walk from every labelled stop: keys (for which the walks must be written), stop_id and the fewest minutes."""
    two, own = _best_two(labels, walks, keys)
    over = walks.fewest(two.select(*keys, "lat", "lng", F.col("p.minutes").alias("minutes")), keys).join(walks.at.hint("merge"), ["lat", "lng"]).select(*keys, "stop_id", "minutes")
    return over.unionByName(own.select(*keys, "stop_id", (F.col("s.minutes") + 1).alias("minutes"))).groupBy(*keys, "stop_id").agg(F.min("minutes").alias("minutes"))


def reach(origins: DataFrame, calls: DataFrame, stops: DataFrame, rounds: int = 3) -> DataFrame:
    """Fewest minutes to every stop within `rounds` rides with walks between: stop_id and minutes.

    origins has stop_id and minutes (of the way there). Each round starts from the labels of the one before.
    """
    ride, walks = cut(hops(calls, stops).select("trip_id", "segment", "pos", "stop_id", "hop_min")), Walks(stops, WALK_M).written()
    labels = origins.select("stop_id", F.col("minutes").cast("bigint").alias("minutes"))
    for _ in range(rounds):
        ridden = cut(ride_round(labels, ride))
        labels = cut(labels.unionByName(ridden).unionByName(walk_round(ridden, walks)).groupBy("stop_id").agg(F.min("minutes").alias("minutes")))
    return labels


def ride_legs(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """a, b and m: the fewest minutes of one ride from a call at a to a later one at b, with BOARD_MIN, over all trips.

    As minutes along a trip don't depend on when it is boarded, one table of legs serves all searches and all their rounds.
    """
    along = W.partitionBy("trip_id", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    on = dealt(cut(hops(calls, stops).select("trip_id", "segment", "pos", "stop_id", F.sum(F.coalesce("hop_min", F.lit(0))).over(along).alias("cum"))), "trip_id", "segment")
    o = on.select("trip_id", "segment", F.col("stop_id").alias("a"), F.col("pos").alias("s"), F.col("cum").alias("c"))
    d = on.select("trip_id", "segment", F.col("stop_id").alias("b"), F.col("pos").alias("e"), "cum")
    return o.join(d.hint("merge"), ["trip_id", "segment"]).filter("s < e").groupBy("a", "b").agg((F.min(F.col("cum") - F.col("c")) + BOARD_MIN).alias("m"))


def reach_each(origins: DataFrame, calls: DataFrame, stops: DataFrame, rounds: int = 3) -> DataFrame:
    """reach() for many searches at once: origin, stop_id and the fewest minutes from each of `origins` (origin, stop_id, minutes).

    A round goes on from the labels that the one before lowered; rides and walks from the others have been found. What a round
    makes is dealt by its number, reckoned from the legs of a stop on average, so tasks are as large for any number of origins.
    """
    keys = ["origin", "stop_id"]
    legs, walks = cut(ride_legs(calls, stops)), Walks(stops, WALK_M).written()
    n, starts = legs.agg(F.count("a"), F.approx_count_distinct("a")).first()
    labels = front = cut(origins.select(*keys, F.col("minutes").cast("bigint").alias("minutes")).groupBy(*keys).agg(F.min("minutes").alias("minutes")))
    for number in range(rounds):
        rows = front.count()
        few, made = parts(max(rows, n)), parts(rows * n // max(starts, 1))
        rode = front.repartition(few, "stop_id").join(legs.repartition(few, "a").hint("merge"), F.col("stop_id") == F.col("a")).select("origin", F.col("b").alias("stop_id"), (F.col("minutes") + F.col("m")).alias("minutes"))
        rode = cut(rode.repartition(made, *keys).groupBy(*keys).agg(F.min("minutes").alias("minutes")))
        every = labels.withColumn("old", F.lit(True)).unionByName(rode.unionByName(walk_round(rode, walks, ("origin",))).withColumn("old", F.lit(False)))
        best = every.groupBy(*keys).agg(F.min("minutes").alias("minutes"), F.min(F.when(F.col("old"), F.col("minutes"))).alias("before"))
        if number + 1 == rounds:
            return best.select(*keys, "minutes")
        best = cut(best)
        labels, front = best.select(*keys, "minutes"), best.filter("before is null or minutes < before").select(*keys, "minutes")
    return labels


def best_candidate(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first reading of a destination (lowest rank) that is reached: name, stop_id, minutes."""
    reached = candidates.join(labels.select("stop_id", "minutes"), "stop_id")
    first = F.min_by(F.struct("stop_id", "minutes"), F.struct("rank", "minutes", "stop_id")).alias("b")
    return reached.groupBy("name").agg(first).select("name", "b.stop_id", "b.minutes")


def hop_edges(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """The stop graph: a, b and the fewest minutes of a hop between them that can be costed."""
    along = W.partitionBy("trip_id").orderBy("pos")
    each = hops(calls, stops).withColumn("a", F.lag("stop_id").over(along)).filter("a is not null and hop_min is not null and a <> stop_id")
    return each.groupBy("a", F.col("stop_id").alias("b")).agg(F.min("hop_min").alias("weight"))


def paths_within(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Every simple path of each pair (query, origin, target) over `edges` (a, b, weight > 0) of at most `most`: query, path, weight, rank.

    First the fewest minutes to each target are found backwards, up to `most`; then paths grow edge by edge from the
    origins, and one goes as soon as its weight and the fewest minutes left pass `most`. So every path that is kept at
    any length is the start of a way there that isn't too long; what is enumerated is the result and its prefixes.
    """
    goal = cut(pairs.select(F.col("target").alias("goal"), F.col("target").alias("stop"), F.lit(0).cast("bigint").alias("left")).distinct())
    front = goal
    while not front.isEmpty():
        more = front.join(edges, F.col("stop") == F.col("b")).select("goal", F.col("a").alias("stop"), (F.col("left") + F.col("weight")).alias("left")).filter(F.col("left") <= most)
        best = more.groupBy("goal", "stop").agg(F.min("left").alias("left"))
        front = cut(best.join(goal.withColumnRenamed("left", "old"), ["goal", "stop"], "left").filter("old is null or left < old").drop("old"))
        goal = cut(goal.unionByName(front).groupBy("goal", "stop").agg(F.min("left").alias("left")))
    left = goal.select(F.col("goal").alias("target"), F.col("stop").alias("at"), "left")
    start = pairs.select("query", "target", F.col("origin").alias("at"), F.array("origin").alias("path"), F.lit(0).cast("bigint").alias("weight"))
    grown, done = cut(start.join(left, ["target", "at"], "left_semi")), []
    while True:
        done.append(grown.filter("at = target"))
        step = grown.filter("at <> target").join(edges.withColumnRenamed("weight", "w"), F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        step = step.select("query", "target", F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        grown = cut(step.join(left, ["target", "at"]).filter(F.col("weight") + F.col("left") <= most).drop("left"))
        if grown.isEmpty():
            break
    every = reduce(DataFrame.unionByName, done)
    return every.select("query", "path", "weight", F.row_number().over(W.partitionBy("query").orderBy("weight", "path")).alias("rank"))


def stop_graph(calls: DataFrame, stops: DataFrame, box: tuple[float, float, float, float], size: float = 0.01) -> DataFrame:
    """The nodes of the stop graph: stop_id, its grid cell (cy, cx), calls, and edges: stops that a hop leads to.

    A stop without a place or outside the box (south, north, west, east) is in no cell, so it is never found by its place, but it
    keeps its calls and edges: it can be ridden.
    """
    inside = F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3])
    cell = lambda c: F.when(inside, F.floor(F.col(c) / size)).cast("bigint")
    n = calls.groupBy("stop_id").agg(F.count("*").alias("calls"))
    out = hop_edges(calls, stops).groupBy(F.col("a").alias("stop_id")).agg(F.count("*").alias("edges"))
    nodes = stops.select(F.col("id").alias("stop_id"), cell("lat").alias("cy"), cell("lng").alias("cx"))
    return nodes.join(n, "stop_id", "left").join(out, "stop_id", "left").fillna(0, ["calls", "edges"])
