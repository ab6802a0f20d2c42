"""Nested datasets: staged, checked and promoted as versions of several tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators import staging
from tramline.operators.relational import parts
from tramline.plans.registry import query
from tramline.session import remove_path, shared_dir

KEY = "CASE WHEN s.id % 10 = 3 THEN 'node_' || s.name ELSE 'S' || s.id END"
AT = f"SELECT c.trip_id, row_number() OVER (PARTITION BY c.trip_id ORDER BY c.seq, c.stop_id, c.platform) AS seq, s.id AS stop_id, s.name, {KEY} AS node, c.departs, count(*) OVER (PARTITION BY c.trip_id) AS n FROM calls c JOIN stops s ON s.id = c.stop_id"


def trip_calls(v) -> DataFrame:
    """A row for each trip: its calls with their stops, in order; their places in it are their numbers, from 1."""
    few = parts(4 * v.calls.count())  # of each call a node, a stop and a time are made
    at = v.stops.select(F.col("id").alias("stop_id"), "name", "lat", "lng").repartition(few, "stop_id")
    c = v.calls.repartition(few, "stop_id").join(at.hint("merge"), "stop_id").repartition(few, "trip_id")
    listed = F.sort_array(F.collect_list(F.struct("seq", "stop_id", "platform", "name", "lat", "lng", "departs")))  # as many as one trip has
    return c.groupBy("trip_id").agg(listed.alias("calls"))


def told(node: Column | None = None, least: int = 1, known: Callable[[Column], Column] | None = None) -> dict[str, Column]:
    """The columns of a document of trip_calls(): its stops, a route pattern of their order, the trip with its times, one observation.

    Every tenth stop has no id of its provider. The others change what is told: the stops' ids, the least place in the order,
    the stops among the nodes. Each row is made of its own trip alone, so nothing is shuffled.
    """
    own = lambda x: F.when(x["stop_id"] % 10 != 3, F.concat(F.lit("S"), x["stop_id"].cast("string"))) if node is None else node
    at = lambda i: F.greatest(i + 1, F.lit(least))
    name = lambda p: F.concat(F.lit(p), F.col("trip_id").cast("string"))
    node_of = lambda x: F.struct(own(x).alias("externalId"), x["name"].alias("name"), F.lower(x["name"]).alias("normalizedName"), x["lat"].alias("latitude"), x["lng"].alias("longitude"))
    stop_of = lambda x, i: F.struct(own(x).alias("nodeExternalId"), x["name"].alias("name"), at(i).alias("sequence"))
    time_of = lambda x, i: F.struct(own(x).alias("stopExternalId"), x["name"].alias("stopName"), at(i).alias("sequence"), F.lit(None).cast("string").alias("arrivalTime"), x["departs"].alias("departureTime"), (at(i) % 2 == 0).alias("timeIsEstimated"))
    pattern = F.struct(name("R").alias("externalId"), name("r").alias("shortName"), name("Route ").alias("longName"), F.lit(None).cast("string").alias("operationalStatus"), F.transform("calls", stop_of).alias("stops"))
    trip = F.struct(name("T").alias("externalId"), name("t").alias("serviceName"), name("R").alias("routeExternalId"), F.lit("ACTIVE").alias("operationalStatus"), F.transform("calls", time_of).alias("stopTimes"))
    seen = F.struct(name("trip-").alias("sourceRecordId"), F.lit(0.9).alias("confidence"))
    nodes = F.col("calls") if known is None else F.filter("calls", known)
    return {
        "provider": F.lit("p"), "document": F.col("trip_id").cast("string"), "observations": F.array(seen), "nodes": F.transform(nodes, node_of),
        "routePatterns": F.array(pattern), "trips": F.array(trip),
    }


def documents(trips: DataFrame) -> DataFrame:
    """A document for each of trip_calls(), beside its calls."""
    return trips.withColumns(told())


@query(f"""WITH a AS ({AT}), e AS (SELECT 'stops' AS kind, node AS external_id FROM a UNION ALL SELECT DISTINCT 'routes', 'R' || trip_id FROM a UNION ALL SELECT DISTINCT 'trips', 'T' || trip_id FROM a UNION ALL SELECT DISTINCT 'observations', 'trip-' || trip_id FROM a
UNION ALL SELECT 'route_stops', 'R' || trip_id || ':' || seq FROM a UNION ALL SELECT 'stop_times', 'T' || trip_id || ':' || seq FROM a)
SELECT kind, external_id, count(*) AS rows FROM e GROUP BY ALL""")
def lc_stage(v):
    """What the documents of all trips are staged as, by kind and external id."""
    staged = staging.stage(documents(trip_calls(v)), "v1")
    out = [rows.groupBy("external_id").agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind)) for kind, rows in staged.items()]
    return reduce(DataFrame.unionByName, out)


@query(f"""WITH a AS ({AT}), good AS (SELECT * FROM a WHERE n > 1), part_ AS (SELECT * FROM good WHERE trip_id % 2 = 0 AND seq <= 2),
left_ AS (SELECT * FROM good WHERE trip_id NOT IN (SELECT trip_id FROM part_) UNION ALL SELECT * FROM part_), known AS (SELECT DISTINCT node FROM good WHERE stop_id % 7 <> 0)
SELECT 'active' AS step, 'stops' AS what, count(DISTINCT node) AS n FROM good UNION ALL SELECT 'active', 'routes', count(DISTINCT trip_id) FROM good UNION ALL SELECT 'active', 'trips', count(DISTINCT trip_id) FROM good
UNION ALL SELECT 'active', 'route_stops', count(*) FROM left_ UNION ALL SELECT 'active', 'stop_times', count(*) FROM left_ UNION ALL SELECT 'active', 'estimated', count(*) FROM left_ WHERE seq % 2 = 0 UNION ALL SELECT 'active', 'scraped', count(*) FROM left_ WHERE seq % 2 = 1 AND departs IS NOT NULL
UNION ALL SELECT 'short', 'TOO_FEW_STOPS', count(*) FROM a WHERE n = 1 HAVING count(*) > 0
UNION ALL SELECT 'unknown', 'UNKNOWN_STOP', count(DISTINCT (trip_id, node)) FROM good WHERE node NOT IN (FROM known) UNION ALL SELECT 'unknown', 'UNMAPPED_TIME', count(*) FROM good WHERE node NOT IN (FROM known)
UNION ALL SELECT 'twice', 'DUPLICATE_SEQUENCE', count(DISTINCT trip_id) FROM good
UNION ALL SELECT 'conflict', 'ID_CONFLICT', 1 UNION ALL SELECT 'unseen', 'NO_OBSERVATION', 1 UNION ALL SELECT 'nothing', 'EMPTY', 1 UNION ALL SELECT 'nothing', 'NO_OBSERVATION', 1""")
def lc_promote(v):
    """Two versions are promoted, the second over part of the first; seven others are each refused and change nothing.

    What each refused version breaks, and what is active in the end.
    """
    root = f"{shared_dir(v.spark)}/promote-{uuid.uuid4().hex}"
    net = staging.Network(v.spark, root)
    documents(trip_calls(v)).write.parquet(f"{root}-documents")  # the one shuffle; every version is a selection of these rows, with some columns told otherwise
    every = v.spark.read.parquet(f"{root}-documents")
    good = every.filter(F.size("calls") > 1)
    some = lambda docs, columns, *names: docs.withColumns({k: columns[k] for k in names})
    part = good.filter("trip_id % 2 = 0").withColumn("calls", F.slice("calls", 1, 2))
    unseen = good.withColumn("observations", F.slice("observations", 1, 0))
    versions = {
        "first": good, "short": every, "unknown": some(good, told(known=lambda x: x["stop_id"] % 7 != 0), "nodes"), "twice": some(good, told(least=2), "routePatterns", "trips"),
        "conflict": some(good, told(node=F.lit("S1")), "nodes", "routePatterns", "trips"), "unseen": unseen, "nothing": unseen.limit(0), "second": some(part, told(), "nodes", "routePatterns", "trips"),
    }
    said = []
    for name, docs in versions.items():
        try:
            net.promote_all(staging.stage(docs, name), name)
        except staging.Refused as refused:
            said.append(refused.errors.groupBy(F.col("rule").alias("what")).agg(F.count("*").alias("n")).withColumn("step", F.lit(name)))
    remove_path(v.spark, f"{root}-documents")
    active = net.tables()
    counts = {k: df for k, df in active.items()} | {"estimated": active["stop_times"].filter("time_source = 'INTERPOLATED'"), "scraped": active["stop_times"].filter("time_source = 'SCRAPED'")}
    out = [df.agg(F.count("*").alias("n")).select(F.lit("active").alias("step"), F.lit(k).alias("what"), "n") for k, df in counts.items()]
    return reduce(DataFrame.unionByName, [*out, *said])
