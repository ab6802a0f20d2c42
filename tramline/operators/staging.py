"""From nested provider datasets to one network of several tables: staging, the gates between them, promotion.

A dataset is a table of documents, each with arrays of observations, nodes, routePatterns (with stops) and trips (with
stopTimes); a large feed is many documents, so no row holds all of it. Staged tables are flat. A version is promoted as a
whole: all tables are written first, and one pointer then names them all.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.lifecycle import Snapshots, time_source
from tramline.operators.relational import distinct_on
from tramline.session import cut

KEYS = {"stops": ["provider", "external_id"], "routes": ["provider", "external_id"], "route_stops": ["provider", "route", "sequence"], "trips": ["provider", "external_id"], "stop_times": ["provider", "trip", "sequence"]}


class Refused(ValueError):
    """A version that breaks a gate; `errors` has its rows (rule, subject)."""

    def __init__(self, version: str, errors: DataFrame):
        rules = ", ".join(f"{r['rule']} ({r['count']})" for r in errors.groupBy("rule").count().orderBy("rule").collect())
        super().__init__(f"{version} is refused: {rules}")
        self.errors = errors


def _named(external: str, prefix: str, name: str) -> Column:
    """The provider's own id, or a synthetic one from the name."""
    return F.coalesce(F.expr(f"nullif({external}, '')"), F.concat(F.lit(prefix), F.expr(name)))


def stage(dataset: DataFrame, version: str) -> dict[str, DataFrame]:
    """The staged tables of `dataset` (provider, document, observations, nodes, routePatterns, trips).

    Each row has an id that depends only on version, kind, document and place in it, so staging again gives the same
    rows; an external id, which is made of the name where the provider gives none, and is null where there is no name
    either; its document's first observation; and what promotion reads. Null arrays are empty.
    """

    def each(kind: str, rows: DataFrame, *columns: Column) -> DataFrame:
        place = [F.col(c).cast("string") for c in ("document", "i", "j") if c in rows.columns]
        key = F.sha2(F.concat_ws("|", F.lit(version), F.lit(kind), F.length("document").cast("string"), *place), 256)
        return rows.select(F.substring(key, 1, 32).alias("id"), F.lit(version).alias("version"), "provider", "observation", *columns)

    docs = dataset.withColumn("observation", F.get("observations", F.lit(0))["sourceRecordId"])
    of = lambda c: docs.select("provider", "document", "observation", F.posexplode(c).alias("i", "x"))
    nodes, routes, trips = of("nodes"), of("routePatterns"), of("trips")
    route_id, trip_id = _named("x.externalId", "route_", "x.shortName"), _named("x.externalId", "trip_", "x.serviceName")
    stops = routes.select("provider", "document", "observation", "i", route_id.alias("route"), F.posexplode("x.stops").alias("j", "s"))
    times = trips.select("provider", "document", "observation", "i", trip_id.alias("trip"), F.posexplode("x.stopTimes").alias("j", "s"))
    return {
        "observations": docs.select("provider", "document", F.explode("observations").alias("o")).select(F.lit(version).alias("version"), "provider", F.col("o.sourceRecordId").alias("external_id"), F.col("o.confidence").alias("confidence")),
        "stops": each("node", nodes, _named("x.externalId", "node_", "x.name").alias("external_id"), F.col("x.name").alias("name"), F.col("x.normalizedName").alias("normal_name"), F.col("x.latitude").alias("lat"), F.col("x.longitude").alias("lng")),
        "routes": each("route", routes, route_id.alias("external_id"), F.col("x.longName").alias("name"), F.coalesce("x.operationalStatus", F.lit("ACTIVE")).alias("status")),
        "route_stops": each("route_stop", stops, F.concat_ws(":", "route", F.col("s.sequence").cast("string")).alias("external_id"), "route", _named("s.nodeExternalId", "node_", "s.name").alias("stop"), F.col("s.sequence").alias("sequence")),
        "trips": each("trip", trips, trip_id.alias("external_id"), F.col("x.routeExternalId").alias("route"), F.coalesce("x.operationalStatus", F.lit("ACTIVE")).alias("status")),
        "stop_times": each("stop_time", times, F.concat_ws(":", "trip", F.col("s.sequence").cast("string")).alias("external_id"), "trip", _named("s.stopExternalId", "node_", "s.stopName").alias("stop"), F.col("s.sequence").alias("sequence"), F.col("s.arrivalTime").alias("arrives"), F.col("s.departureTime").alias("departs"), F.coalesce("s.timeIsEstimated", F.lit(False)).alias("estimated")),
    }


def gate_errors(staged: dict[str, DataFrame]) -> DataFrame:
    """rule and subject of everything that keeps a version from being promoted, each once; none if it may be.

    Each table is read once for what it says of its keys (stops, routes, trips), and those are counted in one shuffle, before
    which each task counts its own; so neither rows nor a key that all of them name meet in one task. Rows are looked up again
    only for keys that nothing defines.
    """
    nodes, routes, stops, trips, times = (staged[k] for k in ("stops", "routes", "route_stops", "trips", "stop_times"))
    bad = cut(_keys(nodes, routes, stops, trips, times).filter("conflict or nameless or short or unknown"))
    again = stops.groupBy("provider", "route", "sequence").agg(F.count("*").alias("n")).filter("n > 1")
    said = lambda rows, rule, subject: rows.select(F.lit(rule).alias("rule"), subject.alias("subject"))
    pair = lambda a, b: F.concat_ws(" > ", F.coalesce(a, F.lit("?")), F.coalesce(F.col(b).cast("string"), F.lit("?")))
    parts = [
        said(bad.filter("nameless"), "NO_EXTERNAL_ID", F.col("key")), said(bad.filter("conflict"), "ID_CONFLICT", F.col("key")),
        said(bad.filter("short"), "TOO_FEW_STOPS", F.coalesce("key", F.lit("?"))), said(again, "DUPLICATE_SEQUENCE", pair("route", "sequence")),
    ]
    named = {(r["space"], by) for r in bad.filter("unknown").groupBy("space").agg(*[F.sum(k).alias(k) for k in ("route_stops", "trips", "stop_times")]).collect() for by in ("route_stops", "trips", "stop_times") if r[by]}  # three rows at most
    for space, by, key, rule, subject in (("stop", "route_stops", "stop", "UNKNOWN_STOP", pair("route", "stop")), ("route", "trips", "route", "UNKNOWN_ROUTE", pair("external_id", "route")), ("stop", "stop_times", "stop", "UNMAPPED_TIME", pair("trip", "sequence")), ("trip", "stop_times", "trip", "UNMAPPED_TIME", pair("trip", "sequence"))):
        if (space, by) in named:
            none = bad.filter((F.col("space") == space) & F.col("unknown") & (F.col(by) > 0)).select(F.col("provider").alias("of"), "key")
            parts.append(said(staged[by].join(none, F.col("provider").eqNullSafe(F.col("of")) & F.col(key).eqNullSafe(F.col("key")), "left_semi"), rule, subject))
    empty = [rule for rule, tables in (("NO_OBSERVATION", [staged["observations"]]), ("EMPTY", [nodes, routes])) if all(t.isEmpty() for t in tables)]
    parts.append(nodes.sparkSession.createDataFrame([(rule, "version") for rule in empty], "rule string, subject string"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _keys(nodes: DataFrame, routes: DataFrame, stops: DataFrame, trips: DataFrame, times: DataFrame) -> DataFrame:
    """What the staged tables say of each key (space, provider, key): how many of each name it, and whether that breaks a gate.

    A null key or a null provider defines nothing. Nodes without a key are a space of their own, by their ids.
    """

    def facts(rows: DataFrame, by: str, *keys: tuple[str, str], name: Column | None = None) -> DataFrame:
        text = F.lit(None).cast("string") if name is None else name
        each = rows.select("provider", text.alias("name"), F.explode(F.array(*[F.struct(F.lit(space).alias("space"), F.expr(key).alias("key")) for space, key in keys])).alias("k"))
        return each.select("k.space", "provider", "k.key", F.lit(by).alias("by"), "name")

    said = [
        facts(nodes.filter("external_id is not null"), "nodes", ("stop", "external_id"), name=F.col("normal_name")), facts(nodes.filter("external_id is null"), "nodes", ("none", "id")), facts(routes, "routes", ("route", "external_id")),
        facts(stops, "route_stops", ("stop", "stop"), ("route", "route")), facts(trips, "trips", ("trip", "external_id"), ("route", "route")), facts(times, "stop_times", ("stop", "stop"), ("trip", "trip")),
    ]
    by, kinds = F.col("by"), ("nodes", "routes", "route_stops", "trips", "stop_times")
    named = reduce(DataFrame.unionByName, said).groupBy("space", "provider", "key", "name").agg(*[F.count_if(by == k).alias(k) for k in kinds])
    keys = named.groupBy("space", "provider", "key").agg(*[F.sum(k).alias(k) for k in kinds], F.count_if(F.col("nodes") > 0).alias("names"))
    space, lost = F.col("space"), F.col("provider").isNull() | F.col("key").isNull()
    own = F.when(space == "stop", F.col("nodes")).when(space == "route", F.col("routes")).otherwise(F.col("trips"))
    asked = F.when(space == "stop", F.col("route_stops") + F.col("stop_times")).when(space == "route", F.col("trips")).when(space == "trip", F.col("stop_times")).otherwise(0)
    return keys.select(
        "space", "provider", "key", "route_stops", "trips", "stop_times", (space == "none").alias("nameless"), ((space == "stop") & (F.col("names") > 1)).alias("conflict"),
        ((space == "route") & (F.col("routes") > 0) & (lost | (F.col("route_stops") < 2))).alias("short"), ((asked > 0) & ((own == 0) | lost)).alias("unknown"),
    )


class Network(Snapshots):
    """The promoted tables of KEYS, all of one version: a pointer names a manifest of them, and a reader sees all old or all new."""

    def tables(self) -> dict[str, DataFrame]:
        """The active tables; none before the first promotion."""
        number = self._last()
        if not number:
            return {}
        manifest = json.loads(self.spark.read.text(f"{self.root}/ACTIVE-{number}", wholetext=True).first()[0])
        return {t: self.spark.read.parquet(f"{self.root}/{manifest['version']}/{t}") for t in manifest["tables"]}

    def promote_all(self, staged: dict[str, DataFrame], version: str) -> str:
        """Checks the staged tables, merges them with the active ones, writes all, and points to them; raises Refused if a gate is broken.

        Stops, routes and trips take the place of those with their key; a route's stops and a trip's times are
        replaced as a whole, and what the version doesn't name stays. Of staged rows with one key the last id wins. What
        fails before the pointer is there leaves the version before as it was. The staged tables are read for the gates and again
        to be merged, without a copy of their own: they must come from stored rows, and only what was promoted stays.
        """
        number = self._last()
        errors = cut(gate_errors(staged))
        if not errors.isEmpty():
            raise Refused(version, errors)
        old, written = self.tables(), f"v-{uuid.uuid4().hex}"
        times = staged["stop_times"].withColumn("time_source", time_source(F.lit(None).cast("string"), F.col("estimated"), F.coalesce("arrives", "departs"))).drop("estimated")
        for name, rows in (staged | {"stop_times": times}).items():
            if name not in KEYS:
                continue
            new = distinct_on(rows, KEYS[name], [F.desc("id")]).drop("observation")
            if name in old:
                whole = [k for k in KEYS[name] if k != "sequence"]
                new = old[name].join(rows.select(*whole).distinct(), whole, "left_anti").unionByName(new)
            new.write.parquet(f"{self.root}/{written}/{name}")
        self._point(number, {"version": written, "name": version, "tables": list(KEYS)})
        return written
