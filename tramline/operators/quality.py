"""Data-quality gates, health and audits; each reads a table no more often than its groupings need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDIA = (6.0, 38.0, 68.0, 98.0)


def outside(box: tuple[float, float, float, float]) -> Column:
    return ~(F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3]))


def coordinate_audit(stops: DataFrame, box: tuple[float, float, float, float] = INDIA) -> DataFrame:
    """Per provider: total, missing, outside the box, and stops that share a point."""
    per = stops.groupBy("provider", "lat", "lng").agg(F.count("*").alias("n"))
    located = F.col("lat").isNotNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.groupBy("provider").agg(F.sum("n").alias("total"), n(~located).alias("missing"), n(located & outside(box)).alias("outside"), n(located & (F.col("n") > 1)).alias("shared"))


def coverage(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Per state of either table: stops, located stops, routes, and located stops in hundredths of a per cent."""
    s = stops.groupBy("state").agg(F.count("*").alias("stops"), F.count("lat").alias("located"))
    r = routes.groupBy("state").agg(F.count("*").alias("routes"))
    both = s.join(r, "state", "full").fillna(0)
    return both.withColumn("per_10000", F.when(F.col("stops") > 0, F.floor(F.col("located") * 10000 / F.col("stops"))).otherwise(0).cast("bigint"))


def gates(stops: DataFrame, routes: DataFrame, trips: DataFrame, calls: DataFrame) -> DataFrame:
    """All gates as rows: rule, severity, actual, passed. Only broken errors stop a promotion.

    Three aggregates feed them: stops by provider and name with how many are located and called at, calls by trip with
    their steps and times, and routes with whether they have trips. Stops and routes are read once, calls twice: by
    trip and by stop.
    """
    called = calls.select(F.col("stop_id").alias("id")).distinct().withColumn("called", F.lit(1))
    by_name = stops.join(called, "id", "left").groupBy("provider", F.lower("name").alias("k")).agg(F.count("*").alias("n"), F.count("lat").alias("located"), F.count("called").alias("called"))
    s = by_name.agg(*[F.coalesce(c, F.lit(0)).alias(a) for a, c in (("stops", F.sum("n")), ("located", F.sum("located")), ("orphans", F.sum("n") - F.sum("called")), ("twins", F.count_if(F.col("n") > 1)))])
    by_step = calls.groupBy("trip_id", "seq").agg(F.count("*").alias("n"), F.count("departs").alias("timed"))
    by_trip = by_step.groupBy("trip_id").agg(F.sum("n").alias("n"), F.count("*").alias("steps"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum("timed").alias("timed"))
    c = by_trip.agg(*[F.coalesce(x, F.lit(0)).alias(a) for a, x in (("calls", F.sum("n")), ("timed", F.sum("timed")), ("broken", F.count_if(F.expr("n <> steps or low <> 1 or high <> n"))), ("short", F.count_if(F.col("n") < 2)))])
    ridden = trips.select(F.col("route_id").alias("id")).distinct().withColumn("ridden", F.lit(1))
    r = routes.join(ridden, "id", "left").agg(F.count("*").alias("routes"), F.count(F.nullif("fare_inr", F.lit(0))).alias("fares"), (F.count("*") - F.count("ridden")).alias("empty"))
    share = lambda part, all_: F.floor(F.col(part) * 10000 / F.greatest(F.col(all_), F.lit(1))).cast("bigint")
    zero = lambda part: (F.col(part), F.col(part) == 0)
    most = lambda part, all_, least: (share(part, all_), (share(part, all_) >= least) | (F.col(all_) == 0))
    rules = [
        ("COORDINATE_COVERAGE_MIN_90", "WARNING", share("located", "stops"), share("located", "stops") >= 9000),
        ("DUPLICATE_STOPS_EXIST", "WARNING", *zero("twins")),
        ("ORPHAN_STOPS", "WARNING", *zero("orphans")),
        ("ROUTE_DISCONNECTED", "ERROR", *zero("empty")),
        ("STOP_SEQUENCE_INVALID", "ERROR", *zero("broken")),
        ("STOP_SEQUENCE_TOO_SHORT", "WARNING", *zero("short")),
        ("TIMETABLE_COVERAGE_LOW", "WARNING", *most("timed", "calls", 1000)),
        ("FARE_COVERAGE_LOW", "WARNING", *most("fares", "routes", 1000)),
    ]
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), actual.cast("bigint").alias("actual"), passed.alias("passed")) for rule, severity, actual, passed in rules])
    return s.crossJoin(c).crossJoin(r).select(F.explode(each).alias("g")).select("g.*")  # one row each


def counts(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Metric and number of rows (or of non-null values, for a column) of several tables, each read once."""
    out = None
    for df, metrics in tables.values():
        one = df.agg(*[F.count(c).alias(m) for m, c in metrics.items()])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in metrics])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def health(stops: DataFrame, raw: DataFrame, runs: DataFrame, age_days: Column) -> DataFrame:
    """Status of each provider of runs: SYNCING, STALE, DEGRADED, WARNING or HEALTHY, in that order."""
    last = runs.groupBy("provider").agg(F.max_by("status", F.struct("created_at", "id")).alias("last"), F.max("created_at").alias("synced"))
    s = stops.groupBy("provider").agg(F.count("*").alias("stops"), F.count("lat").alias("located"))
    r = raw.groupBy("provider").agg(F.count("*").alias("raw"))
    all_ = last.join(s, "provider", "left").join(r, "provider", "left").fillna(0, ["stops", "located", "raw"])
    status = F.when(F.col("last") == "RUNNING", "SYNCING").when(age_days > 7, "STALE").when(F.col("stops") == 0, "DEGRADED").when(F.col("located") * 5 < F.col("stops"), "WARNING").otherwise("HEALTHY")
    return all_.select("provider", "stops", "located", "raw", status.alias("status"))


def gap_examples(stops: DataFrame, most: int = 20) -> DataFrame:
    """Per kind of gap: how many, and up to `most` of the smallest ids."""
    from tramline.operators.relational import top_n

    kind = F.when(F.col("lat").isNull(), "missing").when(outside((22.0, 27.0, 86.0, 89.0)), "outside")
    gaps = stops.withColumn("kind", kind).filter("kind is not null").select("kind", "id")
    few = top_n(gaps, ["kind"], [F.col("id")], most).groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return gaps.groupBy("kind").agg(F.count("*").alias("n")).join(few, "kind")
