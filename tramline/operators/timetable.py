"""Timetables: order, gaps, interpolation and repair of the calls of a trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.functions.geo import distance_m
from tramline.functions.timeofday import from_minutes

ORDER = ("seq", "stop_id", "platform")


def along(*order: str) -> W:
    return W.partitionBy("trip_id").orderBy(*(order or ORDER))


def resequence(calls: DataFrame) -> DataFrame:
    """Calls numbered 1..n in each trip."""
    return calls.withColumn("pos", F.row_number().over(along()))


def prefer(calls: DataFrame) -> DataFrame:
    """One call for each (trip, stop, seq): with a departure, then a scraped one, then the lowest platform."""
    score = 4 * F.col("departs").isNotNull().cast("int") + (F.col("time_source") == "SCRAPED").cast("int")
    w = W.partitionBy("trip_id", "stop_id", "seq").orderBy(F.desc(score), "platform", F.asc_nulls_last("departs"), "time_source")
    return calls.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hop_metres(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """Calls with pos, lat, lng and metres from the call before; null where either is unlocated."""
    p = resequence(calls).join(stops.select(F.col("id").alias("stop_id"), "lat", "lng"), "stop_id", "left")
    w = along("pos")
    return p.withColumn("metres", distance_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")))


def cumulative(calls: DataFrame, stops: DataFrame) -> DataFrame:
    total = F.sum(F.coalesce("metres", F.lit(0.0))).over(along("pos").rowsBetween(W.unboundedPreceding, 0))
    return hop_metres(calls, stops).withColumn("total", total)


def anchors(calls: DataFrame) -> DataFrame:
    """pos with the minutes of the nearest timed call at or before and at or after."""
    w = along("pos")
    timed = F.when(F.col("departs").isNotNull(), F.col("minute"))
    p = resequence(calls).withColumn("timed", timed)
    before = F.last("timed", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("timed", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return p.withColumn("before", before).withColumn("after", after)


def interpolate(calls: DataFrame, stops: DataFrame) -> DataFrame:
    """Untimed calls between two timed ones get a time by distance, or by position if none is known.

    A span that goes back passes midnight; an empty one is left alone; nothing is extrapolated, and a stretch
    with a hop that can't be measured is left alone too. Minutes are rounded before they are written.
    """
    w = along("pos")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    p = cumulative(calls, stops).withColumn("timed", F.when(F.col("departs").isNotNull(), F.col("minute")))
    mark = lambda c: F.when(F.col("timed").isNotNull(), F.col(c))
    for name, frame, pick in (("0", back, F.last), ("1", ahead, F.first)):
        for c in ("timed", "total", "pos"):
            p = p.withColumn(f"{c}{name}", pick(mark(c), ignorenulls=True).over(frame))
    # Unmeasured hops up to here, and up to the next anchor: the same number at both anchors means none between.
    p = p.withColumn("holes", F.sum(F.col("metres").isNull().cast("int")).over(back))
    p = p.withColumn("holes0", F.last(mark("holes"), ignorenulls=True).over(back)).withColumn("holes1", F.first(mark("holes"), ignorenulls=True).over(ahead))
    span = F.when(F.col("timed1") < F.col("timed0"), F.col("timed1") - F.col("timed0") + 1440).otherwise(F.col("timed1") - F.col("timed0"))
    way = F.col("total1") - F.col("total0")
    share = F.when(way > 0, (F.col("total") - F.col("total0")) / way).otherwise((F.col("pos") - F.col("pos0")) / (F.col("pos1") - F.col("pos0")))
    ok = F.col("timed").isNull() & (span > 0) & (F.col("holes0") == F.col("holes1"))
    minute = F.floor(F.col("timed0") + span * share + 0.5) % 1440
    return p.select("trip_id", "pos", "stop_id", F.when(ok, from_minutes(minute)).otherwise(F.col("departs")).alias("departs"), F.when(ok, "INTERPOLATED").otherwise(F.when(F.col("departs").isNotNull(), F.col("time_source"))).alias("time_source"))


def monotonic(calls: DataFrame) -> DataFrame:
    """Calls that are not earlier than any call before them in the trip, as many as a pass that drops such calls keeps."""
    top = F.max("minute").over(along().rowsBetween(W.unboundedPreceding, -1))
    return calls.withColumn("_top", top).filter("_top is null or minute >= _top").drop("_top")


def backwards(calls: DataFrame) -> DataFrame:
    """Per trip, how many calls are earlier than the last timed call before them."""
    timed = F.when(F.col("departs").isNotNull(), F.col("minute"))
    last = F.last(timed, ignorenulls=True).over(along().rowsBetween(W.unboundedPreceding, -1))
    return calls.withColumn("_back", (timed < last).cast("int")).groupBy("trip_id").agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("backwards"))


def prorated_fare(fare: Column, ridden: Column, total: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(fare * ridden / total)).cast("bigint")


def distance_fare(km: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(km * 1.5 + 0.5)).cast("bigint")
