"""Repairs on rows written by hand: nulls, ties, repeats and empty tables."""

from __future__ import annotations

from tramline.operators import repair
from pyspark.sql import functions as F


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_reconcile(spark):
    seed = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d"), (6, None)], "id bigint, name string")
    live = spark.createDataFrame([(2, "b", 3), (3, None, 0), (4, "D", 1), (5, "e", 0), (6, "f", 2)], "id bigint, name string, uses bigint")
    assert got(repair.reconcile(seed, live, "id", "name", "uses")) == got(spark.createDataFrame([(1, "STALE", "a", None, False), (2, "SAME", "b", "b", False), (3, "SAME", None, None, True), (4, "RENAMED", "d", "D", False), (5, "MISSING", None, "e", True), (6, "RENAMED", None, "f", False)], "a bigint, b string, c string, d string, e boolean"))
    assert repair.reconcile(seed.limit(0), live.limit(0), "id", "name", "uses").count() == 0


def test_doubtful_coordinates(spark):
    rows = [(1, "b", None, 1.0, "x"), (2, "a", None, None, "x"), (3, "c", 5.0, 5.0, "x"), (4, "d", 5.0, 5.0, "t"), (5, "e", 50.0, 5.0, "x"), (6, "f", 50.0, 5.0, "x"), (7, "g", 6.0, 6.0, None), (8, "h", 6.0, 6.0, None), (9, "i", 7.0, 7.0, "x"), (10, None, None, None, "t")]
    stops = spark.createDataFrame(rows, "id bigint, name string, lat double, lng double, provider string")
    out = repair.coordinate_candidates(stops, (0.0, 10.0, 0.0, 10.0), F.col("provider") == "t")
    assert got(out.select("reason", "rank", "id")) == [("missing", 1, 2), ("missing", 2, 1), ("outside", 1, 5), ("outside", 2, 6), ("shared", 1, 3), ("shared", 2, 7), ("shared", 3, 8)]


def test_routes_without_stops(spark):
    routes = spark.createDataFrame([(1, "Alpha to New Town (East)"), (2, "ALPHA - New Town  Suburban Railway"), (3, "Circular"), (4, "Alpha to Beta"), (5, None), (6, "A to B to  Alpha ")], "id bigint, name string")
    stops = spark.createDataFrame([(9, "alpha"), (7, "Alpha"), (8, "Beta")], "id bigint, name string")
    new, links = repair.connect_routes(routes, spark.createDataFrame([(4,)], "route_id bigint"), stops)
    assert got(new) == [("stop_a", "A"), ("stop_new_town", "New Town")]
    assert got(links) == [(1, 1, 7, None), (1, 2, None, "stop_new_town"), (2, 1, 7, None), (2, 2, None, "stop_new_town"), (6, 1, None, "stop_a"), (6, 2, 7, None)]


def test_better_places(spark):
    places = spark.createDataFrame([(1, 1.0, 1.0, 0.5, "O"), (2, None, None, None, None), (3, 3.0, 3.0, 0.9, "O"), (4, 4.0, 4.0, None, "O")], "id bigint, lat double, lng double, confidence double, source string")
    stops = [(1, 10, 9.0, 9.0, 0.7, "A"), (1, 9, 8.0, 8.0, 0.7, "B"), (1, 8, None, 8.0, 0.99, "C"), (2, 1, 2.0, 2.0, 0.0, "A"), (2, 2, 2.5, 2.5, 0.1, "A"), (3, 3, 5.0, 5.0, 0.9, "A"), (99, 4, 5.0, 5.0, 0.9, "A")]
    matched = spark.createDataFrame(stops, "place_id bigint, id bigint, lat double, lng double, confidence double, provider string")
    assert got(repair.upgrade_places(places, matched)) == [(1, 8.0, 8.0, 0.7, "B", True), (2, 2.5, 2.5, 0.1, "A", True), (3, 3.0, 3.0, 0.9, "O", False), (4, 4.0, 4.0, None, "O", False)]


def test_submitted_routes_and_feeds(spark):
    routes = spark.createDataFrame([(1, "r", 1, "PUBLISHED", 5), (2, "s", 1, "DRAFT", 5), (3, "t", 2, "PUBLISHED", None), (4, "u", 1, "PUBLISHED", None)], "id bigint, name string, operator_id bigint, state string, fare bigint")
    operators = spark.createDataFrame([(1, "Op", "VERIFIED"), (2, "No", "PENDING")], "id bigint, name string, status string")
    stops = spark.createDataFrame([(1, 2, "B", None), (1, 1, "A", "06:00"), (2, 1, "Z", None)], "route_id bigint, sequence int, stop_name string, departs string")
    out = repair.submitted_routes(routes, operators, stops)
    rows = {r["id"]: [tuple(s) for s in r["stops"]] for r in out.collect()}
    assert rows == {1: [(1, "A", "06:00"), (2, "B", None)], 4: []}
    again = repair.submitted_routes(routes, operators, stops.orderBy("stop_name"))
    assert got(out.select("id", "content_hash")) == got(again.select("id", "content_hash"))
    assert got(out.select("content_hash")) != got(repair.submitted_routes(routes, operators, stops.withColumn("stop_name", F.lower("stop_name"))).select("content_hash"))
    feed = [("1", "A ", "1.5", "2", None), ("2", "B", " 91 ", "2", ""), ("3", "C", "x", "2", "0"), ("4", "D", "1", "2", "1"), ("5", "", "1", "2", "0"), ("6", None, "1", "2", ""), ("7", "G", "NaN", "2", ""), ("8", "H", "-90", "-180", " 0 ")]
    assert got(repair.feed_nodes(spark.createDataFrame(feed, "stop_id string, stop_name string, stop_lat string, stop_lon string, location_type string"))) == [("1", "A", 1.5, 2.0), ("8", "H", -90.0, -180.0)]
    told = [(1, 5, " a ", 10, 0.0, 0.0), (1, 6, "b", None, 1.0, 0.0), (1, 7, "c", 3, 1.0, 1.0), (2, 5, "d", 3, None, None)]
    out = repair.api_pattern(spark.createDataFrame(told, "route_id bigint, station_id bigint, name string, route_order int, lat double, lng double"))
    assert got(out) == [(1, 1, 6, "b", 1.0, 0.0), (1, 2, 7, "c", 1.0, 1.0), (1, 3, 5, "a", None, None), (2, 1, 5, "d", None, None)]
