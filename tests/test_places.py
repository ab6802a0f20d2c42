"""Points that share places: pairs and walks are made by place, and are the same as between all points."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramline.operators import journey, spatial

AT = [(1, 22.0, 88.0), (2, 22.0, 88.0), (3, 22.0, 88.0), (4, 22.001, 88.0), (5, 22.001, 88.0), (6, 22.01, 88.001), (7, None, None), (8, 25.0, 88.0)]


def _stops(spark):
    return spark.createDataFrame(AT, "id bigint, lat double, lng double")


def _all_pairs(stops):
    return [(a, b, round(111194.9266 * ((ya - yb) ** 2 + ((xa - xb) * 0.9272) ** 2) ** 0.5)) for a, ya, xa in stops for b, yb, xb in stops if a != b and ya is not None and yb is not None]


@pytest.mark.parametrize("shared", [1, 2, 256])
def test_pairs_of_shared_places(spark, monkeypatch, shared):
    monkeypatch.setattr(spatial, "SHARED", shared)
    got = sorted((r["a"], r["b"]) for r in spatial.radius_pairs(_stops(spark), 600).collect())
    assert got == sorted((a, b) for a, b, d in _all_pairs(AT) if a < b and d <= 600)


def test_points_are_not_broadcast_and_measured_once_a_place(spark):
    plan = spatial.radius_pairs(_stops(spark), 600)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert spatial.place_pairs(spatial.places_of(_stops(spark)), 600).count() == 4 + 1  # each place with itself, and one pair of two and three points


@pytest.mark.parametrize("written", [False, True])
def test_walks_by_place(spark, written):
    held = {1: 5, 2: 9, 4: 3, 7: 1, 8: 2}
    labels = spark.createDataFrame(list(held.items()), "stop_id bigint, minutes bigint")
    walks = journey.Walks(_stops(spark), 600)
    got = {r["stop_id"]: r["minutes"] for r in journey.walk_round(labels, walks.written() if written else walks).collect()}
    want = {}
    for a, b, d in _all_pairs(AT):
        if d <= 600 and a in held:
            want[b] = min(want.get(b, 99), held[a] + max(1, int(d / 75 + 0.5)))
    assert got == want
    if written:
        rows = journey.walked(labels.withColumn("query", F.lit(1)), walks, ("query",)).collect()
        assert {r["stop_id"]: r["c"]["minutes"] for r in rows} == want
        assert all(r["c"]["frm"] != r["stop_id"] for r in rows)


def test_transfer_edges_are_one_join(spark, sf_dir):
    from tramline.plans import catalogue

    plan = catalogue.QUERIES["graph_transfer_edge"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_names_are_cut_once(spark, sf_dir):
    """Stops that share a name: the first ones by id, and no side that grows with the stops is broadcast."""
    from tramline.operators import search

    stops = spark.range(1, 400).select("id", F.when(F.col("id") % 3 == 0, "Old Bolt").when(F.col("id") % 3 == 1, "bolt").otherwise("ring").alias("name"))
    found = search.stops_by_name(spark.createDataFrame([(1, " BOLT "), (2, "ring")], "query bigint, name string"), stops, 3)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 4), (1, 7), (2, 2), (2, 5), (2, 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cut_up = plan[plan.index("Generate explode"):]
    assert "Aggregate [low" in cut_up and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_searches_start_from_every_place_and_ride_three_times(spark, sf_dir):
    """each place has its own stops at no minutes, and more is reached than two rides from one stop reach."""
    from tramline.plans import catalogue
    from tramline.plans.views import Views

    v = Views(spark, sf_dir)
    plan = catalogue.QUERIES["graph_plan"](spark, sf_dir).localCheckpoint()
    own = v.stops.join(v.places.withColumnRenamed("id", "origin"), "name").select("origin", F.col("id").alias("stop_id"))
    assert plan.filter("minutes = 0").select("origin", "stop_id").exceptAll(own).isEmpty() and own.exceptAll(plan.filter("minutes = 0").select("origin", "stop_id")).isEmpty()
    two = journey.reach_each(own.withColumn("minutes", F.lit(0)), v.calls, v.stops, rounds=2)
    one = journey.reach(own.filter("stop_id = 1").withColumn("minutes", F.lit(0)), v.calls, v.stops, rounds=3)
    assert plan.count() >= two.count() > one.count()


def test_many_searches_are_each_as_one(spark, sf_dir):
    """reach_each() gives each origin what reach() gives it alone, also where walks and labels tie."""
    from tramline.plans.views import Views

    v = Views(spark, sf_dir)
    origins = spark.createDataFrame([(7, 1, 0), (7, 12, 5), (8, 3, 2), (9, 40, 0)], "origin bigint, stop_id bigint, minutes int")
    many = journey.reach_each(origins, v.calls, v.stops, rounds=2)
    for o in (7, 8, 9):
        alone = journey.reach(origins.filter(F.col("origin") == o), v.calls, v.stops, rounds=2)
        assert sorted(map(tuple, many.filter(F.col("origin") == o).select("stop_id", "minutes").collect())) == sorted(map(tuple, alone.select("stop_id", "minutes").collect()))
