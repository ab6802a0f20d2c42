"""Concave outlines against a plain triangulation and erosion; rings with a reach against all pairs."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from test_polygons import inside, rings_of, table_of

from tramline.operators import outlines, polygons


def turn(a, b, c):
    return (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])


def in_circle(a, b, c, p):
    rows = [(q[1] - p[1], q[0] - p[0], (q[1] - p[1]) ** 2 + (q[0] - p[0]) ** 2) for q in (a, b, c)]
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = rows
    return (a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)) * (1 if turn(a, b, c) > 0 else -1)


def slow_triangles(pts):
    """All triples whose circle holds no other point."""
    return {frozenset(t) for t in combinations(pts, 3) if turn(*t) and not any(in_circle(*t, p) > 0 for p in pts if p not in t)}


def slow_outline(pts, concavity):
    """The corners that are left when the longest border edge goes, again and again."""
    left = slow_triangles(pts)
    edges = {frozenset(e) for t in left for e in combinations(t, 2)}
    lengths = [math.dist(*e) for e in edges]
    limit = min(lengths) + concavity * (max(lengths) - min(lengths))
    while True:
        border = [e for e in edges if sum(e <= t for t in left) == 1]
        corners = set().union(*border)
        free = [(math.dist(*e), t) for e in border for t in left if e <= t and not (t - e) <= corners]
        long = [f for f in free if f[0] > limit]
        if not long:
            return corners
        left.remove(max(long, key=lambda f: f[0])[1])


def triangles(pts):
    found = outlines.triangulate(pts)
    return {frozenset((pts[a], pts[b], pts[c])) for (a, b), c in found.items() if outlines.OUTSIDE not in (a, b, c)}


@pytest.mark.parametrize("seed", range(25))
def test_triangulation_and_erosion(seed):
    rng = random.Random(seed)
    pts = sorted({(rng.randrange(10**6), rng.randrange(10**6)) for _ in range(rng.randint(3, 15))})
    assert triangles(pts) == slow_triangles(pts)
    for concavity in (0.0, 0.3, 1.0):
        ring = outlines.concave_ring(pts, concavity)
        assert set(ring) == slow_outline(pts, concavity) and len(set(ring)) == len(ring)
        assert all(p in ring or inside(*p, ring) for p in pts)


def test_points_on_circles_and_lines():
    """A full square grid: every four points share a circle, every row a line."""
    for n in (2, 3, 9):
        pts = [(y, x) for y in range(n) for x in range(n)]
        assert len(triangles(pts)) == 2 * (n - 1) ** 2
        assert set(outlines.concave_ring(pts, 1.0)) == {p for p in pts if {0, n - 1} & set(p)}
    assert outlines.concave_ring([(k, 2 * k) for k in range(5)], 0.3) == [(0, 0), (4, 8)]
    assert outlines.concave_ring([(1, 1)], 0.3) == [(1, 1)]
    fan = [(0, 0), *((k, 1000) for k in range(12))]  # a line and one point beside it
    assert len(triangles(fan)) == 11


def test_concave_outlines(spark):
    """A horseshoe keeps its opening, groups over many tasks and with repeated rows equal the outline of all their points."""
    rng = random.Random(5)
    shoe = [(math.sin(a) * r, math.cos(a) * r) for a, r in ((rng.uniform(0.6, 5.7), rng.uniform(0.8, 1)) for _ in range(1500))]
    thin = [(rng.random(), rng.random()) for _ in range(40)]
    rows = [("shoe", *p) for p in shoe] + [("a b", *p) for p in thin] * 3 + [(None, 1.0, 1.0), (None, 2.0, 3.0), ("dot", 5.0, 5.0), ("dot", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, lat double, lng double").repartition(9)
    got = {r["k"]: r for r in outlines.concave_outlines(df, ["k"]).collect()}
    assert {k: (r["points"], r["corners"]) for k, r in got.items() if k in (None, "dot")} == {None: (2, 2), "dot": (1, 1)}
    whole = lambda pts: [(math.floor(y * 1e6 + 0.5), math.floor(x * 1e6 + 0.5)) for y, x in pts]
    assert [tuple(p) for p in got["a b"]["ring"]] == outlines.concave_ring(whole(thin), 0.3) and got["a b"]["points"] == 120
    ring = [tuple(p) for p in got["shoe"]["ring"]]
    assert all(p in ring or inside(*p, ring) for p in whole(shoe))
    assert not inside(0, 0, ring) and not inside(0, 900_000, ring) and 0.9 < got["shoe"]["area"] < 1.1  # the band has 0.92
    assert outlines.concave_outlines(df.limit(0), ["k"]).count() == 0


def test_cells_bound_what_is_triangulated(spark):
    """With few cells most points go before the triangulation; what lies outside then is less than a cell's diagonal away."""
    rng = random.Random(6)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame([("k", *p) for p in pts], "k string, lat double, lng double").repartition(5)
    places = [(math.floor(a * 1e6 + 0.5), math.floor(b * 1e6 + 0.5)) for a, b in pts]
    span = max(max(p[k] for p in places) - min(p[k] for p in places) for k in (0, 1))
    for cells in (4, 16):
        row = outlines.concave_outlines(df, ["k"], cells=cells).collect()[0]
        ring = [tuple(p) for p in row["ring"]]
        sides = list(zip(ring, [*ring[1:], ring[0]], strict=True))
        away = max(min(distance(p, a, b) for a, b in sides) for p in places if not inside(*p, ring))
        assert row["points"] == 3000 and away < (span / cells + 1) * math.sqrt(2)


def distance(p, a, b):
    length = math.dist(a, b) ** 2
    t = 0 if length == 0 else min(1, max(0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length))
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


@pytest.mark.parametrize("reach", [0, 40_000, 300_000])
def test_points_near_rings(spark, reach):
    rings, rng = rings_of(4), random.Random(4)
    pts = [(rng.randrange(-4_000_000, 7_000_000), rng.randrange(-4_000_000, 7_000_000)) for _ in range(300)] + [(0, -reach), (0, -reach - 1), (9_000_000 - reach, 9_000_000)]
    df = spark.createDataFrame([*((k, *p) for k, p in enumerate(pts)), (-1, None, 5)], "id bigint, y bigint, x bigint")
    got = sorted(map(tuple, polygons.within(df, table_of(spark, rings), reach).collect()))
    near = lambda p, r: inside(*p, r) or any(distance(p, a, b) <= reach for a, b in zip(r, [*r[1:], r[0]], strict=True))
    assert got == sorted((i, k) for i, p in enumerate(pts) for k, r in enumerate(rings) if near(p, r))
    assert polygons.within(df.limit(0), table_of(spark, rings), reach).count() == 0


def test_places_meet_a_widened_ring_once(spark):
    """Stops that share a place share its tests, and a cell held whole needs none: 20,000 stops at 100 places meet a ring in as
    many rows as there are places and less; repeated points and rings, also two rings of one name, still give each pair once."""
    rings, rng = {0: [(0, 0), (0, 900_000), (900_000, 900_000), (900_000, 0)], 1: [(-500_000, -500_000), (-500_000, 100_000), (100_000, 100_000), (100_000, -500_000)]}, random.Random(8)
    places = [(rng.randrange(-800_000, 1_200_000), rng.randrange(-800_000, 1_200_000)) for _ in range(100)]
    df = spark.createDataFrame([(k, *places[k % 100]) for k in range(20_000)], "id bigint, y bigint, x bigint")
    near = lambda p, r: inside(*p, r) or any(distance(p, a, b) <= 100_000 for a, b in zip(r, [*r[1:], r[0]], strict=True))
    want = sorted((i, k) for i in range(20_000) for k, r in rings.items() if near(places[i % 100], r))
    out = polygons.within(df, table_of(spark, list(rings.values())), 100_000)
    assert sorted(map(tuple, out.collect())) == want and out._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"  # no pair is shuffled
    held = polygons._reached_cells(table_of(spark, list(rings.values())), 100_000, polygons.CELL)
    assert held.filter("passed and not held").count() == 0 and held.filter("not held and size(edges) = 0").count() == 0
    one = spark.createDataFrame([(0, [{"y": y, "x": x} for y, x in r]) for r in rings.values()] * 2, "poly bigint, ring array<struct<y bigint, x bigint>>")
    again = df.filter("id < 100").unionByName(df.filter("id < 100")).unionByName(spark.createDataFrame([(0, 5, 5)], df.schema))
    got = sorted(map(tuple, polygons.within(again, one, 100_000).collect()))
    assert got == sorted({(i, 0) for i, _ in want if i < 100} | {(0, 0)})
