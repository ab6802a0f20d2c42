"""Containment and overlap of rings against all pairs."""

from __future__ import annotations

import random

import pytest

from tramline.operators import polygons

RING = "array<struct<y:bigint,x:bigint>>"


def inside(y, x, ring):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > y) != (y2 > y):
            left, right = (x - x1) * (y2 - y1), (y - y1) * (x2 - x1)
            odd ^= left < right if y2 > y1 else left > right
    return odd


def turn(a, b, p):
    v = (b[1] - a[1]) * (p[0] - a[0]) - (b[0] - a[0]) * (p[1] - a[1])
    return (v > 0) - (v < 0)


def meet(a, b, c, d):
    on = lambda s, e, p: s == 0 and min(s_[0] for s_ in e) <= p[0] <= max(s_[0] for s_ in e) and min(s_[1] for s_ in e) <= p[1] <= max(s_[1] for s_ in e)
    w, x, y, z = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return (w * x < 0 and y * z < 0) or on(w, (a, b), c) or on(x, (a, b), d) or on(y, (c, d), a) or on(z, (c, d), b)


def share(p, q):
    edges = lambda r: list(zip(r, [*r[1:], r[0]], strict=True))
    return any(meet(*e, *f) for e in edges(p) for f in edges(q)) or inside(*p[0], q) or inside(*q[0], p)


def star(rng, y, x, size, corners):
    """A ring around a place, concave more often than not: corners at random reach, in the order of their directions."""
    import math

    out = []
    for k in range(corners):
        r = size * rng.uniform(0.2, 1)
        out.append((round(y + r * math.sin(2 * math.pi * k / corners)), round(x + r * math.cos(2 * math.pi * k / corners))))
    return out


def rings_of(seed):
    rng = random.Random(seed)
    rings = [star(rng, rng.randrange(-3_000_000, 3_000_000), rng.randrange(-3_000_000, 3_000_000), rng.choice([30_000, 400_000, 2_500_000]), rng.choice([3, 5, 12])) for _ in range(40)]
    box = lambda y, x, h, w: [(y, x), (y, x + w), (y + h, x + w), (y + h, x)]
    rings += [box(0, 0, 100_000, 100_000), box(0, 100_000, 100_000, 100_000), box(100_000, 200_000, 50_000, 50_000), box(10_000, 10_000, 10_000, 10_000), box(9_000_000, 9_000_000, 65536, 65536), box(0, 0, 100_000, 100_000)]
    rings += [[(5_000_000, 5_000_000), (5_000_000, 6_000_000), (6_000_000, 6_000_000), (6_000_000, 5_900_000), (5_100_000, 5_900_000), (5_100_000, 5_000_000)], box(5_200_000, 5_200_000, 100_000, 100_000)]
    return rings


def table_of(spark, rings):
    return spark.createDataFrame([(k, [{"y": y, "x": x} for y, x in r]) for k, r in enumerate(rings)], f"poly bigint, ring {RING}")


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_rings(spark, seed):
    rings, rng = rings_of(seed), random.Random(seed)
    pts = [(rng.randrange(-4_000_000, 7_000_000), rng.randrange(-4_000_000, 7_000_000)) for _ in range(400)]
    pts += [c for r in rings for c in r] + [(0, 50_000), (50_000, 100_000), (65536, 65536), (9_000_000 + 32768, 9_000_000 + 32768), (5_250_000, 5_250_000)]
    df = spark.createDataFrame([*((k, *p) for k, p in enumerate(pts)), (-1, None, 5)], "id bigint, y bigint, x bigint")
    got = sorted(map(tuple, polygons.locate(df, table_of(spark, rings)).collect()))
    assert got == sorted((i, k) for i, p in enumerate(pts) for k, r in enumerate(rings) if inside(*p, r))
    area = lambda r: abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, [*r[1:], r[0]], strict=True)))
    best = {r["id"]: r["poly"] for r in polygons.smallest_around(df, table_of(spark, rings)).collect()}
    assert best == {-1: None} | {i: min(((area(r), k) for k, r in enumerate(rings) if inside(*p, r)), default=(0, None))[1] for i, p in enumerate(pts)}


def test_rings_that_share_a_point(spark):
    rings = rings_of(3)
    got = sorted(map(tuple, polygons.overlaps(table_of(spark, rings)).collect()))
    assert got == [(a, b) for a in range(len(rings)) for b in range(a + 1, len(rings)) if share(rings[a], rings[b])]


def test_rings_of_little(spark):
    few = table_of(spark, [[], [(0, 0)], [(0, 0), (5, 5)]])
    pts = spark.createDataFrame([(1, 0, 0)], "id bigint, y bigint, x bigint")
    assert polygons.locate(pts, few).count() == 0 and polygons.overlaps(few).count() == 0
    assert [tuple(r) for r in polygons.smallest_around(pts, few).collect()] == [(1, None)]
    assert polygons.locate(pts.limit(0), table_of(spark, rings_of(1))).count() == 0


def test_smallest_ring_by_cells(spark):
    """Many nested and shared squares: the least of those around each place, whether a cell is all inside it or not; no side is broadcast."""
    c = polygons.CELL
    square = lambda y, x, r: [(y - r, x - r), (y - r, x + r), (y + r, x + r), (y + r, x - r)]
    rings = [(k, square(c * (k % 4), c * (k % 3), c * (2 + k % 5))) for k in range(40)]
    pts = [(i, (i * 37) % (9 * c) - 3 * c + 1, (i * 4099) % (8 * c) - 3 * c + 1) for i in range(0, 40 * 7919, 7919)]
    pts += [(10**6 + i, y, x) for i, y, x in pts[:10]] + [(5, None, None)]
    df, table = spark.createDataFrame(pts, "id bigint, y bigint, x bigint"), spark.createDataFrame(rings, "poly bigint, ring array<struct<y:bigint,x:bigint>>")
    got = {r["id"]: r["poly"] for r in polygons.smallest_around(df, table).collect()}
    around = lambda y, x: [(abs(2 * (ring[2][0] - ring[0][0])), k) for k, ring in rings if ring[0][0] < y < ring[2][0] and ring[0][1] < x < ring[2][1]]
    assert got == {i: min(around(y, x))[1] if y is not None and around(y, x) else None for i, y, x in pts}
    plan = polygons.smallest_around(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_overlaps_broadcast_no_cells(spark, sf_dir):
    """cells of rings are many times what their file says, so the border cells aren't sent through the driver."""
    from tramline.plans import catalogue

    plan = catalogue.QUERIES["join_spatial_overlap"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
