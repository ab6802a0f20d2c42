"""Distances on a sphere of radius 6 371 000 m and on the WGS 84 ellipsoid; cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6371000.0
CELL = 0.01


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # null stays null, which least() would skip


def distance_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - ({lng1})) / 2), 2))"
    return f"(12742000e0 * asin(CASE WHEN {a} > 1 THEN 1e0 ELSE sqrt({a}) END))"


AXIS_M, FLAT, STEPS = 6378137.0, 1 / 298.257223563, 12  # the ellipsoid, and how often the difference of longitude is corrected
SPHERE_SLACK = 1.006  # a distance on the sphere is at most so many times that on the ellipsoid, and the other way round


def _let(values: dict[str, Column], use) -> Column:
    """`use` of a struct of `values`, each of which is computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), use), 1)


def geodesic_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along the ellipsoid, to a millimetre, by Vincenty's inverse formula with STEPS corrections.

    Where they have not settled, which happens between nearly opposite points only, the distance is the sphere's.
    """
    minor = AXIS_M * (1 - FLAT)
    reduced = lambda lat: F.atan(F.lit(1 - FLAT) * F.tan(F.radians(lat)))

    def solve(p: Column) -> Column:
        s1, c1, s2, c2, apart = (p[k] for k in ("s1", "c1", "s2", "c2", "apart"))

        def arc(lam: Column) -> Column:
            x, y = c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam)
            return F.struct(F.sqrt(x * x + y * y).alias("sin"), (s1 * s2 + c1 * c2 * F.cos(lam)).alias("cos"), (c1 * c2 * F.sin(lam)).alias("k"))

        def along(a: Column) -> Column:
            sin_alpha = F.when(a["sin"] == 0, 0.0).otherwise(a["k"] / a["sin"])
            return F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), F.atan2(a["sin"], a["cos"]).alias("sigma"), sin_alpha.alias("alpha"), (1 - sin_alpha * sin_alpha).alias("sq"))

        def middle(b: Column) -> Column:
            mid = F.when(b["sq"] < 1e-14, 0.0).otherwise(b["cos"] - 2 * s1 * s2 / b["sq"])
            return F.struct(*[b[k].alias(k) for k in ("sin", "cos", "sigma", "alpha", "sq")], mid.alias("mid"), (FLAT / 16 * b["sq"] * (4 + FLAT * (4 - 3 * b["sq"]))).alias("c"))

        def parts(lam: Column) -> Column:
            return _let({"a": arc(lam)}, lambda v: _let({"b": along(v["a"])}, lambda w: middle(w["b"])))

        def step(state: Column, _: Column) -> Column:
            better = lambda m: apart + (1 - m["c"]) * FLAT * m["alpha"] * (m["sigma"] + m["c"] * m["sin"] * (m["mid"] + m["c"] * m["cos"] * (2 * m["mid"] * m["mid"] - 1)))
            return _let({"m": parts(state["lam"])}, lambda v: F.struct(better(v["m"]).alias("lam"), F.abs(better(v["m"]) - state["lam"]).alias("change")))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(apart.alias("lam"), F.lit(1.0).alias("change")), step)

        def metres(m: Column) -> Column:
            u = m["sq"] * ((AXIS_M * AXIS_M - minor * minor) / (minor * minor))
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            sq = m["mid"] * m["mid"]
            less = small * m["sin"] * (m["mid"] + small / 4 * (m["cos"] * (2 * sq - 1) - small / 6 * m["mid"] * (4 * m["sin"] * m["sin"] - 3) * (4 * sq - 3)))
            return minor * big * (m["sigma"] - less)

        return _let({"e": end}, lambda v: F.when(v["e"]["change"] < 1e-9, _let({"m": parts(v["e"]["lam"])}, lambda w: metres(w["m"]))))

    turn = F.radians(lng2 - lng1)
    apart = F.atan2(F.sin(turn), F.cos(turn))  # the shorter way round
    whole = _let({"u1": reduced(lat1), "u2": reduced(lat2), "apart": apart}, lambda v: _let({"s1": F.sin(v["u1"]), "c1": F.cos(v["u1"]), "s2": F.sin(v["u2"]), "c2": F.cos(v["u2"]), "apart": v["apart"]}, solve))
    return F.coalesce(whole, distance_m(lat1, lng1, lat2, lng2))


def geodesic_sql(points: str, lat: str, lng: str) -> str:
    """CTEs that end in geodesic(id, metres): of each row (id, lat, lng) of `points` to one place, step by step."""
    f, minor = repr(FLAT), repr(AXIS_M * (1 - FLAT))
    parts = """(SELECT *, CASE WHEN sq < 1e-14 THEN 0e0 ELSE c - 2 * sin(u1) * sin(u2) / sq END AS mid, {f} / 16 * sq * (4 + {f} * (4 - 3 * sq)) AS k FROM (SELECT *, 1 - al * al AS sq FROM (SELECT *, atan2(s, c) AS sg, CASE WHEN s = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / s END AS al FROM
 (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM steps))))""".replace("{f}", f)
    return f"""steps AS (SELECT id, atan((1 - {f}) * tan(radians({lat}))) AS u1, atan((1 - {f}) * tan(radians(lat))) AS u2, radians(lng - {lng}) AS l, radians(lng - {lng}) AS lam, 0 AS i FROM {points}
UNION ALL SELECT id, u1, u2, l, l + (1 - k) * {f} * al * (sg + k * s * (mid + k * c * (2 * mid * mid - 1))), i + 1 FROM {parts} WHERE i < {STEPS}),
ends AS (SELECT *, sq * {repr((AXIS_M**2 - (AXIS_M * (1 - FLAT)) ** 2) / (AXIS_M * (1 - FLAT)) ** 2)} AS u FROM {parts} WHERE i = {STEPS}),
series AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM ends),
geodesic AS (SELECT id, {minor} * big * (sg - small * s * (mid + small / 4 * (c * (2 * mid * mid - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))) AS metres FROM series)"""


def minutes_for(metres: Column, kmh: float) -> Column:
    """Whole minutes, one at least."""
    return F.greatest(F.lit(1), F.floor(metres / (kmh * 1000 / 60) + 0.5)).cast("int")


def cell(lat: Column, lng: Column, size: float = CELL) -> Column:
    return F.struct(F.floor(lat / size).alias("y"), F.floor(lng / size).alias("x"))


def bearing_box(lat: float, lng: float, metres: float) -> tuple[float, float, float, float]:
    """South, north, west and east of a circle, for filters that reach the scan."""
    import math

    dy = metres / 111_194.0 + 1e-9
    dx = dy / max(0.01, math.cos(math.radians(abs(lat) + dy)))
    return lat - dy, lat + dy, lng - dx, lng + dx
