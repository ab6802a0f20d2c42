"""Concave outlines of point groups: a triangulation, eroded from outside where its edges are long.

The outline is the characteristic shape of Duckham et al. (2008): from the convex outline of the Delaunay triangulation,
the longest border edge goes, with its triangle, as long as it is longer than a limit and the triangle's third corner is
not on the border yet, so that the ring stays simple and holds all points.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.polygons import micro, ring_area
from tramline.operators.spatial import hull_of
from tramline.session import cut

CELLS = 64  # along the longer side of a group's box, at most
OUTSIDE = -1  # the corner of the triangles beyond the convex outline


def triangulate(pts: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Delaunay triangulation of different integer points, not all on one line: each directed edge with its triangle's third corner.

    Points are added one by one in a fixed random order; each is found by a walk from the one before, and opens the
    triangles whose circles hold it. Python's whole numbers keep every test exact.
    """
    third: dict[tuple[int, int], int] = {}

    def side(a: int, b: int, c: int) -> int:
        (ay, ax), (by, bx), (cy, cx) = pts[a], pts[b], pts[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def put(a: int, b: int, c: int) -> None:
        third[a, b] = c
        third[b, c] = a
        third[c, a] = b

    def opened(a: int, b: int, c: int, p: int) -> bool:
        if OUTSIDE in (a, b, c):
            while c != OUTSIDE:
                a, b, c = b, c, a
            turn = side(a, b, p)
            if turn:
                return turn > 0
            (ay, ax), (by, bx), (py, px) = pts[a], pts[b], pts[p]
            return (ax - px) * (bx - px) + (ay - py) * (by - py) < 0  # on the edge itself
        py, px = pts[p]
        (ay, ax), (by, bx), (cy, cx) = ((y - py, x - px) for y, x in (pts[a], pts[b], pts[c]))
        one, two, three = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return one * (bx * cy - cx * by) - two * (ax * cy - cx * ay) + three * (ax * by - bx * ay) > 0

    def find(p: int, edge: tuple[int, int]) -> tuple[int, int]:
        """An edge of a triangle that p opens."""
        a, b = edge
        while True:
            c = third[a, b]
            if c == OUTSIDE:
                return a, b
            beyond = next(((v, u) for u, v in ((a, b), (b, c), (c, a)) if side(u, v, p) < 0), None)
            if beyond is None:
                return a, b
            a, b = beyond

    order = random.Random(0).sample(range(len(pts)), len(pts))
    a, b = order[:2]
    c = next(k for k in order[2:] if side(a, b, k))
    if side(a, b, c) < 0:
        a, b = b, a
    put(a, b, c)
    for u, v in ((a, b), (b, c), (c, a)):
        put(v, u, OUTSIDE)
    last = (a, b)
    for p in order[2:]:
        if p == c:
            continue
        stack, seen, rim = [find(p, last)], set(), []
        while stack:
            u, v = stack.pop()
            if (u, v) in seen:
                continue
            w = third[u, v]
            own = ((u, v), (v, w), (w, u))
            seen.update(own)
            for e in own:
                back = e[1], e[0]
                if back not in seen and opened(*back, third[back], p):
                    stack.append(back)
        rim = [(u, v) for u, v in seen if (v, u) not in seen]
        for e in seen:
            del third[e]
        for u, v in rim:
            put(u, v, p)
            if OUTSIDE not in (u, v):
                last = (u, v)
    return third


def concave_ring(pts: list[tuple[int, int]], concavity: float) -> list[tuple[int, int]]:
    """The outline in order; `concavity` 1 is the convex one, with all points on it. The ends, for points on one line.

    The limit lies `concavity` of the way from the shortest edge of the triangulation to the longest.
    """
    pts = sorted(set(pts))
    hull = hull_of(np.array(pts, np.int64).reshape(-1, 2))
    if len(hull) < 3:
        return hull
    third = triangulate(pts)
    long = lambda e: math.dist(pts[e[0]], pts[e[1]])
    lengths = [long(e) for e in third if OUTSIDE not in e]
    limit = min(lengths) + concavity * (max(lengths) - min(lengths))
    after = {v: u for u, v in third if OUTSIDE not in (u, v) and third[u, v] == OUTSIDE}
    border = [(-long(e), e) for e in after.items()]
    heapq.heapify(border)
    while border and -border[0][0] > limit:
        u, v = heapq.heappop(border)[1]
        w = third[u, v]
        if w not in after:
            after[u], after[w] = w, v
            for e in ((u, w), (w, v)):
                heapq.heappush(border, (-long(e), e))
    ring = [min(after)]
    while after[ring[-1]] != ring[0]:
        ring.append(after[ring[-1]])
    return [pts[k] for k in ring]


def _by_cell(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corners of the outline of each run of rows with one k; runs are those of each frame, sorted, and go on in the next one."""
    key, held = None, np.empty((0, 2), np.int64)
    for frame in frames:
        frame = frame.sort_values("k", kind="stable")
        keys, pts, rows = frame["k"].to_numpy(object), frame[["y", "x"]].to_numpy(np.int64), []
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(starts, starts[1:], strict=False):
            if low == high:
                continue
            if keys[low] != key:
                rows += [(key, y, x) for y, x in hull_of(held)]
                key, held = keys[low], held[:0]
            held = np.array(hull_of(np.concatenate((held, pts[low:high]))), np.int64).reshape(-1, 2) if len(held) else pts[low:high]
        yield pd.DataFrame(rows, columns=["k", "y", "x"])
    yield pd.DataFrame([(key, y, x) for y, x in hull_of(held)], columns=["k", "y", "x"])


def concave_outlines(points: DataFrame, keys: list[str], concavity: float = 0.3, cells: int = CELLS) -> DataFrame:
    """Concave outline of each key's located points: keys, points (with repeated ones), ring, corners and area (square degrees).

    A group's box is cut into at most cells x cells cells, and of a cell only the corners of its own convex outline go on
    to the triangulation. So what one task triangulates is bounded by the cells, however many rows a group has, and every
    task thins its own rows before they move. The result is that of all points where no cell has a point inside its own
    outline. Elsewhere a notch may differ within a cell, and a point that was thinned away may lie outside the ring, by less
    than the diagonal of a cell, as the corners around it are inside or on it.
    Null keys are keys; points without place are left out; a group in one place or on one line has one or two corners and
    no area; an empty table gives an empty result.
    """
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    p = points.filter("lat is not null and lng is not null").select(F.to_json(F.struct(*keys)).alias("k"), micro(F.col("lat")).alias("y"), micro(F.col("lng")).alias("x"))
    box = cut(p.groupBy("k").agg(F.count("*").alias("points"), F.min("y").alias("south"), F.min("x").alias("west"), F.max("y").alias("north"), F.max("x").alias("east")))
    side = F.greatest(F.lit(1), F.floor(F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west")) / cells) + 1).cast("bigint")
    cell = lambda c, low: F.floor((F.col(c) - F.col(low)) / side).cast("string")
    placed = p.join(box, "k").select(F.concat_ws(" ", cell("y", "south"), cell("x", "west"), "k").alias("k"), "y", "x")
    some = placed.mapInPandas(_by_cell, "k string, y bigint, x bigint").repartition("k").sortWithinPartitions("k")
    thin = some.mapInPandas(_by_cell, "k string, y bigint, x bigint").select(F.expr("substring(k, length(substring_index(k, ' ', 2)) + 2)").alias("k"), "y", "x")

    def outline(frame: pd.DataFrame) -> pd.DataFrame:
        ring = concave_ring(list(zip(frame["y"].tolist(), frame["x"].tolist(), strict=True)), concavity)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "ring": [[{"y": y, "x": x} for y, x in ring]]})

    rings = thin.groupBy("k").applyInPandas(outline, "k string, ring array<struct<y:bigint,x:bigint>>").join(box.select("k", "points"), "k")
    return rings.select(F.from_json("k", kinds).alias("k"), "points", "ring").select("k.*", "points", "ring", F.size("ring").alias("corners"), ring_area(F.col("ring")).alias("area"))
