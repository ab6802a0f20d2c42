"""Operators against straightforward Python."""

from __future__ import annotations

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.operators import journey, lifecycle, mapping, relational, resolve, spatial, timetable
from tramline.sources import archives, feeds, pages
from tramline.streaming import landing


def metres(lat1, lng1, lat2, lng2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(a)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("lat", "lng", "wide", "limit"), [(22, 88, 0.1, 1500), (65, 10, 0.1, 1500), (-65, 179.95, 0.1, 1500), (89.9, -180, 360, 4000), (-89.97, 0, 360, 30_000), (0, 180, 0.1, 1500)])
def test_radius_pairs_match_all_pairs(spark, lat, lng, wide, limit):
    rng = random.Random(5)
    pts = [(i, lat + rng.random() / 10, (lng + rng.random() * wide + 180) % 360 - 180) for i in range(120)] + [(900, None, None)]
    got = {(r["a"], r["b"]) for r in spatial.radius_pairs(spark.createDataFrame(pts, "id bigint, lat double, lng double"), limit).collect()}
    want = {(a[0], b[0]) for a in pts[:-1] for b in pts[:-1] if a[0] < b[0] and metres(a[1], a[2], b[1], b[2]) <= limit}
    assert got == want and want


def slow_dbscan(pts, eps, least):
    """Cluster of each row of (row, key, lat, lng): the smallest core row that it is connected to, or None."""
    near = [[j for j, b in enumerate(pts) if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= eps * eps] for a in pts]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    label = {}
    for i in sorted(core, key=lambda i: pts[i][0]):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = pts[i][0]
                todo += [k for k in near[j] if k in core]
    return {pts[i][0]: (i in core, label.get(i, min((label[j] for j in near[i] if j in core), default=None))) for i in range(len(pts))}


@pytest.mark.parametrize("spread", [0.6, 1.5, 4.0])
def test_dbscan_equals_its_definition(spark, spread):
    rng, pts = random.Random(int(spread * 10)), []
    for key in ("a", "b", None):
        for _ in range(6):
            y, x = 20 + rng.random() * spread * 3, 80 + rng.random() * spread * 3
            pts += [(key, y + rng.gauss(0, 0.25), x + rng.gauss(0, 0.25)) for _ in range(rng.choice([2, 4, 12]))]
        pts += [(key, 20 + rng.random() * spread * 3, 80 + rng.random() * spread * 3) for _ in range(15)]
        pts += [(key, 30.0, 90.0)] * 5 + [(key, 30.0, 90.5), (key, 30.0, 91.0)] + [(key, -5.0, -5.0)] * 3  # as far as eps; too few
    order = rng.sample(range(len(pts)), len(pts))
    data = [(i, *p) for i, p in zip(order, pts, strict=True)]
    df = spark.createDataFrame([*data, (999, "a", None, None)], "id bigint, key string, lat double, lng double")
    out = spatial.dbscan(df, "key")
    assert {r["id"]: (r["core"], r["cluster"]) for r in out.collect()} == slow_dbscan(data, 0.5, 5)
    own = {}
    for i, key, lat, lng in data:
        own.setdefault((key, slow_cluster(data)[i]), set()).add((math.floor(lat * 1e6 + 0.5), math.floor(lng * 1e6 + 0.5)))
    hulls = {(r["key"], r["cluster"]): r for r in spatial.hulls(out.filter("cluster is not null"), ["key", "cluster"]).collect()}
    assert set(hulls) == {k for k in own if k[1] is not None}
    for k, got in hulls.items():
        assert {(p["y"], p["x"]) for p in got["ring"]} == slow_corners(own[k]) and got["corners"] == len(slow_corners(own[k]))
        assert round(got["south"], 9) == round(min(y for y, _ in own[k]) / 1e6 - 0.1, 9) and round(got["east"], 9) == round(max(x for _, x in own[k]) / 1e6 + 0.1, 9)
    assert spatial.dbscan(df.limit(0), "key").count() == 0


def slow_corners(pts):
    """Points that are in no segment between and in no triangle of others: those with a line that has all others strictly on one side."""
    out = set()
    for p in pts:
        others = [(a[0] - p[0], a[1] - p[1]) for a in pts if a != p]
        angles = sorted(math.atan2(*a) for a in others)
        gaps = [b - a for a, b in zip(angles, angles[1:], strict=False)] + [angles[0] + 2 * math.pi - angles[-1]] if angles else [7]
        if max(gaps) > math.pi + 1e-9:
            out.add(p)
    return out


def test_hull_keeps_every_corner(spark):
    """Sixteen points on a circle inside one cell, an edge with points on it, a line, a point; over many tasks."""
    ring = [(22.25 + 0.2 * math.sin(k * math.pi / 8), 88.25 + 0.2 * math.cos(k * math.pi / 8)) for k in range(16)]
    pts = [("circle", *p) for p in ring] + [("circle", 22.25 + k / 1000, 88.25) for k in range(50)]
    pts += [("box", float(y), float(x)) for y in range(4) for x in range(4)] + [("line", 1.0 + k, 2.0 + k) for k in range(5)] + [("dot", 1.0, 1.0)] * 3 + [(None, 0.0, float(k % 2)) for k in range(4)] + [("dot", None, 1.0)]
    df = spark.createDataFrame(pts, "k string, lat double, lng double").repartition(6)
    got = {r["k"]: (r["corners"], round(r["area"], 6)) for r in spatial.hulls(df, ["k"]).collect()}
    assert got.pop("circle")[0] == 16
    assert got == {"box": (4, 9.0), "line": (2, 0.0), "dot": (1, 0.0), None: (2, 0.0)}
    assert spatial.hulls(df.limit(0), ["k"]).count() == 0


def slow_cluster(data, known={}):  # noqa: B006
    if id(data) not in known:
        known[id(data)] = {i: c for i, (_, c) in slow_dbscan(data, 0.5, 5).items()}
    return known[id(data)]


def slow_greedy(stops, busy, limit):
    """The pass over stops in order: each joins the first survivor of its name that is near and of a compatible state."""
    out, heads = {}, {}
    for i, name, state, lat, lng in sorted(stops, key=lambda s: (-busy.get(s[0], 0), not s[2], s[0])):
        out[i] = i
        if lat is None:
            continue
        own = heads.setdefault("".join(c for c in (name or "").lower() if c.isascii() and c.isalnum()), [])
        for h in own:
            if (not h[2] or not state or h[2] == state) and metres(h[3], h[4], lat, lng) <= limit:
                out[i] = h[0]
                break
        else:
            own.append((i, name, state, lat, lng))
    return out


@pytest.mark.parametrize("wide", [0.002, 0.01])
def test_cluster_greedy_equals_a_pass_in_order(spark, wide):
    rng = random.Random(int(wide * 1000))
    stops = [(i, rng.choice(["Garia", "GARIA.", "Park", "পার্ক", None]), rng.choice(["WB", "OD", "", None]), 22 + rng.random() * wide, 88 + rng.random() * wide) for i in range(400)]
    stops += [(500 + i, "Row", "WB", 22 + i * 0.001, 88.0) for i in range(40)] + [(600 + i, "Spot", rng.choice(["WB", ""]), 22.5, 88.5) for i in range(60)] + [(700, "Park", "WB", None, None)]
    busy = {i: rng.randint(0, 6) for i in rng.sample(range(760), 300)}
    got = resolve.cluster_greedy(spark.createDataFrame([(i, n, "p", s, a, b) for i, n, s, a, b in stops], "id bigint, name string, provider string, state string, lat double, lng double"), spark.createDataFrame(list(busy.items()), "stop_id bigint, services bigint"))
    assert {r["id"]: r["survivor"] for r in got.collect()} == slow_greedy(stops, busy, 150.0)


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    n = max(len(a), len(b))
    return 1.0 if n == 0 else (n - row[-1]) / n


def test_resolve_names_equals_a_pass_over_all_places(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcde ", k=rng.randint(3, 24))) for _ in range(60)]
    places = [(i, n) for i, n in enumerate(base[:40])] + [(90, base[3]), (91, None)]
    wanted = {"", *base[30:]}
    for n in base:
        for _ in range(4):
            t = list(n)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(t))
                rng.choice([lambda: t.__setitem__(at, "z"), lambda: t.insert(at, "y"), lambda: t.pop(at) if len(t) > 1 else None])()
            wanted.add("".join(t))
    aliases = [("central", 5), ("central", 7), ("nowhere", 999)]
    wanted |= {"central", "nowhere"}
    names = {n: min(i for i, m in places if m == n) for _, n in places if n is not None}
    left, want = [], {}
    for w in sorted(wanted):
        best = max(((similarity(w, n), -i, n) for n, i in names.items()), default=None)
        if w in names:
            want[w] = (w, "exact")
        elif w == "central":
            want[w] = (base[5], "alias")
        elif best[0] >= 0.85:
            want[w] = (best[2], "fuzzy")
        else:
            left.append(w)
    made = []
    for w in left:
        near = [(-similarity(w, m), m) for m in made if similarity(w, m) >= 0.85]
        want[w] = (None, "created") if not near else (min(near)[1], "merged")
        if not near:
            made.append(w)
    got = resolve.resolve_names(spark.createDataFrame([(w,) for w in [*wanted, None, "central"]], "wanted string"), spark.createDataFrame(places, "id bigint, name string"), spark.createDataFrame(aliases, "alias string, place_id bigint"))
    assert {r["wanted"]: (r["place"], r["how"]) for r in got.collect()} == want and {"merged", "fuzzy", "created"} <= {h for _, h in want.values()}


def test_ride_round_equals_sequential_rule(spark):
    rng = random.Random(8)
    calls, labels = [], {s: rng.randint(0, 60) for s in rng.sample(range(40), 12)}
    for trip in range(30):
        for pos, stop in enumerate(rng.sample(range(40), rng.randint(2, 9)), 1):
            calls.append((trip, 0, pos, stop, None if pos == 1 else rng.randint(1, 20)))
    want: dict[int, int] = {}
    for trip in range(30):
        own = [c for c in calls if c[0] == trip]
        for i, c in enumerate(own):
            if c[3] in labels:
                t = labels[c[3]] + journey.BOARD_MIN
                for d in own[i + 1 :]:
                    t += d[4]
                    want[d[3]] = min(want.get(d[3], 10**9), t)
    ride = spark.createDataFrame(calls, "trip_id bigint, segment bigint, pos int, stop_id bigint, hop_min bigint")
    got = journey.ride_round(spark.createDataFrame(list(labels.items()), "stop_id bigint, minutes bigint"), ride)
    assert {r["stop_id"]: r["minutes"] for r in got.collect()} == want


def test_monotonic_keeps_what_a_pass_keeps(spark):
    rng = random.Random(2)
    data = [(t, s, s, 0, rng.randint(0, 50), None, "X") for t in range(60) for s in range(8)]
    kept = []
    for t in range(60):
        top = -1
        for row in data[t * 8 : t * 8 + 8]:
            if row[4] >= top:
                top = row[4]
                kept.append((t, row[1]))
    df = spark.createDataFrame(data, "trip_id bigint, stop_id bigint, seq bigint, platform bigint, minute bigint, departs string, time_source string")
    assert rows(timetable.monotonic(df).select("trip_id", "stop_id")) == sorted(kept)


def test_interpolation(spark):
    stops = spark.createDataFrame([(1, 22.0, 88.0), (2, 22.1, 88.0), (3, 22.4, 88.0), (4, None, None)], "id bigint, lat double, lng double")
    calls = [(1, 1, 1, 0, 23 * 60 + 50, "23:50", "A"), (1, 2, 2, 0, 0, None, "A"), (1, 3, 3, 0, 30, "00:30", "A"), (1, 2, 4, 0, 0, None, "A"), (2, 1, 1, 0, 60, "01:00", "A"), (2, 4, 2, 0, 0, None, "A"), (2, 3, 3, 0, 90, "01:30", "A")]
    df = spark.createDataFrame(calls, "trip_id bigint, stop_id bigint, seq bigint, platform bigint, minute bigint, departs string, time_source string")
    got = {(r["trip_id"], r["pos"]): (r["departs"], r["time_source"]) for r in timetable.interpolate(df, stops).collect()}
    assert got[(1, 2)] == ("00:00", "INTERPOLATED")  # a quarter of 40 minutes, past midnight
    assert got[(1, 4)] == (None, None) and got[(2, 2)] == (None, None)  # nothing after it; a hop that can't be measured


def test_cluster_greedy(spark):
    s = [(1, "Garia", "P", "WB", 22.5, 88.3), (2, "GARIA", "Q", "WB", 22.5005, 88.3), (3, "garia", "R", "OD", 22.5, 88.3), (4, "Garia", "P", "WB", 22.54, 88.3), (5, "Other", "P", "WB", 22.5, 88.3), (6, "Garia", "P", "WB", None, None), (7, "Chain", "P", "", 22.0, 88.0), (8, "Chain", "P", "", 22.0012, 88.0), (9, "Chain", "P", "", 22.0024, 88.0)]
    stops = spark.createDataFrame(s, "id bigint, name string, provider string, state string, lat double, lng double")
    busy = spark.createDataFrame([(2, 9), (8, 1)], "stop_id bigint, services bigint")
    got = {r["id"]: r["survivor"] for r in resolve.cluster_greedy(stops, busy).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 8, 8: 8, 9: 8}


def test_upsert_is_idempotent_and_keeps_unlisted(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, x string, y bigint")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", None)], "id bigint, x string, y bigint")
    once = relational.upsert(old, new, "id", ["x"])
    assert sorted(map(str, rows(once))) == sorted(map(str, [(1, "a", 1), (2, "B", 2), (3, "C", None)]))
    assert sorted(map(str, rows(relational.upsert(once, new, "id", ["x"])))) == sorted(map(str, rows(once)))


def test_content_hash_ignores_order_and_partitions(spark):
    df = spark.createDataFrame([(i % 2, i, None if i % 5 == 0 else f"n{i}") for i in range(50)], "g int, id bigint, name string")
    a, b = (rows(lifecycle.content_hash(d, ["id", "name"], ["g"])) for d in (df.repartition(3), df.orderBy(F.desc("id")).coalesce(1)))
    assert a == b and rows(lifecycle.content_hash(df.filter("id <> 7"), ["id", "name"], ["g"])) != a


def test_numbers_follow_the_order_over_all_ranges(spark):
    rng = random.Random(1)
    names = [f"n{rng.randrange(10**6):06d}" for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in {*names, None}], "name string").repartition(7)
    got = [r["name"] for r in relational.numbered(df, "name").orderBy("id").collect()]
    assert got == [None, *sorted(set(names))]
    assert relational.numbered(df.limit(0), "name").count() == 0


def test_first_come_keeps_what_a_pass_keeps(spark):
    rng = random.Random(3)
    links = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(260)} | {(i, i + 1) for i in range(300, 340)}
    nodes, kept = sorted({x for e in links for x in e} | {500}), []
    for n in nodes:
        if not any((k, n) in links for k in kept):
            kept.append(n)
    got = resolve.first_come(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(list(links), "early bigint, late bigint"))
    assert [r["node"] for r in got.orderBy("node").collect()] == kept
    assert resolve.first_come(spark.createDataFrame([], "node bigint"), spark.createDataFrame([], "early bigint, late bigint")).count() == 0


def test_content_hash_tells_fields_apart(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("n", "x"), ("1:a", ""), ("", "1:a"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "g int, a string, b string")
    assert len({r["content_hash"] for r in lifecycle.content_hash(df, ["a", "b"], ["g"]).collect()}) == len(pairs)


def test_a_change_back_to_an_earlier_content_lands(spark):
    known = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), ("q", "one", 1)], "k string, content_hash string, at int")
    landed = spark.createDataFrame([("p", "old"), ("p", "new"), ("q", "one"), ("r", "one")], "k string, content_hash string")
    assert rows(lifecycle.skip_unchanged(landed, known, ["k"], "at")) == [("p", "old"), ("r", "one")]


def test_experimental_routes_go_with_what_hangs_on_them(spark):
    routes = spark.createDataFrame([(1, "exp_a"), (2, "exp_b"), (3, "exp_keep"), (4, "real")], "id bigint, external_id string")
    trips = spark.createDataFrame([(10, 2)], "id bigint, route_id bigint")
    stops = spark.createDataFrame([(100, 1), (101, 2), (102, 3), (103, 4)], "id bigint, route_id bigint")
    marked = relational.experimental(routes, trips, F.col("external_id").startswith("exp_"), F.col("external_id").isin("exp_keep"))
    left = relational.prune(marked, F.col("doomed"), [(stops, "route_id")])
    assert [r["id"] for r in left[0].orderBy("id").collect()] == [2, 3, 4] and [r["id"] for r in left[1].orderBy("id").collect()] == [101, 102, 103]


def test_gates_of_empty_tables(spark):
    from tramline.operators import quality

    stops = spark.createDataFrame([], "id bigint, name string, provider string, lat double")
    routes, trips = spark.createDataFrame([], "id bigint, fare_inr bigint"), spark.createDataFrame([], "route_id bigint")
    calls = spark.createDataFrame([], "trip_id bigint, stop_id bigint, seq bigint, departs string")
    got = {r["rule"]: (r["actual"], r["passed"]) for r in quality.gates(stops, routes, trips, calls).collect()}
    assert got["COORDINATE_COVERAGE_MIN_90"] == (0, False) and all(v == (0, True) for k, v in got.items() if k != "COORDINATE_COVERAGE_MIN_90")


FILES = {
    "bus": ("<table class='table-striped'><tr><td>Bus Name</td><td>Sri &amp; Co<td>  </tr><tr><th>Depot</th><td>A<br>B</td></tr></table><div class='x row sud y'><div> 1 </div><div>06:10</div><div>Old  Stand</div><div>_ _ : _ _</div></div><div class='row sud'><div>2</div><div>bad</div><div>Town</div><div>18:05</div></div><div class='row'><div>no</div></div>", [("field", "Bus Name", "Sri & Co", "", None), ("field", "Depot", "AB", None, None), ("call", "1", "06:10", "Old Stand", "_ _ : _ _"), ("call", "2", "bad", "Town", "18:05")]),
    "cut": ("<table><tr><td>Bus Name</td><td>X</td></tr><div class='row sud'><div>1</div><div>06:10", [("field", "Bus Name", "X", None, None)]),
    "none": (None, []),
}


def test_bus_pages_as_landed(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(FILES.values())], "page_id bigint, html string")
    out = pages.bus_detail(df)
    for i, (_, want) in enumerate(FILES.values()):
        assert [tuple(r)[1:2] + tuple(r)[3:] for r in out.filter(F.col("page_id") == i).orderBy("n").collect()] == want
    calls = {(r["stop"], r["up"], r["down"]) for r in pages.bus_calls(out).collect()}
    assert calls == {("Old Stand", "06:10", None), ("Town", None, "18:05")}


def test_line_pages_as_landed(spark):
    html = "<section data-purple-line='Purple'><ul><li data-station-name='A &amp; B' data-sequence='1' data-interchange='true'>x<li data-station-name='C' data-sequence=' 2 '><li data-station-name='C2' data-sequence='2'></ul></section><li data-station-name='outside' data-sequence='9'><section data-green-line='Green'><li data-station-name='D' data-sequence='x' data-interchange='YES'>"
    out = pages.metro_lines(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string")).collect()
    assert [tuple(r)[1:] for r in out] == [("Purple", "A & B", 1, True), ("Purple", "C", 2, False), ("Purple", "C2", 2, False), ("Green", "D", None, True)]


def test_lines_and_harvests_as_landed(spark):
    lines = ['"a, b","say ""x"""', "plain,", ',"',  "", '" x ", y ,z']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    naive = [r["f"] for r in df.select(feeds.naive_fields(F.col("line")).alias("f")).collect()]
    assert naive == [["a", "b", "say \"\"x\"\""], ["plain", ""], ["", ""], [""], [" x ", "y", "z"]]
    strict = [tuple(r["f"]) if r["f"] else None for r in df.limit(2).select(feeds.csv_fields(F.col("line"), ["a", "b"]).alias("f")).collect()]
    assert strict == [("a, b", 'say "x"'), ("plain", None)]
    bodies = ['{"nodes":[{"externalId":"a"}],"routePatterns":[{}],"trips":[{"stopTimes":[{"departureTime":null,"arrivalTime":"06:00"}]},{"stopTimes":[]}]}', '{"nodes":[{"externalId":"a"}],"routePatterns":[{}],"trips":[{"stopTimes":[{"departureTime":null}]}]}', "{broken", None]
    got = feeds.harvests(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()
    assert [(r["nodes"], r["routes"], r["timed"], r["refused"]) for r in got] == [(1, 1, 1, None), (1, 1, 0, "NO_TIMED_TRIPS"), (0, 0, 0, "NO_NODES"), (0, 0, 0, "NO_NODES")]


def test_open_feeds_with_what_they_lack(spark):
    osm = spark.createDataFrame([(1, None, {"railway": "station", "highway": "bus_stop", "name": " Big ", "alt_name": "B"}, 1.0, 2.0), (2, "own", {"name": "", "name:en": ""}, None, None), (3, None, None, None, None)], "id bigint, name string, tags map<string,string>, lat double, lon double")
    got = [tuple(r) for r in mapping.osm_nodes(osm).orderBy("id").collect()]
    assert got == [(1, "OPENSTREETMAP", "BUS_STOP", " Big ", "big", ["B"], 1.0, 2.0, 0.95), (2, "OPENSTREETMAP", "BUS_STOP", "own", "own", [], 22.5726, 88.3639, 0.95), (3, "OPENSTREETMAP", "BUS_STOP", "OSM Stop 3", "osm stop 3", [], 22.5726, 88.3639, 0.95)]
    places = spark.createDataFrame([(1, "", "N", {"ISO3166-2-lvl4": "IN-OD", "town": "T", "county": "C"}, " 22.5x", "abc"), (2, None, None, None, None, None)], "id bigint, display_name string, name string, address map<string,string>, lat string, lon string")
    got = [(r["name"], r["aliases"], r["lat"], r["lng"], r["state"], r["district"], r["block"], r["city"]) for r in mapping.nominatim_nodes(places).orderBy("id").collect()]
    assert got == [("N", ["T"], 22.5, 0.0, "OD", "C", "C", "T"), ("Nominatim Place 2", [], 0.0, 0.0, "WB", None, None, None)]


def test_promotion_moves_the_pointer_only_when_rules_hold(spark, tmp_path):
    snap = lifecycle.Snapshots(spark, str(tmp_path))
    assert snap.active() is None
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    snap.promote(good, [("NO_NAME", F.col("name") == "")], "id")
    for bad in (good.union(good), good.withColumn("name", F.lit("")), good.limit(0)):
        with pytest.raises(ValueError):
            snap.promote(bad, [("NO_NAME", F.col("name") == "")], "id")
    assert rows(snap.active()) == rows(good)


def test_gtfs_and_csv(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("stops.txt", "﻿stop_id, stop_name\r\n1,\"A, \"\"B\"\"\"\r\n\r\n2,\r\n")
        z.writestr("note.pdf", "x")
    (tmp_path / "feed.zip").write_bytes(buffer.getvalue())
    got = feeds.gtfs_table(feeds.gtfs_rows(spark, str(tmp_path / "feed.zip"), batch=1), "stops.txt", ["stop_id", "stop_name", "stop_lat"])
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("1", 'A, "B"', ""), ("2", "", "")]
    (tmp_path / "t.csv").write_text('id,name\n1,"x\ny"\n2,\n')
    assert rows(feeds.csv_table(spark, str(tmp_path / "t.csv"))) == [("1", "x\ny"), ("2", "")]


def test_archives_by_members(spark, tmp_path):
    """Two members of one name, one that is broken, a page instead of an archive, an empty archive; then a missing path."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("stops.txt", "id,name\r\n1,\"A\r\nB\"\r\n,\r\n2\r\n")
        z.writestr("routes.txt", "id\n7\n")
        with pytest.warns(UserWarning, match="Duplicate name"):
            z.writestr("stops.txt", "id,name\n3,C,more\n")
    broken = (tmp_path / "a.zip").read_bytes().replace(b"id\n7\n", b"id\n8\n", 1)
    (tmp_path / "b.zip").write_bytes(broken)
    (tmp_path / "c.zip").write_bytes(b"<html>503</html>")
    zipfile.ZipFile(tmp_path / "d.zip", "w").close()
    (tmp_path / "note.txt").write_text("no archive")
    whole = [("stops.txt", 0, (("id", "1"), ("name", "A\r\nB"))), ("stops.txt", 2, (("id", "2"), ("name", ""))), ("stops.txt", 0, (("id", "3"), ("name", "C")))]
    got = [(r["feed"], r["file"], r["row"], tuple(sorted(r["fields"].items()))) for r in feeds.gtfs_rows(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([("a.zip", "routes.txt", 0, (("id", "7"),)), *[(z, *w) for z in ("a.zip", "b.zip") for w in whole]])
    assert sorted((r["feed"], r["file"] or "", r["error"].split(":")[0]) for r in feeds.gtfs_refused(spark, str(tmp_path)).collect()) == [("b.zip", "routes.txt", "BadZipFile"), ("c.zip", "", "BadZipFile")]
    assert feeds.gtfs_rows(spark, f"file:{tmp_path}/a.zip", member="routes.txt").count() == 1
    (tmp_path / "none").mkdir()
    assert feeds.gtfs_rows(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        feeds.gtfs_rows(spark, str(tmp_path / "missing")).count()


def test_archives_written_and_read(spark, tmp_path):
    """Lines of 3 feeds over several tasks come back in order; a large member is read without being held."""
    import tracemalloc

    lines = spark.range(60_000).selectExpr("concat('f', id % 3) AS feed", "if(id % 5 = 0, 'a.txt', 'b.txt') AS file", "concat(id, ',\"é\n', id, '\"') AS line", "id").repartition(7)
    head = spark.createDataFrame([(f"f{k}", n, "id,t", -1) for k in range(3) for n in ("a.txt", "b.txt")], lines.schema)
    written = archives.write_archives(lines.unionByName(head), str(tmp_path), ["id"])
    assert sorted(map(tuple, written.collect())) == [(f"f{k}", 20_002) for k in range(3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f0.zip", "f1.zip", "f2.zip"]
    got = feeds.gtfs_rows(spark, str(tmp_path))
    assert got.count() == 60_000 and got.filter("fields['t'] <> concat('é\n', fields['id'])").isEmpty()
    order = got.selectExpr("*", "lag(cast(fields['id'] AS bigint)) OVER (PARTITION BY feed, file ORDER BY row) AS before")
    assert order.filter("before >= cast(fields['id'] AS bigint)").isEmpty()
    assert archives.write_archives(lines.limit(0), str(tmp_path / "no"), ["id"]).count() == 0
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("stop_times.txt", "w") as member:
        member.write(b"trip,at\n")
        for k in range(100):
            member.write(b"".join(b"%d,06:%02d:00\n" % (k * 1000 + i, i % 60) for i in range(1000)))
    reader = archives.ArchiveReader(str(tmp_path / "big.zip"), None, 2000)
    tracemalloc.start()
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20  # a batch, not the member


def test_json_rows(spark):
    df = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"data":[{"a":3}]}',), ('{"elements":[4]}',), ('{"a":5}',), ("junk",)], "b string")
    assert [r[0] for r in df.select(feeds.json_rows(F.col("b"))).collect()] == [['{"a":1}', '{"a":2}'], ['{"a":3}'], ["4"], ['{"a":5}'], ['{"rawJsonString":"junk"}']]


def test_land_is_idempotent(spark, tmp_path):
    new = spark.createDataFrame([("p", "h1"), ("p", "h1"), ("p", "h2")], "provider string, content_hash string")
    for _ in range(2):
        landing.land(new, str(tmp_path / "raw"), ["provider", "content_hash"])
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_structured_pages(spark):
    from tramline.operators import mapping
    from tramline.sources import pages

    html = [
        (1, "<section data-metro-line='Purple'><ul><li data-station-name='A' data-sequence='1' data-interchange='true'>A</li><li data-station-name='B' data-sequence='x'>B</li></ul></section><li data-station-name='C' data-sequence='3'>"),
        (2, "<table class='table table-striped'><tr><td>Bus Name</td><td> X  Y </td></tr></table><div class='row sud'><div>1</div><div>06:10</div><div>P</div><div>_ _ : _ _</div></div><div class='row sud'><div>2</div><div>06:40</div><div>Q</div><div>18:05</div></div>"),
        (3, None),
    ]
    df = spark.createDataFrame(html, "page_id bigint, html string")
    assert sorted(tuple(r)[1:] for r in pages.metro_lines(df).collect()) == [("Purple", "A", 1, True), ("Purple", "B", None, False)]
    detail = pages.bus_detail(df)
    assert [tuple(r)[3:5] for r in detail.filter("kind = 'field'").collect()] == [("Bus Name", "X Y")]
    both = mapping.up_down(pages.bus_calls(detail)).orderBy("direction", "seq").collect()
    assert [(r["direction"], r["stop"], r["at"]) for r in both] == [("DOWN", "Q", "18:05"), ("DOWN", "P", None), ("UP", "P", "06:10"), ("UP", "Q", "06:40")]


def _dealt(df) -> int:
    """The most tasks over which rows are dealt by number somewhere in the plan of `df`."""
    import re

    return max((int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())), default=0)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """What makes pairs, hops or documents of calls is dealt over as many tasks as there are rows for, whatever their bytes."""
    from types import SimpleNamespace

    from tramline.operators import journey, relational
    from tramline.plans import versions

    monkeypatch.setattr(relational, "PART", 10)
    rows = [(t, (t * 7 + s * 3) % 50, 0, s, (t + s * 9) % 1440, None, "OFFICIAL") for t in range(30) for s in range(1, 5)]
    calls = spark.createDataFrame(rows, "trip_id bigint, stop_id bigint, platform bigint, seq int, minute bigint, departs string, time_source string")
    stops = spark.createDataFrame([(k, f"s{k}", "p", "t", 22 + k / 100, 88.0) for k in range(50)], "id bigint, name string, provider string, state string, lat double, lng double")
    origin, some = spark.createDataFrame([(1, 0)], "stop_id bigint, minutes bigint"), spark.createDataFrame([(0,), (20,)], "origin bigint")
    legs, both = journey.line_legs(calls), journey.two_legs(calls, some)
    ridden, trips = journey.ride_round(origin, journey.hops(calls, stops)), versions.trip_calls(SimpleNamespace(calls=calls, stops=stops))
    assert min(_dealt(df) for df in (legs, both, journey.hops(calls, stops), ridden, trips)) >= 13  # of 120 calls, ten a task
    pairs = {}
    for t, a, _, s, *_ in rows:
        for u, b, _, e, *_ in rows:
            if t == u and s != e:
                pairs.setdefault((a, b), []).append(max(6, 2 * abs(e - s) + 3))
    assert sorted(map(tuple, legs.collect())) == sorted((a, b, min(m), len(m)) for (a, b), m in pairs.items())


def test_regional_plan_tasks_grow_with_its_pairs(spark, monkeypatch):
    """Pairs of rides are dealt by their number, nothing is broadcast, and a call at an unknown stop counts."""
    import re
    from types import SimpleNamespace

    from tramline.operators import relational
    from tramline.plans import pipelines

    monkeypatch.setattr(relational, "PART", 10)
    rows = [(t, (t * 7 + s * 3) % 50, s) for t in range(30) for s in range(1, 5)] + [(30, 20, 1), (30, 20, 2), (30, None, 3), (None, 0, 1), (None, 1, 2)]
    calls = spark.createDataFrame(rows, "trip_id bigint, stop_id bigint, seq int")
    stops = spark.createDataFrame([(k,) for k in range(50) if k != 20], "id bigint")
    plan = pipelines.graph_regional_plan(SimpleNamespace(calls=calls, stops=stops))
    legs = {}
    for t, a, s in rows:
        for u, b, e in rows:
            if t is not None and t == u and s < e and a is not None and b is not None:
                legs[a, b] = min(legs.get((a, b), 99), max(8, 3 * (e - s)))
    want, pairs = {k: (m, "direct") for k, m in legs.items() if k[0] % 20 == 0 and k[0] != k[1]}, 0
    for (a, via), m in legs.items():
        for (b, c), n in legs.items():
            if a % 20 == 0 and b == via:
                pairs += 1
                if a != c and want.get((a, c), (0, "transfer"))[1] == "transfer":
                    want[a, c] = min(want.get((a, c), (999, "transfer")), (m + 4 + n, "transfer"))
    assert sorted(map(tuple, plan.collect())) == sorted((*k, *v) for k, v in want.items())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "ENSURE_REQUIREMENTS" not in text
    assert max(map(int, re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", text))) >= pairs // 20  # ten a task, reckoned from averages
