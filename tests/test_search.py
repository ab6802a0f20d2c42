"""Many searches at once against one plain search each."""

from __future__ import annotations

import math
import random

from tramline.operators import search

CALLS = "trip_id bigint, stop_id bigint, seq bigint, platform bigint, minute bigint, departs string, time_source string"


def metres(a, b):
    if None in (*a, *b):
        return None
    (y1, x1), (y2, x2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1, math.sqrt(h)))


def minutes(m, kmh):
    return max(1, math.floor(m / (kmh * 1000 / 60) + 0.5))


class World:
    """Stops in a small town, some of them without place, trips of several routes, times on some calls."""

    def __init__(self, seed):
        rng = random.Random(seed)
        self.stops = {i: (f"Stand {i}" if i % 9 else "Old Market", None if i % 11 == 10 else 22 + rng.randrange(60) / 1000, None if i % 11 == 10 else 88 + rng.randrange(60) / 1000) for i in range(60)}
        self.trips = {t: t % 14 for t in range(40)}
        self.calls = [(t, s, n, 0, at, f"{at // 60:02d}:{at % 60:02d}" if rng.random() < 0.7 else None) for t in self.trips for n, s in enumerate(rng.sample(range(60), rng.randrange(2, 7))) for at in [rng.randrange(300, 1200)]]
        self.fares = {r: rng.choice([None, 10, 37]) for r in range(14)}
        beside = lambda s, y, x: ((self.stops[s][1] or 22.03) + y, (self.stops[s][2] or 88.03) + x)
        pick = [rng.randrange(60) for _ in range(47)]
        self.asked = [(q, *(beside(s, 0.0007, -0.0003) if q % 4 else (None, None)), [self.stops[s][0]]) for q, s in enumerate(pick[:24])]
        self.ends = [(q, *beside(s, 0.001, 0.0), ["old mark", ""] if q % 5 == 0 else [None]) for q, s in enumerate(pick[24:])]

    def place(self, s):
        return self.stops[s][1:]

    def access(self, lat, lng, names):
        found = {s for s in self.stops if lat is not None and self.place(s)[0] is not None and metres((lat, lng), self.place(s)) <= 1500}
        for name in names:
            needle = (name or "").strip().lower()
            if needle:
                hit = [s for s in self.stops if needle in self.stops[s][0].lower()]
                found |= set(sorted(hit, key=lambda s: (self.stops[s][0].lower() != needle, s))[:12])
        far = sorted((metres((lat, lng), self.place(s)) or 0, s) for s in found)
        near = [x for x in far if x[0] <= 1500] or far[:1]
        return {s: minutes(m, 4.5) if m > 0 else 0 for m, s in near}

    def segments(self):
        out = []
        for t in self.trips:
            rows = sorted((c for c in self.calls if c[0] == t), key=lambda c: (c[2], c[1]))
            part, cum = [], 0
            for n, c in enumerate(rows):
                hop = 0
                if n:
                    b = rows[n - 1]
                    m = metres(self.place(b[1]), self.place(c[1]))
                    hop = c[4] - b[4] if c[5] and b[5] and c[4] > b[4] else minutes(m, 22) if m is not None and m <= 150_000 else None
                if hop is None:
                    out.append((t, part))
                    part, cum, hop = [], 0, 0
                cum += hop
                part.append((n + 1, c[1], cum, c[5]))
            out.append((t, part))
        return out

    def whole(self, t):
        rows = sorted((c for c in self.calls if c[0] == t), key=lambda c: (c[2], c[1]))
        return sum(metres(self.place(a[1]), self.place(b[1])) or 0 for a, b in zip(rows, rows[1:], strict=False))

    def plan(self, starts, ends, banned=()):
        """Labels hold the whole way as a list of hops; each round copies them."""
        labels = {s: (m, []) for s, m in starts.items()}
        for _ in range(3):
            rides = {}
            for t, part in self.segments():
                if self.trips[t] in banned:
                    continue
                best = None
                for pos, s, cum, at in part:
                    if best:
                        cand = (cum + 6 + best[0], best[2], t, best[1], pos, best[3], at)
                        if s not in rides or cand[:5] < rides[s][:5]:
                            rides[s] = cand
                    if s in labels:
                        mine = (labels[s][0] - cum, pos, s, at)
                        best = min(best, mine, key=lambda b: b[:3]) if best else mine
            low = {s: c for s, c in rides.items() if s not in labels or c[0] < labels[s][0]}
            ridden = {s: (c[0], [*labels[c[1]][1], (c[1], s, c[2], c[5], c[6])]) for s, c in low.items()}
            labels = labels | ridden
            walks = {}
            for f, (m, way) in ridden.items():
                for g in self.stops:
                    d = metres(self.place(f), self.place(g))
                    if g != f and d is not None and d <= 600:
                        cand = (m + minutes(math.floor(d + 0.5), 4.5), f)
                        walks[g] = min(walks.get(g, cand), cand)
            labels = labels | {g: (m, [*ridden[f][1], (f, g, None, None, None)]) for g, (m, f) in walks.items() if g not in labels or m < labels[g][0]}
        reached = [(labels[s][0], s) for s in ends if s in labels]
        return (min(reached)[1], labels[min(reached)[1]][1]) if reached else None

    def legs(self, last, way, origin, target):
        out = []
        for f, g, t, departs, arrives in way:
            m = metres(self.place(f), self.place(g)) or 0
            route = None if t is None else self.trips[t]
            if out and route is not None and out[-1][3] == route:
                old = out[-1]
                out[-1] = (*old[:2], g, route, old[4] + m, old[5] + minutes(m, 22), old[6], arrives or old[7], old[8])
                continue
            fare = None if t is None else self.fares[route]
            if fare is not None and self.whole(t) and m < self.whole(t):
                fare = max(1, math.ceil(fare * (m / self.whole(t))))
            out.append(("WALK" if t is None else "RIDE", f, g, route, m, minutes(m, 4.5) if t is None else minutes(m, 22) + 6, departs, arrives, fare))
        first = way[0][0] if way else last
        for point, stop, at in ((origin, first, 0), (target, last, len(out) + 1)):
            m = metres(point, self.place(stop))
            if m is not None and m > 50:
                out.insert(at, ("WALK", None if at == 0 else stop, stop, None, m, minutes(m, 4.5), None, None, None))
        return [(n + 1, *leg[:4], math.floor(leg[4] + 0.5), *leg[5:]) for n, leg in enumerate(out)]

    def answers(self, passes):
        out = []
        ends = {e[0]: e for e in self.ends}
        for q, lat, lng, names in self.asked:
            if q not in ends:
                continue
            starts, targets = self.access(lat, lng, names), self.access(*ends[q][1:])
            banned, seen = set(), set()
            for option in range(1, passes + 1):
                found = self.plan(starts, targets, banned)
                legs = self.legs(*found, (lat, lng), ends[q][1:3]) if found else []
                sign = tuple("walk" if leg[4] is None else leg[4] for leg in legs)
                if not legs or sign in seen:
                    break
                seen.add(sign)
                out += [(q, option, *leg) for leg in legs]
                rides = [leg[4] for leg in legs if leg[4] is not None]
                if not rides:
                    break
                banned.add(rides[0])
        return sorted(out, key=repr)


def tables(spark, w):
    stops = spark.createDataFrame([(i, *s) for i, s in w.stops.items()], "id bigint, name string, lat double, lng double")
    trips = spark.createDataFrame(list(w.trips.items()), "id bigint, route_id bigint")
    calls = spark.createDataFrame([(*c, "A") for c in w.calls], CALLS)
    routes = spark.createDataFrame(list(w.fares.items()), "id bigint, fare bigint")
    point = "query bigint, lat double, lng double, place_id bigint, names array<string>"
    asked, ends = (spark.createDataFrame([(q, lat, lng, None, names) for q, lat, lng, names in rows], point) for rows in (w.asked, w.ends))
    return asked, ends, search.Network(calls, trips, stops), routes


LEG = ("query", "option", "leg", "mode", "from_stop", "to_stop", "route_id", "metres", "minutes", "departs", "arrives", "fare")


def test_ways_and_alternatives(spark):
    w = World(2)
    legs = search.alternatives(*tables(spark, w), most=4)
    want = w.answers(4)
    assert sorted((tuple(r) for r in legs.select(*LEG).collect()), key=repr) == want
    assert len({x[1] for x in want}) > 2 and any(x[3] == "WALK" for x in want)
    ways = search.ranked(search.totals(legs, ["query", "option"])).collect()
    for q in {x[0] for x in want}:
        mine = sorted((r for r in ways if r["query"] == q), key=lambda r: r["rank"])
        keys = [(r["minutes"], r["departs"] or "~", r["option"]) for r in mine]
        assert keys == sorted(keys) and [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        for r in mine:
            own = [x for x in want if x[:2] == (q, r["option"])]
            fares = [x[-1] for x in own if x[6] is not None]
            assert (r["legs"], r["minutes"], r["metres"], r["transfers"]) == (len(own), sum(x[8] for x in own), sum(x[7] for x in own), max(0, len(fares) - 1))
            priced = [f for f in fares if f is not None]
            assert (r["fare"], r["fare_incomplete"]) == (sum(priced) if priced else None, 0 < len(priced) < len(fares))


def test_linked_places_and_far_stops(spark):
    """A linked stop counts wherever it is, if nothing nearer does; one without place counts as no walk."""
    stops = spark.createDataFrame([(1, "A", 22.0, 88.0), (2, "B", 22.1, 88.0), (3, "C", None, None), (4, "D", 22.2, 88.0)], "id bigint, name string, lat double, lng double")
    links = spark.createDataFrame([(7, 2), (7, 4), (8, 3), (9, 4), (9, 1)], "place_id bigint, stop_id bigint")
    points = spark.createDataFrame([(1, 22.001, 88.0, 7, None), (2, 23.0, 88.0, 7, ["b"]), (3, 22.0, 88.0, 8, []), (4, 22.0, 88.0, 9, ["  "]), (5, 30.0, 88.0, None, ["none"])], "query bigint, lat double, lng double, place_id bigint, names array<string>")
    got = sorted(map(tuple, search.access_stops(points, stops, links=links).collect()))
    assert got == [(1, 1, 1), (2, 4, 1186), (3, 1, 0), (3, 3, 0), (4, 1, 0)]


def test_no_queries(spark):
    asked, ends, net, routes = tables(spark, World(1))
    assert search.plan(asked.limit(0), ends, net, routes).count() == 0
    assert search.alternatives(asked, ends.limit(0), net, routes).count() == 0


def test_only_what_leads_to_an_end_is_kept(spark, monkeypatch):
    """ways to the ends are those of a search without ends, with fewer rows written, also where no key is broadcast; rides are packed and go with the network."""
    import gc
    from pathlib import Path

    asked, ends, net, _ = tables(spark, World(3))
    starts, targets = (search.access_stops(p, net.stops) for p in (asked, ends))
    targets = targets.select("query", "stop_id").limit(6).localCheckpoint()
    told = lambda r: [sorted(map(tuple, df.collect()), key=repr) for df in search.walk_back(*r, targets)]
    every = search.search(starts, net)
    want, some = told(every), search.search(starts, net, ends=targets)
    assert told(some) == want and want[1]
    assert some[1].count() < every[1].count() and some[0].count() < every[0].count()
    monkeypatch.setattr(search, "HELD", 0)
    assert told(search.search(starts, net, ends=targets)) == want
    folder = Path(net.ride.inputFiles()[0].removeprefix("file:")).parent
    assert folder.exists()
    del net
    gc.collect()
    assert not folder.exists()
