"""Crawls, runs of vehicles, bounded paths, staged versions and streams that go on, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import journey, lifecycle, mapping, staging
from tramline.sources import feeds
from tramline.streaming import landing


def plain_crawl(pages, seeds, most_pages, most_items):
    """All crawls take their next step at once, the smaller seed first."""
    visited, at, items, out, stopped = set(), dict(seeds), {s: [] for s in dict(seeds)}, [], {}
    ways = {s: 0 for s in at}
    for step in range(200):
        for seed in sorted(at):
            url = at[seed]
            if url is None or url not in pages or url in visited:
                at[seed] = None
                continue
            visited.add(url)
            if step < most_pages and len(items[seed]) < most_items:
                new = []
                for item in pages[url][0]:
                    if item not in items[seed] and len(items[seed]) < most_items:
                        items[seed].append(item)
                        new.append(item)
                out.append((seed, step, url, new))
            if step + 1 >= most_pages:
                at[seed] = None
            else:
                at[seed] = pages[url][1]
    return sorted(out)


def crawled(spark, pages, seeds, most_pages, most_items):
    html = lambda items, to: "".join(f'<a href="{i}">' for i in items) + (f'<a href="{to}">Next</a><a href="/list?page=999">Last</a>' if to else "")
    landed = spark.createDataFrame([(u, html(*x)) for u, x in pages.items()], "url string, html string")
    return sorted(tuple(r) for r in feeds.crawl(landed, spark.createDataFrame(seeds, "seed bigint, url string"), "/bus/", r"/list\?page=", most_pages, most_items).collect())


def test_crawls(spark):
    rng, url = random.Random(1), lambda k: f"https://h.example/list?page={k}"
    for most_pages, most_items in ((50, 10**6), (5, 10**6), (50, 7), (1, 2)):
        pages = {url(k): ([f"https://h.example/bus/{rng.randrange(30)}" for _ in range(rng.randrange(5))], None if k % 9 == 4 else url(rng.randrange(44))) for k in range(40)}
        pages[url(100)], pages[url(101)], pages[url(102)] = (["https://h.example/bus/x"] * 2, url(101)), ([], url(100)), ([], url(102))  # a cycle of two and one of one
        seeds = [(5, url(0)), (2, url(7)), (3, url(7)), (9, url(100)), (4, url(102)), (7, "https://h.example/none")]
        assert crawled(spark, pages, seeds, most_pages, most_items) == plain_crawl(pages, seeds, most_pages, most_items)
    assert crawled(spark, {url(0): ([], None)}, [], 5, 5) == []


def test_links_are_made_absolute(spark):
    landed = spark.createDataFrame([("https://h.example/list?page=1", '<a href="/bus/a"><a href="/list?page=2">Next</a>'), ("https://h.example/list?page=2", '<a href="/bus/a"><a href="https://o.example/bus/b">'), ("https://h.example/list?page=2", None)], "url string, html string")
    seeds = spark.createDataFrame([(1, "https://h.example/list?page=1")], "seed bigint, url string")
    got = [tuple(r) for r in feeds.crawl(landed, seeds, "/bus/", r"/list\?page=", 9, 9).orderBy("step").collect()]
    assert [(r[1], r[3]) for r in got] == [(0, ["https://h.example/bus/a"]), (1, ["https://o.example/bus/b"])]


def plain_run(calls):
    kept, last = [], None
    for place, stop, arrives, departs in sorted(calls):
        if arrives is None and departs is None:
            continue
        came, leaves = arrives or departs, departs or arrives
        if last is None or came >= last:
            kept.append((len(kept) + 1, stop, came, leaves))
            last = leaves
    return kept if len(kept) > 1 else []


def test_calls_that_go_back_are_dropped(spark):
    """The call at 06:05 after 06:09 goes, what follows is held against 06:09; a wait makes arrival and departure differ; night goes on past 24 hours."""
    rng, runs = random.Random(2), {
        ("v1", "06:00"): [(1, 10, "06:00", "06:00"), (2, 11, "06:09", None), (3, 12, "06:05", None), (4, 13, "06:20", "06:20")],
        ("v1", "07:00"): [(1, 10, "07:00", "07:30"), (2, 11, "07:20", "07:21"), (3, 12, "07:31", None)],
        ("v2", "23:00"): [(1, 10, None, "23:50"), (2, 11, "24:20", None)], ("v3", None): [(1, 10, "08:00", None)], ("v4", "09:00"): [(1, 10, None, None), (2, 11, "09:00", None), (3, 12, "08:00", None)],
    }
    clock = lambda: rng.choice([None, f"{rng.randrange(6, 9):02d}:{rng.randrange(60):02d}"])
    runs |= {(f"w{k}", "x"): [(n, rng.randrange(5), clock(), clock()) for n in range(rng.randrange(9))] for k in range(30)}
    rows = [(v, s, *c) for (v, s), calls in runs.items() for c in calls]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vehicle string, started string, place int, stop_id int, arrives string, departs string")
    got = {}
    for r in mapping.vehicle_runs(df).orderBy("vehicle", "started", "seq").collect():
        got.setdefault((r["vehicle"], r["started"]), []).append((r["seq"], r["stop_id"], r["arrives"], r["departs"]))
    assert got == {k: run for k, calls in runs.items() if (run := plain_run(calls))}
    assert [c[1] for c in got["v1", "06:00"]] == [10, 11, 13] and len(got["v2", "23:00"]) == 2


def plain_paths(edges, origin, target, most):
    out, todo = [], [([origin], 0)]
    while todo:
        path, weight = todo.pop()
        if path[-1] == target:
            out.append((weight, path))
            continue
        todo += [([*path, b], weight + w) for (a, b), w in edges.items() if a == path[-1] and b not in path and weight + w <= most]
    return [(path, weight, n + 1) for n, (weight, path) in enumerate(sorted(out))]


def test_paths_within_a_limit(spark):
    rng = random.Random(6)
    edges = {(a, b): rng.randrange(1, 9) for a in range(14) for b in range(14) if a != b and rng.random() < 0.22}
    pairs = [(q, rng.randrange(14), rng.randrange(14)) for q in range(8)] + [(8, 3, 3), (9, 0, 99)]
    df = spark.createDataFrame([(*e, w) for e, w in edges.items()], "a bigint, b bigint, weight bigint")
    asked = spark.createDataFrame(pairs, "query bigint, origin bigint, target bigint")
    got = {}
    for r in journey.paths_within(df, asked, 14).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["path"], r["weight"], r["rank"]))
    assert got == {q: found for q, a, b in pairs if (found := plain_paths(edges, a, b, 14))}
    assert journey.paths_within(df, asked.limit(0), 14).count() == 0


DATASET = """provider string, document string, observations array<struct<sourceRecordId:string,confidence:double>>, nodes array<struct<externalId:string,name:string,normalizedName:string,latitude:double,longitude:double>>,
routePatterns array<struct<externalId:string,shortName:string,longName:string,operationalStatus:string,stops:array<struct<nodeExternalId:string,name:string,sequence:int>>>>,
trips array<struct<externalId:string,serviceName:string,routeExternalId:string,operationalStatus:string,stopTimes:array<struct<stopExternalId:string,stopName:string,sequence:int,arrivalTime:string,departureTime:string,timeIsEstimated:boolean>>>>"""
NODES = [("A", "Alpha", "alpha", 1.0, 2.0), ("", "Beta", "beta", None, None), ("C", "Gamma", "gamma", None, None)]
STOPS = [("A", "Alpha", 1), (None, "Beta", 2), ("C", "Gamma", 3)]
TIMES = [("A", "Alpha", 1, None, "06:00", None), (None, "Beta", 2, "06:10", "06:10", True), ("C", "Gamma", 3, None, None, False)]


def dataset(spark, nodes=NODES, stops=STOPS, times=TIMES, seen=(("o1", 0.9),), trip_route="R", route="R"):
    row = ("p", "d1", list(seen), nodes, [(route, "r", "Route", None, stops)], [("T", "t", trip_route, None, times)])
    return spark.createDataFrame([row, ("p", "d2", None, None, None, None)], DATASET)


def test_versions_are_all_or_nothing(spark, tmp_path, monkeypatch):
    net = staging.Network(spark, str(tmp_path / "net"))
    staged = staging.stage(dataset(spark), "v1")
    assert {k: df.count() for k, df in staged.items()} == {"observations": 1, "stops": 3, "routes": 1, "route_stops": 3, "trips": 1, "stop_times": 3}
    assert sorted(r["external_id"] for r in staged["stops"].collect()) == ["A", "C", "node_Beta"]
    assert sorted(map(tuple, staged["stops"].collect())) == sorted(map(tuple, staging.stage(dataset(spark), "v1")["stops"].collect()))
    net.promote_all(staged, "v1")
    first = {k: sorted(map(str, df.collect())) for k, df in net.tables().items()}
    assert sorted((r["sequence"], r["time_source"]) for r in net.tables()["stop_times"].collect()) == [(1, "SCRAPED"), (2, "INTERPOLATED"), (3, None)]
    broken = {
        "TOO_FEW_STOPS": {"stops": STOPS[:1]}, "UNKNOWN_STOP": {"stops": [*STOPS, ("X", "X", 4)]}, "DUPLICATE_SEQUENCE": {"stops": [*STOPS, ("A", "Alpha", 3)]}, "NO_OBSERVATION": {"seen": ()},
        "ID_CONFLICT": {"nodes": [*NODES, ("A", "Other", "other", None, None)]}, "NO_EXTERNAL_ID": {"nodes": [*NODES, (None, None, None, None, None)]}, "UNKNOWN_ROUTE": {"trip_route": "Q"}, "UNMAPPED_TIME": {"times": [*TIMES, ("Y", "Y", 4, None, None, None)]},
    }
    for rule, change in broken.items():
        with pytest.raises(staging.Refused, match=rule) as refused:
            net.promote_all(staging.stage(dataset(spark, **change), rule), rule)
        assert {r["rule"] for r in refused.value.errors.collect()} == {rule}
    with pytest.raises(staging.Refused, match="EMPTY"):
        net.promote_all(staging.stage(dataset(spark).limit(0), "none"), "none")
    monkeypatch.setattr(net, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        net.promote_all(staging.stage(dataset(spark, stops=STOPS[:2]), "v2"), "v2")
    assert {k: sorted(map(str, df.collect())) for k, df in net.tables().items()} == first
    monkeypatch.undo()
    net.promote_all(staging.stage(dataset(spark, stops=STOPS[:2]), "v2"), "v2")
    assert net.tables()["route_stops"].count() == 2 and net.tables()["stop_times"].count() == 3


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Three runs over one folder: what lands again isn't staged again, nothing is lost, a third run without news adds nothing."""
    def land(name, rows):
        spark.createDataFrame(rows, "key string, at timestamp_ntz").select("key", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def staged():
        stream = spark.readStream.schema("key string, at timestamp").parquet(f"{tmp_path}/in/*")
        return sorted(r["key"] for r in landing.ingest(stream, ["key"], "at", "1 day", f"{tmp_path}/own").collect())

    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    land("a", [("k1", day(1)), ("k2", day(1, 1)), ("k1", day(1, 2))])
    assert staged() == ["k1", "k2"]
    land("b", [("k2", day(1, 3)), ("k3", day(1, 4))])
    assert staged() == ["k1", "k2", "k3"]
    assert staged() == ["k1", "k2", "k3"]
    land("c", [("k4", day(9)), ("k3", day(1, 5))])
    assert staged() == ["k1", "k2", "k3", "k4"]


def test_a_run_takes_up_after_its_last_checkpoint(spark):
    items = spark.createDataFrame([("p", k, k % 3) for k in range(60)] + [("q", 1, 1), (None, 5, 5)], "run string, at bigint, x bigint")
    saved = lifecycle.progress(items, "run", ["at", "x"])
    assert sorted((str(r["run"]), r["done"]) for r in saved.collect()) == [("None", 1), ("p", 25), ("p", 50), ("p", 60), ("q", 1)]
    left = lifecycle.rest(items, "run", ["at", "x"], saved.filter("run = 'p' and done < 60"))
    assert sorted((str(r["run"]), r["at"]) for r in left.collect()) == [("None", 5), *[("p", k) for k in range(50, 60)], ("q", 1)]


def test_promotion_leaves_no_staged_copy(spark, tmp_path):
    net = staging.Network(spark, str(tmp_path / "net"))
    net.promote_all(staging.stage(dataset(spark), "v1"), "v1")
    with pytest.raises(staging.Refused):
        net.promote_all(staging.stage(dataset(spark).limit(0), "none"), "none")
    assert not [p.name for p in (tmp_path / "net").iterdir() if p.name.startswith("staged-")]
    assert net.tables()["stops"].count() > 0


def test_gates_count_keys_before_rows_are_looked_up(spark, tmp_path, monkeypatch):
    """no table is written for the gates, each is read a fixed number of times, and null keys or providers define nothing."""
    net, seen, plain = staging.Network(spark, str(tmp_path / "net")), [], staging.gate_errors

    def watched(staged):
        seen.append((tmp_path / "net").exists())
        return plain(staged)

    monkeypatch.setattr(staging, "gate_errors", watched)
    net.promote_all(staging.stage(dataset(spark), "v1"), "v1")
    assert seen == [False] and net.tables()["stops"].count() > 0
    rows = lambda kind, *xs: spark.createDataFrame(list(xs), kind)
    staged = {
        "observations": rows("provider string", ("p",)), "stops": rows("id string, provider string, external_id string, normal_name string", ("1", "p", "A", "a"), ("2", "p", "A", None), ("3", "p", None, "x"), ("4", None, "B", "b"), ("5", "p", "C", "c"), ("6", "p", "C", "c")),
        "routes": rows("provider string, external_id string", ("p", "R"), ("p", None), (None, "Q"), ("q", "R")), "trips": rows("provider string, external_id string, route string", ("p", "T", "R"), ("p", None, None), ("p", "U", "none")),
        "route_stops": rows("provider string, route string, stop string, sequence int", ("p", "R", "A", 1), ("p", "R", "C", 1), ("p", "R", None, 2), (None, "Q", "B", 1), (None, "Q", "B", 2), ("p", None, "Z", 3), ("p", None, "Z", 4)),
        "stop_times": rows("provider string, trip string, stop string, sequence int", ("p", "T", "A", 1), ("p", "T", "Z", 2), ("p", "V", "A", 3), ("p", "V", "Z", 3), (None, "T", "B", 4), ("p", None, "A", None)),
    }
    assert sorted((r["rule"], r["subject"]) for r in plain(staged).collect()) == [
        ("DUPLICATE_SEQUENCE", "R > 1"), ("ID_CONFLICT", "A"), ("NO_EXTERNAL_ID", "3"), ("TOO_FEW_STOPS", "?"), ("TOO_FEW_STOPS", "Q"), ("TOO_FEW_STOPS", "R"), ("UNKNOWN_ROUTE", "? > ?"), ("UNKNOWN_ROUTE", "U > none"),
        ("UNKNOWN_STOP", "? > Z"), ("UNKNOWN_STOP", "Q > B"), ("UNKNOWN_STOP", "R > ?"), ("UNMAPPED_TIME", "? > ?"), ("UNMAPPED_TIME", "T > 2"), ("UNMAPPED_TIME", "T > 4"), ("UNMAPPED_TIME", "V > 3"),
    ]
