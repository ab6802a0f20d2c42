"""Scalar functions: names, times, distances, classes, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import geo, text, timeofday
from tramline.operators import resolve, timetable
from tramline.plans.registry import query

LABEL = "(name || ' (Gate) Bus Stop & ' || provider || '  Metro Station')"


def _label():
    return F.concat("name", F.lit(" (Gate) Bus Stop & "), "provider", F.lit("  Metro Station"))


def _names(sql: str, f, name: str):
    query(f"SELECT id, {sql} AS out FROM (SELECT id, {LABEL} AS s FROM stops)", name=name)(lambda v: v.stops.select("id", f(_label()).alias("out")))


COLLAPSE = "trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g'))"
_names("regexp_replace(lower(s), '[^a-z0-9]', '', 'g')", text.name_key, "norm_name_key")
_names(COLLAPSE.format("lower(s)"), text.spaces, "norm_spaces")
_names(COLLAPSE.format("regexp_replace(" + COLLAPSE.format("lower(s)") + ", '[^a-z0-9 \\-./,()]', '', 'g')"), text.stop_strict, "norm_stop_strict")
_names("trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))", text.alnum_space, "norm_alnum_space")
_names(COLLAPSE.format(f"regexp_replace(regexp_replace(trim(lower(s)), '\\b({text.ALIAS_WORDS})\\b', '', 'g'), '\\(.*?\\)', '', 'g')"), text.alias, "norm_alias")
_names(f"trim(regexp_replace(lower(s), '( +({text.SUFFIXES}))+ *$', '', 'g'))", text.suffix_strip, "norm_suffix_strip")
_names(f"trim(regexp_replace(regexp_replace({COLLAPSE.format('lower(s)')}, '\\b({text.GOV_WORDS})\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))", text.gov_stop, "norm_gov_stop")
_names("regexp_replace(regexp_replace(replace(lower(trim(s)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')", text.slug, "slugify")
_names("regexp_replace(upper(s), ' +', '', 'g')", text.registration, "norm_registration")
_names("CASE WHEN regexp_matches(lower(s), '\\b(ac|a/c|volvo|premium)\\b') THEN 'PREMIUM' WHEN regexp_matches(lower(s), '\\bexpress\\b') THEN 'EXPRESS' WHEN regexp_matches(lower(s), '\\bnight\\b') THEN 'NIGHT' ELSE 'REGULAR' END", text.service_class, "class_service")

DISTINCT_WORDS = "list_filter(list_transform(string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN w IN ('metro', 'station', 'bus', 'stand', 'platform') THEN '' WHEN w IN ('kbs', 'kempegowda') THEN 'majestic' ELSE w END), lambda w: w <> '')"
_names(f"array_to_string(list_filter({DISTINCT_WORDS}, lambda w, i: list_position({DISTINCT_WORDS}, w) = i), ' ')", text.transfer_key, "norm_transfer_key")


@query("SELECT a.c_custkey AS id, lower(trim(n_name)) || '->' || lower(trim(c_mktsegment)) AS route_key, upper('TX_ROUTE_' || regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9 ]', '', 'g'), ' +', '_', 'g') || '->' || lower(c_mktsegment)) AS external_id FROM customer a JOIN nation ON c_nationkey = n_nationkey")
def route_key(v):
    r = v.routes
    return r.select("id", text.route_key(F.col("agency"), F.col("provider")).alias("route_key"), text.external_id("TX", F.col("agency"), F.col("provider")).alias("external_id"))


@query("SELECT id, regexp_replace(d, '^91([0-9]{10})$', '\\1') AS phone FROM (SELECT id, '91' || lpad(CAST(id * 7919 % 10000000000 AS VARCHAR), 10 - CAST(id % 2 AS INTEGER), '0') AS d FROM routes)")
def norm_phone(v):
    digits = F.lpad((F.col("id") * 7919 % 10000000000).cast("string"), (10 - F.col("id") % 2).cast("int"), F.lit("0"))
    return v.routes.select("id", text.phone(F.concat(F.lit("+91-"), digits)).alias("phone"))


@query("SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(provider || ', ' || name || ' - ' || state, 'via ', ''), ' *[,-] *'), lambda p: trim(p)), lambda p: p <> ''), '|') AS parts FROM stops")
def split_via(v):
    whole = F.concat(F.lit("via "), "provider", F.lit(", "), "name", F.lit(" - "), "state")
    return v.stops.select("id", F.array_join(text.split_via(whole), "|").alias("parts"))


@query("SELECT id, provider AS origin, name AS destination FROM stops")
def parse_route_text(v):
    origin, destination = text.route_ends(F.concat("provider", F.lit("  TO "), "name"))
    return v.stops.select("id", origin.alias("origin"), destination.alias("destination"))


@query("SELECT id, provider AS operator, state AS origin, name AS destination FROM stops")
def recover_endpoints(v):
    block = F.concat("provider", F.lit(" \n Reg No : X1 \n "), "state", F.lit(" ( "), "name", F.lit(" \n 12 stops )"))
    o, a, b = text.recover_ends(block)
    return v.stops.select("id", o.alias("operator"), a.alias("origin"), b.alias("destination"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN provider || '>' || name || '>' || state ELSE provider || '>' || name END AS stops FROM stops")
def route_stops_list(v):
    last = F.when(F.col("id") % 2 == 0, F.col("state")).otherwise(F.concat("name", F.lit(" Bus Stand")))
    via = F.array(F.lit("via"), F.col("name"), F.concat("name", F.lit("  terminus")), F.lit("N/A"))
    return v.stops.select("id", F.array_join(text.stop_list(F.col("provider"), via, last), ">").alias("stops"))


@query("SELECT a.id, b.id AS other, round((greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM places a JOIN places b ON a.id < b.id AND left(a.name, 1) = left(b.name, 1)")
def similarity(v):
    key = F.substring("name", 1, 1).alias("k")
    a, b = v.places.select("id", "name", key), v.places.select(F.col("id").alias("other"), F.col("name").alias("name_2"), key)
    return a.join(b, "k").filter("id < other").select("id", "other", F.round(text.similarity(F.col("name"), F.col("name_2")), 6).alias("similarity"))


RAW_TIME = "CASE id % 6 WHEN 0 THEN (id % 12 + 1) || ':05 PM' WHEN 1 THEN (id % 30) || ':' || lpad(CAST(id % 70 AS VARCHAR), 2, '0') || ':30' WHEN 2 THEN '0' || (id % 9) || ':15' WHEN 3 THEN '_ _ : _ _' WHEN 4 THEN '12:30 am' ELSE lpad(CAST(id % 30 AS VARCHAR), 2, '0') || '45' END"


def _raw_time():
    i = F.col("id")
    s = lambda c: c.cast("string")
    return F.when(i % 6 == 0, F.concat(s(i % 12 + 1), F.lit(":05 PM"))).when(i % 6 == 1, F.concat(s(i % 30), F.lit(":"), F.lpad(s(i % 70), 2, "0"), F.lit(":30"))).when(i % 6 == 2, F.concat(F.lit("0"), s(i % 9), F.lit(":15"))).when(i % 6 == 3, "_ _ : _ _").when(i % 6 == 4, "12:30 am").otherwise(F.concat(F.lpad(s(i % 30), 2, "0"), F.lit("45")))


H, M = "CAST(nullif(regexp_extract(s, '{0}', 1), '') AS INTEGER)", "CAST(nullif(regexp_extract(s, '{0}', 2), '') AS INTEGER)"
HALF, PLAIN, BARE = "(?i)^(\\d{1,2}):(\\d{2}) *([AP])M$", "^(\\d{1,2}):(\\d{2})(?::\\d{2})?$", "^(\\d{2})(\\d{2})$"


def _h(p):
    return f"CAST(nullif(regexp_extract(s, '{p}', 1), '') AS INTEGER)"


def _m(p):
    return f"CAST(nullif(regexp_extract(s, '{p}', 2), '') AS INTEGER)"


def _clock(h, m):
    return f"(lpad(CAST({h} AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} AS VARCHAR), 2, '0'))"


TWELVE = f"({_h(HALF)} % 12 + CASE WHEN upper(regexp_extract(s, '{HALF}', 3)) = 'P' THEN 12 ELSE 0 END)"


def _times(sql, f, name):
    query(f"SELECT id, {sql} AS out FROM (SELECT id, {RAW_TIME} AS s FROM routes)", name=name)(lambda v: v.routes.select("id", _raw_time().alias("s")).select("id", f(F.col("s")).alias("out")))


_times(f"CASE WHEN regexp_matches(s, '{HALF}') AND {_m(HALF)} < 60 THEN {_clock(TWELVE, _m(HALF))} WHEN regexp_matches(s, '{PLAIN}') AND {_h(PLAIN)} < 24 AND {_m(PLAIN)} < 60 THEN {_clock(_h(PLAIN), _m(PLAIN))} END", timeofday.normalise, "time_normalise")
_times(f"CASE WHEN regexp_matches(s, '{HALF}') AND {_m(HALF)} < 60 THEN {_clock(TWELVE, _m(HALF))} END", timeofday.twelve_hour, "time_12h_only")
_times(f"CASE WHEN regexp_matches(s, '{PLAIN}') AND {_h(PLAIN)} <= 27 AND {_m(PLAIN)} < 60 THEN {_clock(_h(PLAIN), _m(PLAIN))} WHEN regexp_matches(s, '{BARE}') AND {_h(BARE)} <= 27 AND {_m(BARE)} < 60 THEN {_clock(_h(BARE), _m(BARE))} END", timeofday.service_day, "time_bmtc")
_times("CASE WHEN regexp_full_match(s, '([01]?[0-9]|2[0-3]):[0-5][0-9]') THEN s END", timeofday.usable, "time_usable")
GOV = "(?i)^(\\d{1,2})(?::(\\d{2}))? *(AM|PM)?$"
LEN = "(?i)(\\d{1,2}):(\\d{2}) *(AM|PM)?"


def _hour(p):
    half = f"upper(regexp_extract(s, '{p}', 3))"
    return f"CASE WHEN {half} = 'PM' AND {_h(p)} < 12 THEN {_h(p)} + 12 WHEN {half} = 'AM' AND {_h(p)} = 12 THEN 0 ELSE {_h(p)} END"


_times(f"CASE WHEN regexp_matches(s, '{GOV}') THEN {_clock(_hour(GOV), 'coalesce(' + _m(GOV) + ', 0)')} ELSE nullif(s, '') END", timeofday.notice_board, "time_gov")
_times(f"CASE WHEN regexp_matches(s, '{LEN}') THEN {_clock(_hour(LEN), _m(LEN))} END", timeofday.lenient, "time_lenient")


@query("SELECT trip_id, seq, stop_id, CAST(left(departs, 2) AS INTEGER) * 60 + CAST(right(departs, 2) AS INTEGER) AS m FROM calls")
def time_minutes_of_day(v):
    return v.calls.select("trip_id", "seq", "stop_id", timeofday.minutes(F.col("departs")).alias("m"))


@query("SELECT trip_id, seq, stop_id, platform, lpad(CAST(((minute * 3 - 1440) % 1440 + 1440) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((minute * 3 - 1440) % 1440 + 1440) % 1440 % 60 AS VARCHAR), 2, '0') AS at FROM calls")
def time_clock(v):
    """Minutes before and beyond the day wrap at midnight."""
    return v.calls.select("trip_id", "seq", "stop_id", "platform", timeofday.from_minutes(F.col("minute") * 3 - 1440).alias("at"))


@query("SELECT id, upper('gov_ROUTE_' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', '_', 'g') || '->' || regexp_replace(regexp_replace(lower(trim(' ' || provider || ' / ' || state || ' ')), '[^a-z0-9 ]', '', 'g'), ' +', '_', 'g')) AS external_id FROM stops")
def external_id(v):
    return v.stops.select("id", text.external_id("gov", F.col("name"), F.concat(F.lit(" "), "provider", F.lit(" / "), "state", F.lit(" "))).alias("external_id"))


@query("SELECT id, lpad(CAST((CAST(floor(fare_inr * 10.25e0 + 0.5) AS BIGINT) % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((CAST(floor(fare_inr * 10.25e0 + 0.5) AS BIGINT) % 1440) % 60 AS VARCHAR), 2, '0') AS at FROM routes")
def time_hhmm_round(v):
    return v.routes.select("id", timeofday.from_minutes(F.col("fare_inr") * 10.25).alias("at"))


@query("SELECT id, unnest(range(300 + id % 60, 420, 15 + id % 20)) AS departs FROM routes")
def time_headway_expand(v):
    every = timeofday.headway(300 + F.col("id") % 60, F.lit(419).cast("bigint"), 15 + F.col("id") % 20)
    return v.routes.select("id", F.explode(every).alias("departs"))


@query("SELECT id, date_diff('day', CAST(created_at AS DATE), DATE '1998-12-31') AS age_days, date_diff('day', CAST(created_at AS DATE), DATE '1998-12-31') > 180 AS stale FROM trips")
def time_age_days(v):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("created_at").cast("date")).cast("bigint")
    return v.trips.select("id", age.alias("age_days"), (age > 180).alias("stale"))


D = geo.distance_sql("22.57", "88.36", "lat", "lng")


@query(f"SELECT id, CAST(floor({D} + 0.5) AS BIGINT) AS metres, CAST(greatest(1, floor({D} / 75 + 0.5)) AS INTEGER) AS walk, CAST(greatest(1, floor({D} / (22e0 * 1000 / 60) + 0.5)) AS INTEGER) AS bus FROM stops WHERE lat IS NOT NULL")
def geo_distance(v):
    d = geo.distance_m(F.lit(22.57), F.lit(88.36), F.col("lat"), F.col("lng"))
    return v.stops.filter("lat is not null").withColumn("d", d).select("id", F.floor(F.col("d") + 0.5).cast("bigint").alias("metres"), geo.minutes_for(F.col("d"), 4.5).alias("walk"), geo.minutes_for(F.col("d"), 22.0).alias("bus"))


@query("SELECT id, CAST(floor(lat / 0.01e0) AS BIGINT) AS cell_y, CAST(floor(lng / 0.01e0) AS BIGINT) AS cell_x FROM stops")
def geo_cell(v):
    return v.stops.withColumn("c", geo.cell(F.col("lat"), F.col("lng"))).select("id", F.col("c.y").cast("bigint").alias("cell_y"), F.col("c.x").cast("bigint").alias("cell_x"))




@query("""WITH s AS (SELECT name AS place, CASE id % 4 WHEN 0 THEN 'GOVERNMENT' WHEN 1 THEN 'OPERATOR' WHEN 2 THEN 'COMMUNITY' ELSE 'OTHER' END AS kind, id % 7 = 0 AS verified FROM stops),
k AS (SELECT place, kind, count(*) AS n, sum(verified::INT) AS ok FROM s GROUP BY ALL)
SELECT place, CAST(least(99, 40 + sum(CASE kind WHEN 'GOVERNMENT' THEN 40 WHEN 'OPERATOR' THEN 30 WHEN 'COMMUNITY' THEN 20 ELSE 15 END + 5 * (n - 1)) + 8 * sum(ok)) AS BIGINT) AS percent, least(99, 40 + sum(CASE kind WHEN 'GOVERNMENT' THEN 40 WHEN 'OPERATOR' THEN 30 WHEN 'COMMUNITY' THEN 20 ELSE 15 END + 5 * (n - 1)) + 8 * sum(ok)) >= 85 AS high FROM k GROUP BY place""")
def score_confidence(v):
    i = F.col("id")
    kind = F.when(i % 4 == 0, "GOVERNMENT").when(i % 4 == 1, "OPERATOR").when(i % 4 == 2, "COMMUNITY").otherwise("OTHER")
    return resolve.source_confidence(v.stops.select(F.col("name").alias("place"), kind.alias("kind"), (i % 7 == 0).alias("verified")), "place")


@query("SELECT id, CAST(greatest(10, floor(fare_inr * 0.7e0 * 1.5 + 0.5)) AS BIGINT) AS by_km, CAST(greatest(1, ceil(fare_inr * 3 / 7)) AS BIGINT) AS prorated FROM routes")
def score_fares(v):
    return v.routes.select("id", timetable.distance_fare(F.col("fare_inr") * 0.7).alias("by_km"), timetable.prorated_fare(F.col("fare_inr"), F.lit(3), F.lit(7)).alias("prorated"))


@query("SELECT event_id, 'kind' AS k, len(json_keys(props)) AS keys FROM events")
def json_key_count(v):
    return v.table("events").select("event_id", F.lit("kind").alias("k"), F.size(F.json_object_keys("props")).cast("bigint").alias("keys"))


@query("SELECT DISTINCT ON (event_id) event_id, json_extract_string(json_merge_patch(props, '{\"seen\":1}'), '$.seen') AS seen FROM events")
def json_merge(v):
    both = F.map_concat(F.map_filter(F.from_json("props", "map<string,string>"), lambda k, x: k != "seen"), F.create_map(F.lit("seen"), F.lit("1")))
    return v.table("events").select("event_id", both["seen"].alias("seen"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hash_sha256(v):
    return v.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
