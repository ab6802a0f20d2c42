"""Queries over landed feeds, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import text, timeofday
from tramline.plans.registry import query
from tramline.sources import feeds
from tramline.streaming import landing


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS size, sha256(html) AS content_hash, CASE WHEN regexp_matches(html, '(?i)<html') THEN 'text/html' ELSE 'text/plain' END AS content_type FROM pages")
def src_html_fetch(v):
    """Landed pages as raw records: where from, how large, of what kind, and the hash that tells changes."""
    return feeds.raw_pages(v.table("pages"))


@query("SELECT DISTINCT CASE WHEN regexp_matches(h, '^https?://') THEN h ELSE host || h END AS url FROM (SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) WHERE contains(h, '/th')")
def src_link_discovery(v):
    return feeds.links(v.table("pages"), "/th")


DIRECTORY = """d AS (SELECT page_id, 'https://d.example/p/' || page_id AS url, CASE WHEN page_id % 13 <> 5 THEN 'https://d.example/p/' || (page_id * 5 + 3) % 97 END AS nxt, html FROM pages),
way AS (SELECT page_id AS seed, 0 AS step, url, nxt FROM d WHERE page_id % 20 = 0 UNION ALL SELECT way.seed, way.step + 1, d.url, d.nxt FROM way JOIN d ON d.url = way.nxt WHERE way.step < 11)"""


@query(f"""WITH RECURSIVE {DIRECTORY},
own AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY step, seed) AS n FROM way),
seen AS (SELECT seed, step, url FROM own o WHERE NOT EXISTS (FROM own x WHERE x.seed = o.seed AND x.step <= o.step AND x.n > 1)),
href AS (SELECT seed, step, generate_subscripts(h, 1) AS place, unnest(h) AS item FROM (SELECT seed, step, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: regexp_matches(x, '^/an')) AS h FROM seen JOIN d ON d.url = seen.url)),
new AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY step, place) AS n FROM (SELECT seed, item, min({{'s': step, 'p': place}}).s AS step, min({{'s': step, 'p': place}}).p AS place FROM href GROUP BY ALL)),
kept AS (SELECT seed, step, string_agg('https://d.example' || item, ' ' ORDER BY n) AS items FROM new WHERE n <= 15 GROUP BY ALL)
SELECT s.seed, s.step, s.url, coalesce(k.items, '') AS items FROM seen s LEFT JOIN kept k ON k.seed = s.seed AND k.step = s.step WHERE NOT EXISTS (FROM new x WHERE x.seed = s.seed AND x.n = 15 AND x.step < s.step)""")
def src_paged_crawl(v):
    """Crawls of a directory whose pages name their next one, with dead ends, cycles and crawls that meet."""
    i, page = F.col("page_id"), lambda c: F.concat(F.lit("https://d.example/p/"), c.cast("string"))
    following = F.when(i % 13 != 5, F.concat(F.lit('<a href="/p/'), ((i * 5 + 3) % 97).cast("string"), F.lit('">Next</a>'))).otherwise("")
    landed = v.table("pages").select(page(i).alias("url"), F.concat("html", following).alias("html"))
    seeds = v.table("pages").filter("page_id % 20 = 0").select(i.alias("seed"), page(i).alias("url"))
    return feeds.crawl(landed, seeds, "^/an", "^/p/", 12, 15).withColumn("items", F.array_join("items", " "))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"/[a-z]+\"'), ' | ') AS found, len(regexp_extract_all(html, 'href=\"/[a-z]+\"')) AS n FROM pages")
def src_dom_page(v):
    return feeds.matches(v.table("pages"), 'href="/[a-z]+"')


LI = "regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)"


@query(f"SELECT page_id, CAST(generate_subscripts({LI}, 1) - 1 AS INTEGER) AS row, trim(regexp_replace(unnest({LI}), '<[^>]*>', '', 'g')) AS cell FROM pages")
def src_html_table(v):
    rows = F.posexplode(feeds.cells(F.col("html"), "li")).alias("row", "cells")
    return v.table("pages").select("page_id", rows).select("page_id", "row", F.col("cells")[0].alias("cell"))


@query("SELECT event_id, unnest(regexp_extract_all(props, '\"([a-z]+)\": *([0-9]+)', 1)) AS k, unnest(regexp_extract_all(props, '\"([a-z]+)\": *([0-9]+)', 2)) AS x FROM events")
def src_regex_pairs(v):
    return v.table("events").select("event_id", F.explode(feeds.pairs(F.col("props"), '"([a-z]+)": *([0-9]+)')).alias("p")).select("event_id", "p.k", "p.x")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events UNION ALL SELECT event_id, json_extract_string(props, '$.k') FROM events WHERE event_id % 2 = 0")
def src_json_unwrap(v):
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data": ['), "props", F.lit(","), "props", F.lit("]}"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return v.table("events").select("event_id", F.explode(feeds.json_rows(body)).alias("r")).select("event_id", F.get_json_object("r", "$.k").alias("k"))


@query("SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE name END AS stop_name, CASE id % 4 WHEN 0 THEN provider || ', \"x\"' WHEN 1 THEN provider END AS note FROM stops")
def src_gtfs_csv(v):
    """Lines with quotes inside, a plain one, one that lacks a field, and an empty one."""
    i, name = F.col("id") % 4, F.col("name")
    line = F.when(i == 0, F.concat(F.lit('"'), name, F.lit('","'), "provider", F.lit(', ""x"""'))).when(i == 1, F.concat(name, F.lit(","), "provider")).when(i == 2, name).otherwise("")
    return v.stops.select("id", feeds.csv_fields(line, ["stop_name", "note"]).alias("f")).select("id", "f.*")


@query("SELECT id, unnest(range(len(f)))::INTEGER AS pos, unnest(f) AS field FROM (SELECT id, CASE id % 3 WHEN 0 THEN [name, provider, state] WHEN 1 THEN [name, '', 'a\"b'] ELSE ['say ' || name, ' twice'] END AS f FROM stops)")
def src_csv_naive(v):
    """Lines without quoting rules: outer quotes go, inner ones stay, empty fields count, a quoted comma still cuts."""
    i, name = F.col("id") % 3, F.col("name")
    line = F.when(i == 0, F.concat(F.lit('"'), name, F.lit('", '), "provider", F.lit(","), "state")).when(i == 1, F.concat(name, F.lit(',, a"b '))).otherwise(F.concat(F.lit('"say '), name, F.lit('," twice"')))
    return v.stops.select("id", F.posexplode(feeds.naive_fields(line)).alias("pos", "field"))


_ANY = lambda ws: " OR ".join(f"contains(low, '{w}')" for w in ws)
_UI = " OR ".join(f"low = '{w}' OR starts_with(low, '{w} ') OR ends_with(low, ' {w}')" for w in text.UI_LABELS)


LABELS = "CASE id % 8 WHEN 0 THEN 'Next ' || name WHEN 1 THEN 'Login for ' || name WHEN 2 THEN 'Privacy of ' || provider WHEN 3 THEN name || ' District' WHEN 4 THEN provider || ' to ' || name WHEN 5 THEN name || ' - ' || name WHEN 6 THEN 'Ab → ' || name ELSE name END"


@query(f"""WITH c AS (SELECT trim({LABELS}) AS label FROM stops),
d AS (SELECT label, trim(lower(label)) AS low, list_filter(list_transform(regexp_split_to_array(trim(lower(label)), '\\bto\\b|-|→'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM c)
SELECT CASE WHEN {_UI} THEN 'Filter/UI Element' WHEN {_ANY(['login', 'register', 'password'])} THEN 'Authentication' WHEN {_ANY(['privacy', 'terms', 'about us', 'contact us'])} THEN 'Static Content' WHEN {_ANY(['district', 'block', 'panchayat'])} THEN 'District Page'
WHEN length(label) > 5 AND len(parts) >= 2 AND (parts[1] = parts[-1] OR length(parts[1]) < 3 OR length(parts[-1]) < 3) THEN 'Filter/UI Element' WHEN length(label) > 5 AND len(parts) >= 2 THEN 'Route' ELSE 'Unknown' END AS kind, count(*) AS n, min(label) AS example FROM d GROUP BY 1""")
def src_text_classifier(v):
    """List items of each kind, with markup inside."""
    i, name, to = F.col("id") % 8, F.col("name"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    label = F.when(i == 0, to("Next ", name)).when(i == 1, to("Login for ", name)).when(i == 2, to("Privacy of ", F.col("provider"))).when(i == 3, to(name, " District")).when(i == 4, to(F.col("provider"), " to ", name)).when(i == 5, to(name, " - ", name)).when(i == 6, to("Ab → ", name)).otherwise(name)
    page = v.stops.select(F.col("id").alias("page_id"), to("<ul><LI class='x'> <a href='/'>", label, "</a> </LI></ul>").alias("html"))
    return feeds.candidates(page).groupBy("kind").agg(F.count("*").alias("n"), F.min("label").alias("example"))


@query("SELECT id, unnest(CASE WHEN id % 2 = 0 THEN [390, 450] ELSE range(360, 481, 30) END) AS minute FROM routes WHERE id % 5 <> 0")
def src_curated_timetable(v):
    """Explicit departures, else first, last and headway; rows that cite no source are refused."""
    cited = v.routes.filter("id % 5 <> 0")
    explicit = F.array(F.lit(390).cast("bigint"), F.lit(450).cast("bigint"))
    every = timeofday.headway(F.lit(360).cast("bigint"), F.lit(480).cast("bigint"), F.lit(30).cast("bigint"))
    return cited.select("id", F.explode(F.when(F.col("id") % 2 == 0, explicit).otherwise(every)).alias("minute"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def stream_hourly_counts(v):
    return landing.hourly_counts(v.spark, v.sf_dir)


@query("SELECT provider, content_hash, count(*) OVER (PARTITION BY provider, content_hash) > 0 AS landed FROM (SELECT DISTINCT provider, content_hash FROM raw_records)")
def stream_landed_once(v):
    return landing.landed_once(v.spark, v.sf_dir)
