"""Provider pages, archives and harvests, and the writes that follow them."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators import mapping, relational
from tramline.plans.registry import query
from tramline.session import cut, shared_dir
from tramline.sources import archives, feeds, pages


def _listed(v, one):
    """One text for each route, of what `one` makes of each of its rows, in order."""
    rows = v.patterns.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("rows"))
    return rows.select(F.col("route_id").alias("page_id"), F.array_join(F.transform("rows", one), "\n").alias("inner"))


BUS_CALLS = "SELECT route_id AS page_id, 'call' AS kind, row_number() OVER (PARTITION BY route_id ORDER BY seq) + 1 AS n, CAST(seq AS VARCHAR) AS a, CASE WHEN seq % 3 = 0 THEN '_ _ : _ _' ELSE '06:1' || seq % 10 END AS b, name || ' & ' || seq AS c, CASE WHEN seq % 2 = 0 THEN '' ELSE '18:05' END AS d FROM patterns"


@query(f"SELECT DISTINCT route_id AS page_id, 'field' AS kind, CAST(0 AS BIGINT) AS n, 'Bus Name' AS a, 'No ' || route_id AS b, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS d FROM patterns UNION ALL SELECT DISTINCT route_id, 'field', 1, 'Depot', 'A <B>', '', NULL FROM patterns UNION ALL {BUS_CALLS}")
def src_bus_detail(v):
    """A page for each route: a table with cells that aren't closed, then a block of four cells for each stop."""
    seq = lambda r: r["seq"].cast("string")
    at = lambda r: F.when(r["seq"] % 3 == 0, F.lit("_ _ : _ _")).otherwise(F.concat(F.lit("06:1"), (r["seq"] % 10).cast("string")))
    one = lambda r: F.concat(F.lit("<div class='x row sud'><div> "), seq(r), F.lit("</div><div><b>"), at(r), F.lit("</b></div>\n<div>"), r["name"], F.lit("\n &amp;  "), seq(r), F.lit("</div><div>"), F.when(r["seq"] % 2 == 0, "").otherwise("18:05"), F.lit("</div></div><div class='row'><div>other</div></div>"))
    table = F.concat(F.lit("<p>x</p><table class='table-striped'><tr><th>Bus Name<td> No "), F.col("page_id").cast("string"), F.lit("</tr><tr><td>Depot</td><td>A &lt;B&gt;<td> </tr></table>"))
    return pages.bus_detail(_listed(v, one).select("page_id", F.concat(table, "inner").alias("html")))


@query("SELECT route_id AS page_id, 'Line ' || route_id AS line, name || ' & ' || seq AS name, CASE WHEN seq % 5 <> 0 THEN seq END AS seq, seq % 2 = 0 AS interchange FROM patterns")
def src_metro_structured(v):
    """A page for each route: stations inside its section count, the one after it doesn't; an odd number is none."""
    seq = lambda r: r["seq"].cast("string")
    one = lambda r: F.concat(F.lit("<li data-station-name='"), r["name"], F.lit(" &amp; "), seq(r), F.lit("' data-sequence=' "), F.when(r["seq"] % 5 != 0, seq(r)).otherwise("?"), F.lit(" ' data-interchange="), F.when(r["seq"] % 2 == 0, "Yes").otherwise("no"), F.lit(">x"))
    html = F.concat(F.lit("<h1>Lines</h1><section data-metro-line='Line "), F.col("page_id").cast("string"), F.lit("'><ul>"), "inner", F.lit("</ul></section><li data-station-name='outside' data-sequence='1'>"))
    return pages.metro_lines(_listed(v, one).select("page_id", html.alias("html")))


@query("SELECT 'f' || route_id AS feed, 2 * (row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1) AS row, CAST(seq AS VARCHAR) AS stop_id, name || ', \"x\"' || chr(10) || 'y' AS stop_name, '' AS stop_lat FROM patterns")
def src_gtfs_zip(v):
    """An archive for each route: a byte order mark, a row for each stop with quotes and a line break, blank rows between."""

    @F.pandas_udf("binary")
    def archive(seqs: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for own, named in zip(seqs, names, strict=True):
            body = io.BytesIO()
            with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
                rows = "".join(f'{i},"{name}, ""x""\ny"\r\n,\r\n' for i, name in zip(own, named, strict=True))
                z.writestr("stops.txt", f"\ufeffstop_id, stop_name\r\n{rows}\r\n")
                z.writestr("notes.md", "not a table")
            out.append(body.getvalue())
        return pd.Series(out)

    routes = v.patterns.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("r"))
    files = routes.select(F.concat(F.lit("f"), F.col("route_id").cast("string")).alias("path"), archive("r.seq", "r.name").alias("content"))
    return feeds.gtfs_table(feeds.archive_rows(files), "stops.txt", ["stop_id", "stop_name", "stop_lat"], keep=["row"])


ARCHIVES = "SELECT 'f' || CAST(floor(route_id / 50) AS BIGINT) || '.zip' AS feed, CAST(floor(route_id / 50) AS BIGINT) % 4 = 1 AS broken, row_number() OVER (PARTITION BY floor(route_id / 50) ORDER BY route_id, seq NULLS FIRST, name NULLS FIRST) AS k, CAST(route_id AS VARCHAR) AS route_id, coalesce(CAST(seq AS VARCHAR), '') AS seq, coalesce(name, '') AS name FROM patterns WHERE route_id IS NOT NULL"


def _error_pages(feeds: DataFrame, folder: str) -> DataFrame:
    """Puts a page where the archive of each of `feeds` was, as a provider that is down answers; returns them."""

    def put(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for feed in batch.column(0).to_pylist():
                with system.open_output_stream(f"{root}/{feed}.zip") as out:
                    out.write(b"<html><h1>503</h1></html>")
            yield batch

    return feeds.select("feed").mapInArrow(put, "feed string")


@query(f"WITH a AS ({ARCHIVES}) SELECT feed, 2 * (k - 1) AS row, route_id, name || ', \"x\"' || chr(10) || 'y' AS stop_name, seq, CAST(NULL AS VARCHAR) AS refused FROM a WHERE NOT broken UNION ALL SELECT DISTINCT feed, NULL, NULL, NULL, NULL, 'BadZipFile' FROM a WHERE broken")
def src_gtfs_archives(v):
    """Archives of fifty routes each, written to the shared folder as files and read by members; of every fourth an error page has come instead."""
    folder = f"{shared_dir(v.spark)}/gtfs-{uuid.uuid4().hex}"
    p = v.patterns.withColumn("n", F.floor(F.col("route_id") / 50).cast("bigint"))
    feed = F.concat(F.lit("f"), F.col("n").cast("string"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = F.concat(text("route_id"), F.lit(',"'), text("name"), F.lit(', ""x""\ny",'), text("seq"))
    own = p.select(feed.alias("feed"), F.lit("stop_times.txt").alias("file"), F.lit(1).alias("part"), "route_id", "seq", "name", F.concat(body, F.lit("\r\n,")).alias("line"))
    head = own.select("feed").distinct().select("feed", F.lit("stop_times.txt").alias("file"), F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in (("route_id", "bigint"), ("seq", "bigint"), ("name", "string"))], F.lit("\ufeffroute_id, stop_name,seq").alias("line"))
    notes = head.withColumns({"file": F.lit("notes.md"), "line": F.lit("not a table")})
    written = archives.write_archives(own.unionByName(head).unionByName(notes), folder, ["part", "route_id", "seq", "name"])
    cut(_error_pages(cut(written).filter(F.substring("feed", 2, 20).cast("bigint") % 4 == 1), folder))
    rows = archives.read_archives(v.spark, folder, "stop_times.txt")
    field = lambda n: F.col("fields")[n].alias(n)
    return rows.select("feed", "row", field("route_id"), field("stop_name"), field("seq"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("refused"))


@query("SELECT id, id % 3 AS nodes, id % 2 AS routes, id % 4 AS timed, CASE WHEN id % 3 = 0 THEN 'NO_NODES' WHEN id % 2 = 0 THEN 'NO_ROUTES' WHEN id % 4 = 0 THEN 'NO_TIMED_TRIPS' END AS refused FROM stops")
def src_harvest_file(v):
    some = lambda n, one: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(one), n.cast("int")), ","), F.lit("]"))
    k = F.col("id")
    body = F.concat(F.lit('{"nodes":'), some(k % 3, '{"externalId":"n"}'), F.lit(',"routePatterns":'), some(k % 2, '{"externalId":"r"}'), F.lit(',"trips":'), some(k % 4, '{"stopTimes":[{"departureTime":"06:00"}]}'), F.lit("}"))
    return feeds.harvests(v.stops.select("id", body.alias("body"))).select("id", "nodes", "routes", "timed", "refused")


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def src_json_fetch(v):
    """JSON files with a stated schema, as landed."""
    folder = f"{shared_dir(v.spark)}/json-{uuid.uuid4().hex}"
    v.table("events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k")).write.json(folder)
    return v.spark.read.schema("event_id bigint, event_type string, k string").json(folder)


@query("SELECT id, name, CASE WHEN id % 3 = 0 THEN 'x' ELSE provider || ' & <' || state || '>' END AS note, lat FROM stops")
def src_xml_fetch(v):
    """XML files with a stated schema and row tag, as landed."""
    folder = f"{shared_dir(v.spark)}/xml-{uuid.uuid4().hex}"
    note = F.when(F.col("id") % 3 == 0, "x").otherwise(F.concat("provider", F.lit(" & <"), "state", F.lit(">")))
    v.stops.select("id", "name", note.alias("note"), "lat").write.format("xml").option("rootTag", "stops").option("rowTag", "stop").save(folder)
    return feeds.xml_table(v.spark, folder, "stop", "id bigint, name string, note string, lat double")


@query("SELECT CAST(id AS VARCHAR) AS id, name || chr(10) || '\"' || provider || '\", ' || state AS note, CASE WHEN id % 3 = 0 THEN '' ELSE state END AS state FROM stops")
def src_csv_fetch(v):
    """CSV files as landed: quotes, commas and line breaks inside fields, and missing values."""
    folder = f"{shared_dir(v.spark)}/csv-{uuid.uuid4().hex}"
    note = F.concat("name", F.lit('\n"'), "provider", F.lit('", '), "state")
    rows = v.stops.select("id", note.alias("note"), F.when(F.col("id") % 3 != 0, F.col("state")).alias("state"))
    rows.write.options(header=True, quote='"', escape='"', quoteAll=False).csv(folder)
    return feeds.csv_table(v.spark, folder)


CALLS = "SELECT trip_id, stop_id, CAST(seq AS BIGINT) AS seq, platform, departs FROM calls WHERE stop_id % 9 <> 0"


@query(f"""WITH c AS ({CALLS}), e AS (SELECT trip_id, arg_min(stop_id, (seq, stop_id, platform)) AS a, arg_max(stop_id, (seq, stop_id, platform)) AS b FROM c GROUP BY trip_id HAVING count(departs) = 0 AND count(*) >= 2)
SELECT trip_id, stop_id, seq, departs AS at FROM c WHERE departs IS NOT NULL UNION ALL SELECT trip_id, a, 1, '06:00' FROM e UNION ALL SELECT trip_id, b, 2, '07:00' FROM e""")
def map_api_trip(v):
    calls = v.calls.select("trip_id", F.when(F.col("stop_id") % 9 != 0, F.col("stop_id")).alias("stop_id"), F.col("seq").cast("bigint").alias("seq"), "platform", F.col("departs").alias("at"))
    trips = v.trips.select(F.col("id").alias("trip_id"), F.lit("06:00").alias("starts"), F.lit("07:00").alias("ends"))
    return mapping.api_trips(trips, calls)


@query("SELECT id, CASE id WHEN 1 THEN 'First' WHEN 2 THEN 'Second' ELSE name END AS name FROM stops")
def sink_update_case(v):
    new = v.spark.createDataFrame([(1, "First"), (2, "Second"), (-1, "Nobody")], "id bigint, name string")
    return relational.update_values(v.stops.select("id", "name"), new, "id", "name")


@query("SELECT id, CASE WHEN provider = 'Brand#11' THEN upper(name) ELSE name END AS name, provider FROM stops")
def sink_bulk_insert(v):
    """A table by provider; a second insert for one provider replaces that provider's rows and no others."""
    folder = f"{shared_dir(v.spark)}/stops-{uuid.uuid4().hex}"
    rows = v.stops.select("id", "name", "provider")
    rows.write.partitionBy("provider").parquet(folder)
    rows.filter("provider = 'Brand#11'").withColumn("name", F.upper("name")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider").parquet(folder)
    return v.spark.read.parquet(folder)


@query("SELECT provider || ':' || strftime(created_at, '%Y-%m-%d') AS job_id, min(id) AS first_asked, count(*) AS asked FROM runs GROUP BY 1")
def sink_enqueue(v):
    """One job for each provider and day, however often it is asked for."""
    job = F.concat_ws(":", "provider", F.date_format("created_at", "yyyy-MM-dd"))
    return v.runs.groupBy(job.alias("job_id")).agg(F.min("id").alias("first_asked"), F.count("*").alias("asked"))


@query("SELECT id, name FROM stops ORDER BY id LIMIT 50")
def page_clamp(v):
    """A size beyond the largest page gives the largest page."""
    return relational.page(v.stops.select("id", "name"), [F.col("id")], 0, 999)
