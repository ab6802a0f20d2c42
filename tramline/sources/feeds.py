"""Readers of landed provider feeds: text, HTML, JSON, CSV and GTFS archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tramline.functions import text
from tramline.sources import archives
from tramline.session import cut

TAGS = "<[^>]*>"


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header: quotes, doubled quotes and line breaks inside quotes; a missing value is an empty string."""
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    return df.na.fill("")


def xml_table(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """XML files as rows of one tag; the schema is stated, so that no pass over the files guesses it."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def csv_fields(line: Column, names: list[str]) -> Column:
    """A struct of the fields of one CSV line, quotes and doubled quotes included."""
    return F.from_csv(line, ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def naive_fields(line: Column) -> Column:
    """Fields of a line that is split at every comma, with outer quotes taken off. For feeds written without quoting."""
    return F.transform(F.split(line, ","), lambda f: F.regexp_replace(F.trim(f), '^"|"$', ""))


def json_rows(body: Column) -> Column:
    """The rows of a JSON answer as an array of JSON texts: the array itself, .data, .elements, or else the answer."""
    rows = lambda c: F.from_json(c, "array<string>")
    start = F.substring(F.ltrim(body), 1, 1)
    inner = F.coalesce(F.get_json_object(body, "$.data"), F.get_json_object(body, "$.elements"))
    return F.when(start == "[", rows(body)).when(F.substring(inner, 1, 1) == "[", rows(inner)).when(F.try_parse_json(body).isNotNull(), F.array(body)).otherwise(F.array(F.to_json(F.struct(body.alias("rawJsonString")))))


def raw_pages(pages: DataFrame) -> DataFrame:
    """Landed pages: page_id, host, size in characters, content_hash and content_type."""
    kind = F.when(F.col("html").rlike("(?i)<html"), "text/html").otherwise("text/plain")
    return pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").cast("bigint").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"), kind.alias("content_type"))


def links(pages: DataFrame, part: str) -> DataFrame:
    """Distinct hrefs that hold `part`, made absolute by their page's host."""
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    found = pages.select(host.alias("host"), href.alias("href")).filter(F.col("href").contains(part))
    return found.select(F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat("host", "href")).alias("url")).distinct()


def crawl(pages: DataFrame, seeds: DataFrame, item: str, following: str, most_pages: int, most_items: int) -> DataFrame:
    """Directory pages as a crawl from each of `seeds` (seed, url) would visit them, over what has landed (url, html).

    A page's first href that matches `following` is its next page; its hrefs that match `item` are what it lists. A
    crawl ends at a page that has not landed, that it or another crawl has visited (of two that come to a page in the
    same step, the smaller seed goes on), after `most_pages`, or once it has `most_items` different items. Per visited
    page: seed, step (from 0), url, and items: its hrefs that are new to the crawl, as long as there is room, in order.

    Each page has one next page, so ways double: after k rounds all ways of 2^k steps are known, whatever the limit.
    """
    first = cut(pages.groupBy("url").agg(F.min("html").alias("html")))  # a page that landed twice is one page
    absolute = lambda href: F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), href))
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    to = F.get(F.filter(hrefs, lambda h: h.rlike(following)), F.lit(0))
    jumps = first.select("url", absolute(to).alias("to")).filter("to is not null")
    jumps = cut(jumps.join(first.select(F.col("url").alias("to")), "to", "left_semi"))
    ways, length = cut(seeds.join(first.select("url"), "url", "left_semi").select("seed", F.lit(0).alias("step"), "url")), 1
    while length < most_pages:
        ways = cut(ways.unionByName(ways.join(jumps, "url").select("seed", (F.col("step") + length).alias("step"), F.col("to").alias("url"))).filter(F.col("step") < most_pages))
        jumps = cut(jumps.select("url", F.col("to").alias("mid")).join(jumps.select(F.col("url").alias("mid"), "to"), "mid").select("url", "to"))
        length *= 2
    owner = ways.groupBy("url").agg(F.min(F.struct("step", "seed")).alias("o"))  # whoever comes first goes on from there, so later ones never matter
    ways = ways.join(owner, "url").withColumn("mine", (F.col("o.step") == F.col("step")) & (F.col("o.seed") == F.col("seed")))
    stop = ways.groupBy("seed").agg(F.min(F.when(~F.col("mine"), F.col("step"))).alias("stop"))
    visited = ways.join(stop, "seed").filter("stop is null or step < stop").select("seed", "step", "url")
    listed = visited.join(first, "url").select("seed", "step", "url", F.posexplode(F.filter(hrefs, lambda h: h.rlike(item))).alias("at", "href")).select("seed", "step", "at", absolute(F.col("href")).alias("item"))
    new = listed.groupBy("seed", "item").agg(F.min(F.struct("step", "at")).alias("f")).select("seed", "item", F.col("f.step").alias("step"), F.col("f.at").alias("at"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("step", "at"))
    new = new.withColumn("n", rank).filter(F.col("n") <= most_items)
    each = new.groupBy("seed", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    full = new.filter(F.col("n") == most_items).select("seed", F.col("step").alias("full"))
    rows = visited.join(each, ["seed", "step"], "left").join(full, "seed", "left").filter("full is null or step <= full")
    return rows.select("seed", F.col("step").cast("int").alias("step"), "url", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def cells(html: Column, row_tag: str, cell_tag: str | None = None) -> Column:
    """Array of rows, each an array of its cells' text without tags; rows of one cell if no cell tag is given."""
    rows = F.regexp_extract_all(html, F.lit(f"(?is)<{row_tag}[^>]*>(.*?)</{row_tag}>"), 1)
    clean = lambda c: F.trim(F.regexp_replace(c, TAGS, ""))
    if cell_tag is None:
        return F.transform(rows, lambda r: F.array(clean(r)))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(f"(?is)<(?:{cell_tag})[^>]*>(.*?)</(?:{cell_tag})>"), 1), clean))


def pairs(c: Column, pattern: str) -> Column:
    """Groups 1 and 2 of every match."""
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("x"))


def matches(pages: DataFrame, pattern: str) -> DataFrame:
    """One row for each page: its matches joined by bars, and how many there are."""
    found = F.regexp_extract_all("html", F.lit(pattern), 0)
    return pages.select("page_id", F.array_join(found, " | ").alias("found"), F.size(found).cast("bigint").alias("n"))


GTFS_ROW = T.StructType([T.StructField("feed", T.StringType()), T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])


def gtfs_rows(spark: SparkSession, path: str, member: str | None = None, batch: int = 5000) -> DataFrame:
    """Rows of the archives at `path`, or of one member of each: feed, file, row and fields. Broken ones are in gtfs_refused()."""
    return archives.read_archives(spark, path, member, batch).filter("error is null").drop("error")


def gtfs_refused(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """The archives (file is null) and members at `path` that are broken: feed, file and error."""
    return archives.read_archives(spark, path, member).filter("error is not null").select("feed", "file", "error")


def archive_rows(files: DataFrame, batch: int = 5000) -> DataFrame:
    """Rows of every .txt member of GTFS archives that lie in cells (path, content), each of at most 2 GB: feed, file, row and fields by name.

    For archives in files see gtfs_rows(), which needs no cell. A broken archive ends the job here.
    """

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for feed, content in zip(frame["path"], frame["content"], strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                for name in sorted(n for n in archive.namelist() if n.endswith(".txt")):
                    rows = []
                    for i, fields in archives.member_rows(archive.open(name)):
                        rows.append((feed, name, i, fields))
                        if len(rows) == batch:
                            yield pd.DataFrame(rows, columns=GTFS_ROW.names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=GTFS_ROW.names)

    return files.select("path", "content").mapInPandas(read, GTFS_ROW)


def gtfs_table(rows: DataFrame, file: str, names: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """One file of gtfs_rows() as columns, with those of `keep`; a field that the feed lacks is an empty string."""
    return rows.filter(F.col("file") == file).select("feed", *keep, *[F.coalesce(F.col("fields")[n], F.lit("")).alias(n) for n in names])


def candidates(pages: DataFrame) -> DataFrame:
    """Texts of list items with what they are."""
    item = F.explode(cells(F.col("html"), "li")).alias("c")
    return pages.select("page_id", item).select("page_id", F.col("c")[0].alias("label")).withColumn("kind", text.candidate_kind(F.col("label")))


HARVEST = "nodes array<struct<externalId:string>>, routePatterns array<struct<externalId:string>>, trips array<struct<stopTimes:array<struct<arrivalTime:string,departureTime:string>>>>"


def harvests(files: DataFrame) -> DataFrame:
    """Harvest files (column body) with their numbers of nodes, routes and timed trips, and why one is refused, if it is."""
    h, none = F.from_json("body", HARVEST), F.lit(0)
    count = lambda c: F.coalesce(F.size(c), none).cast("bigint")
    timed = F.filter("h.trips", lambda t: F.exists(t["stopTimes"], lambda s: F.coalesce(s["departureTime"], s["arrivalTime"]).isNotNull()))
    out = files.withColumn("h", h).withColumns({"nodes": F.greatest(count("h.nodes"), none), "routes": F.greatest(count("h.routePatterns"), none), "timed": F.greatest(count(timed), none)}).drop("h")
    return out.withColumn("refused", F.when(F.col("nodes") == 0, "NO_NODES").when(F.col("routes") == 0, "NO_ROUTES").when(F.col("timed") == 0, "NO_TIMED_TRIPS"))
