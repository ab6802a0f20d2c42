"""The transit tables that the queries run on, derived from the driver's tables in integer arithmetic."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.relational import numbered
from tramline.session import table

VIEW_SQL = {
    "stops": "SELECT p_partkey AS id, p_name AS name, p_brand AS provider, p_type AS state, CASE WHEN p_partkey % 10 <> 0 THEN 21.5e0 + ((p_partkey * 7919) % 6000) / 1000e0 END AS lat, CASE WHEN p_partkey % 10 <> 0 THEN 85.8e0 + ((p_partkey * 104729) % 4100) / 1000e0 END AS lng FROM part",
    "dense_stops": "SELECT p_partkey AS id, p_name AS name, p_brand AS provider, p_type AS state, 22.5e0 + ((p_partkey * 7919) % 97) / 10000e0 AS lat, 88.3e0 + ((p_partkey * 104729) % 89) / 10000e0 AS lng FROM part",
    "routes": "SELECT c_custkey AS id, c_name AS long_name, c_mktsegment AS provider, n_name AS agency, r_name AS state, CAST(abs(floor(c_acctbal / 100)) AS BIGINT) AS fare_inr FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "trips": "SELECT o_orderkey AS id, o_custkey AS route_id, o_orderstatus AS direction, o_orderpriority AS vehicle, o_orderdate AS created_at FROM orders",
    "calls": "SELECT l_orderkey AS trip_id, l_partkey AS stop_id, l_suppkey AS platform, l_linenumber AS seq, (l_partkey * 37 + l_linenumber * 11) % 1440 AS minute, CASE WHEN l_partkey % 4 <> 0 THEN lpad(CAST(((l_partkey * 37 + l_linenumber * 11) % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((l_partkey * 37 + l_linenumber * 11) % 1440) % 60 AS VARCHAR), 2, '0') END AS departs, CASE l_returnflag WHEN 'N' THEN 'SCRAPED' WHEN 'R' THEN 'INTERPOLATED' ELSE 'OFFICIAL' END AS time_source FROM lineitem",
    "places": "SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_name AS name FROM part)",
    "runs": "SELECT event_id AS id, event_type AS provider, CASE WHEN value < 20 THEN 'FAILED' WHEN value < 40 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, ts AS created_at, CAST(floor(value) AS BIGINT) AS parsed, CAST(user_id % 7 AS BIGINT) AS failed FROM events",
    "patterns": "SELECT conv_id AS route_id, turn + 1 AS seq, role AS name FROM conversations",
    "zone_corners": "SELECT s_suppkey AS poly, i, 21500000 + (s_suppkey * 102947) % 6000 * 1000 + (100000 + (s_suppkey * 31 + i * 17) % 9 * 60000) // 10 * dy AS y, 85800000 + (s_suppkey * 733103) % 4100 * 1000 + (100000 + (s_suppkey * 31 + i * 17) % 9 * 60000) // 10 * dx AS x FROM supplier, (VALUES (0, 0, 10), (1, 7, 7), (2, 10, 0), (3, 7, -7), (4, 0, -10), (5, -7, -7), (6, -10, 0), (7, -7, 7)) AS ways(i, dy, dx)",
    "raw_records": "SELECT doc_id AS id, source AS provider, sha256(coalesce(text, '')) AS content_hash, n_chars AS size FROM documents",
}


class Views:
    """The tables of one folder: the driver's own as table(name), the transit ones as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _stops(self, lat, lng) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider"), F.col("p_type").alias("state"), lat.alias("lat"), lng.alias("lng"))

    @cached_property
    def stops(self) -> DataFrame:
        key = F.col("p_partkey")
        located = lambda c: F.when(key % 10 != 0, c)
        return self._stops(located(21.5 + (key * 7919) % 6000 / 1000.0), located(85.8 + (key * 104729) % 4100 / 1000.0))

    @cached_property
    def dense_stops(self) -> DataFrame:
        key = F.col("p_partkey")
        return self._stops(22.5 + (key * 7919) % 97 / 10000.0, 88.3 + (key * 104729) % 89 / 10000.0)

    @cached_property
    def routes(self) -> DataFrame:
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("long_name"), F.col("c_mktsegment").alias("provider"), F.col("n_name").alias("agency"), F.col("r_name").alias("state"), F.abs(F.floor(F.col("c_acctbal") / 100)).cast("bigint").alias("fare_inr"))

    @cached_property
    def trips(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("route_id"), F.col("o_orderstatus").alias("direction"), F.col("o_orderpriority").alias("vehicle"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def calls(self) -> DataFrame:
        minute = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 1440
        two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
        source = F.when(F.col("l_returnflag") == "N", "SCRAPED").when(F.col("l_returnflag") == "R", "INTERPOLATED").otherwise("OFFICIAL")
        return self.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), F.col("l_suppkey").alias("platform"), F.col("l_linenumber").alias("seq"), minute.alias("minute"), F.when(F.col("l_partkey") % 4 != 0, F.concat(two(F.floor(minute / 60)), F.lit(":"), two(minute % 60))).alias("departs"), source.alias("time_source"))

    @cached_property
    def places(self) -> DataFrame:
        return numbered(self.table("part").select(F.col("p_name").alias("name")).distinct(), "name")

    @cached_property
    def runs(self) -> DataFrame:
        status = F.when(F.col("value") < 20, "FAILED").when(F.col("value") < 40, "RUNNING").otherwise("COMPLETED")
        return self.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), status.alias("status"), F.col("ts").alias("created_at"), F.floor("value").cast("bigint").alias("parsed"), (F.col("user_id") % 7).cast("bigint").alias("failed"))

    @cached_property
    def patterns(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("route_id"), (F.col("turn") + 1).alias("seq"), F.col("role").alias("name"))

    @cached_property
    def zones(self) -> DataFrame:
        """A star around a place for each supplier: eight corners, some of them notches."""
        k = F.col("s_suppkey")
        y, x = 21500000 + k * 102947 % 6000 * 1000, 85800000 + k * 733103 % 4100 * 1000
        reach = [((100000 + (k * 31 + i * 17) % 9 * 60000) / 10).cast("bigint") for i in range(8)]
        ways = [(0, 10), (7, 7), (10, 0), (7, -7), (0, -10), (-7, -7), (-10, 0), (-7, 7)]
        ring = F.array(*[F.struct((y + r * dy).alias("y"), (x + r * dx).alias("x")) for r, (dy, dx) in zip(reach, ways, strict=True)])
        return self.table("supplier").select(k.alias("poly"), ring.alias("ring"))

    @cached_property
    def raw_records(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("provider"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), F.col("n_chars").alias("size"))
