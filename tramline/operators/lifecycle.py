"""Dataset versions: what lands, what is skipped, staged, validated, promoted."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.operators.relational import distinct_on


def landable(routes: DataFrame, trips: DataFrame, stops: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls whose stop exists and whose trip's route exists; and a row of tallies."""
    t = trips.join(routes.select(F.col("id").alias("route_id")), "route_id", "left_semi").select(F.col("id").alias("trip_id"))
    ok = calls.join(stops.select(F.col("id").alias("stop_id")), "stop_id", "left_semi").join(t, "trip_id", "left_semi")
    kept = ok.agg(F.countDistinct("trip_id").alias("trips"), F.count("*").alias("calls"))
    totals = trips.agg(F.count("*").alias("all_trips")).crossJoin(calls.agg(F.count("*").alias("all_calls")))  # one row each
    tally = kept.crossJoin(totals).select("trips", "calls", (F.col("all_trips") - F.col("trips")).alias("dropped_trips"), (F.col("all_calls") - F.col("calls")).alias("dropped_calls"))
    return ok, tally


def content_hash(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """A hash of each group's rows that doesn't depend on their order: rows are hashed, then their hashes added up.

    Sums of four 32-bit parts need no collected list, so a group may be of any size. Each field is written as its
    length, a colon and its text, or as n if it is null, so no two different rows are written alike.
    """
    field = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    row = F.sha2(F.concat(*[field(F.col(c)) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"_p{i}") for i in range(4)]
    sums = df.withColumn("_h", row).groupBy(*group).agg(F.count("*").alias("rows"), *parts)
    return sums.select(*group, "rows", F.sha2(F.concat_ws("|", *[F.col(f"_p{i}").cast("string") for i in range(4)], F.col("rows").cast("string")), 256).alias("content_hash"))


def skip_unchanged(landed: DataFrame, known: DataFrame, keys: Sequence[str], order: str, hash_col: str = "content_hash") -> DataFrame:
    """Rows of `landed` whose hash differs from the latest known one (by `order`) of their key; a change back to an
    earlier content lands."""
    last = known.groupBy(*keys).agg(F.max_by(hash_col, order).alias(hash_col))
    return landed.join(last, [*keys, hash_col], "left_anti")


def quarantine(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the first reason; null in a rule's predicate means it holds."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def findings(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Rule, severity and number of rows that break it; one pass for all rules."""
    counts = df.agg(*[F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(name) for name, _, bad in rules])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(n).alias("violations")) for n, s, _ in rules]))
    return counts.select(each.alias("f")).select("f.*")


def time_source(explicit: Column, estimated: Column, scraped: Column) -> Column:
    return F.when(explicit.isNotNull(), explicit).when(estimated, "INTERPOLATED").when(scraped.isNotNull(), "SCRAPED")


def over_threshold(failed: Column, total: Column) -> Column:
    """More failures than 5 and than a tenth of all."""
    return failed > F.greatest(F.lit(5.0), total * 0.1)


def progress(items: DataFrame, run: str, order: Sequence[str], every: int = 25) -> DataFrame:
    """The checkpoints of each run: at every `every`-th of its items in order, and at the last: run, done, at (that item's order)."""
    w = W.partitionBy(run).orderBy(*order)
    rows = items.withColumn("done", F.row_number().over(w).cast("bigint")).withColumn("all", F.count("*").over(W.partitionBy(run)))
    return rows.filter((F.col("done") % every == 0) | (F.col("done") == F.col("all"))).select(run, "done", F.struct(*order).alias("at"))


def rest(items: DataFrame, run: str, order: Sequence[str], saved: DataFrame) -> DataFrame:
    """What a run has to do again after it broke off: the items past its last checkpoint in `saved` (run, at), or all if it has none."""
    last = saved.groupBy(run).agg(F.max("at").alias("_at"))
    return items.join(last, run, "left").filter(F.col("_at").isNull() | (F.struct(*order) > F.col("_at"))).drop("_at")


class Snapshots:
    """Versions of one dataset as Parquet folders, and numbered pointers, all in a folder that Spark reaches.

    The pointer of the highest number names the active version. A pointer is written beside its place and renamed to a
    number that isn't taken, so a reader finds the old version or the new one, and a crash leaves the old one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> int:
        """The highest pointer number; 0 if there is none."""
        if not self.fs.exists(self.path(self.root)):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        return max((int(n[7:]) for n in names if n.startswith("ACTIVE-") and n[7:].isdigit()), default=0)

    def active(self) -> DataFrame | None:
        number = self._last()
        if not number:
            return None
        version = json.loads(self.spark.read.text(f"{self.root}/ACTIVE-{number}", wholetext=True).first()[0])["version"]
        return self.spark.read.parquet(f"{self.root}/{version}")

    def promote(self, df: DataFrame, rules: Sequence[tuple[str, Column]] = (), key: str | None = None) -> str:
        """Writes a version, checks it as written, then adds a pointer to it. A version that fails gets none."""
        number = self._last()
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{version}")
        new = self.spark.read.parquet(f"{self.root}/{version}")
        checks = [F.count("*").alias("rows"), *[F.count(F.when(F.coalesce(bad, F.lit(False)), 1)).alias(name) for name, bad in rules]]
        found = new.agg(*checks).first().asDict()
        failed = [n for n, _ in rules if found[n]]
        if not found["rows"] or failed or key and not new.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{version} is refused: {found['rows']} rows, broken rules {failed or 'none'}")
        old = self.active()
        if old is not None and found["rows"] < old.count() / 2:
            raise ValueError(f"{version} is refused: it has fewer than half of the active rows")
        self._point(number, {"version": version})
        return version

    def _point(self, number: int, manifest: dict) -> None:
        """Adds the pointer after `number`, unless another has been added meanwhile."""
        beside, place = self.path(f"{self.root}/.{manifest['version']}"), self.path(f"{self.root}/ACTIVE-{number + 1}")
        text = self.fs.create(beside, True)
        text.write(bytearray(json.dumps(manifest).encode()))
        text.close()
        if self.fs.exists(place) or not self.fs.rename(beside, place):
            raise ValueError(f"{manifest['version']} is refused: another version was promoted meanwhile")


def refuse_shrink(harvests: DataFrame, key: str, timed: Column, least: int) -> DataFrame:
    """Per key: how many were harvested, how many of them are timed, and whether to keep the version before: with no
    timed ones, or fewer than `least` in all."""
    n = harvests.groupBy(key).agg(F.count("*").alias("harvested"), F.count_if(timed).alias("timed"))
    return n.withColumn("refused", (F.col("timed") == 0) | (F.col("harvested") < least))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return distinct_on(df, keys, order)
