"""Incremental ingestion: streams over landed files, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import shared_dir


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: the table may be one file


def run(stream: DataFrame, mode: str, target: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that has landed. Each batch goes to a folder of its own (column batch), which a repeat of it overwrites.

    With `folder` (shared by driver and executors, and of this stream alone) a run goes on where the one before ended:
    it reads only what has landed since, with the state so far, and all batches stay there. A run that broke off in
    a batch repeats that batch, over what it had written. Without it the run has a folder of its own.
    """
    base = folder or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{base}/{target}")


def ingest(stream: DataFrame, keys: list[str], at: str, delay: str, folder: str) -> DataFrame:
    """Stages the rows of a stream of landed records, each key once within `delay` of its time `at`; runs go on from `folder`.

    State holds the keys of the last `delay` only, so it stays as large as what lands in that time, however long the
    feed goes on. A key that comes again after `delay` is staged again, as new content would be; rows later than the watermark are
    dropped, null times among them.
    """
    return run(stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys), "append", "staged", folder)


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users for each hour and kind of event. Users are counted by a first aggregate over (hour, kind, user).

    In update mode a batch writes what it changed, with the count so far, and state past the watermark is dropped; the
    latest count of a key is its largest. Events that land more than two hours behind the latest one of an earlier batch
    come after their hour's state has gone and aren't counted.
    """
    events = stream_of(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    each = events.groupBy(F.window("at", "1 hour").alias("w"), "event_type", "user_id").agg(F.count("*").alias("n"))
    per_user = run(each.select(F.col("w.start").alias("start"), "event_type", "user_id", "n"), "update", "hours")
    per_user = per_user.groupBy("start", "event_type", "user_id").agg(F.max("n").alias("n"))
    return per_user.groupBy("event_type", F.date_format("start", "yyyy-MM-dd HH:00").alias("hour")).agg(F.sum("n").alias("n"), F.count("*").alias("users"))


def landed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, each (provider, content) once however often it is landed: state holds the keys that have been seen."""
    docs = stream_of(spark, sf_dir, "documents")
    raw = docs.select(F.col("source").alias("provider"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    return run(raw.dropDuplicates(["provider", "content_hash"]), "append", "raw").select("provider", "content_hash", F.lit(True).alias("landed"))


def land(new: DataFrame, folder: str, keys: list[str]) -> None:
    """Appends the rows of `new` whose keys the folder doesn't hold yet.

    Reads the keys of the whole folder for each append; a feed that goes on is better landed by ingest(), whose state is
    bounded. Of rows with one key any stays; null keys are equal to none, so they are appended each time.
    """
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(folder).select(*keys).distinct(), keys, "left_anti")
    new.dropDuplicates(keys).write.mode("append").parquet(folder)

