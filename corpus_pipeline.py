"""Documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import decontaminate, exact, packing, simhash, toxicity
from tramline.session import path_exists, remove_path, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("decontaminate", drop_benchmark), ("packing", pack)]

#: SQL can't express the trained classifier, SimHash, the LSH or the tokenizer; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over `documents`. Each stage's rows are written as Parquet to the shared folder and read again.

    With `folder` (shared by driver and executors, and of this input alone) a run that broke off goes on after the last
    stage that it finished, and all stages stay there. Without it the run has a folder of its own, in which a stage's
    rows are removed once the next stage is written. Rows with null or empty texts are documents like any other; equal
    texts and near copies go with their stages, of rows that repeat an id and a text one stays; an empty table gives no
    sequences; columns beyond those of documents are kept up to the last stage.
    """
    docs, base = table(spark, sf_dir, "documents"), folder or f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if folder is None and before:
            remove_path(spark, before)
        before = path
    return docs
