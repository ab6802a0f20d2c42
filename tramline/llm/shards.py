"""Sharding by jump consistent hashing, with gapless slots in each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.text import whole
from tramline.session import cut

#: Chunks that each shard's rows are numbered in; a chunk's rows are sorted in one task and may spill.
CHUNKS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach): going from n to n + 1 shards moves keys only into shard n."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64)
    at, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (live := to < shards).any():
        at[live] = to[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().astype(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key, F.lit(0)).cast("bigint"))


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide alone. size is the text's UTF-8 bytes plus one
    (a null text has none, a text of any length is read whole). Slots count from 0 without gaps in each shard: by chunk
    of the id and the text, then id, so no task sorts a whole shard, nor all rows that share an id or have none. Rows
    that repeat an id get slots of their own, in an order by text; null ids count as id 0. An empty table gives an empty
    result; other columns are ignored.
    """
    text = whole(F.col(text_col)).cast("binary")
    slim = docs.select(F.col(id_col).alias("i"), (F.length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    rows = cut(slim.withColumn("shard", shard_of(F.col("i"), shards)).withColumn("grown", shard_of(F.col("i"), shards + 1)).withColumn("chunk", F.pmod(F.xxhash64("i", "crc", "size"), F.lit(chunks))))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))  # at most shards x chunks rows
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "chunk").orderBy(F.col("i").asc_nulls_first(), "crc", "size")
    placed = rows.withColumn("r", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "chunk"])
    return placed.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("start") + F.col("r")).cast("bigint").alias("slot"), F.col("grown").cast("int").alias("grown_shard"))
