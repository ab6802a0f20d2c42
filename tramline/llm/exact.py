"""Exact deduplication behind a two-pass Bloom filter, in built-in functions only.

Pass one finds the digests (64 bits of the texts' hashes) that more than one row has, and puts them into a Bloom
filter of two planes. Pass two tests each row: only rows that the filter holds can have an equal, and only those are
shuffled and grouped by their hash; all others pass straight through. Pass one moves a digest of eight bytes a row and
no row; it counts them before the shuffle. A bitmap of once and twice for each task would move more than that from
64 / CELLS_PER_KEY tasks on, as it has CELLS_PER_KEY bits for each row of the whole table. The filter's size goes by
the digests that repeat, not by the rows, so it tells as much at any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.bloom import TEMP, bloom_pages, cells_for, flag_held, split_by
from tramline.llm.text import ascii_lower, whole
from tramline.session import cut


def text_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(whole(text)).cast("binary"), 256)


def repeated_digests(hashes: DataFrame, hashed: str) -> DataFrame:
    """The digests (column d) that more than one row has."""
    return hashes.groupBy(F.xxhash64(hashed).alias("d")).agg(F.count("*").alias("n")).filter("n > 1").select("d")


def maybe_repeated(slim: DataFrame, hashed: str, flag: str) -> DataFrame:
    """`slim` with `flag`: whether another row may have the same hash."""
    digests = cut(repeated_digests(slim, hashed))
    cells = cells_for(digests.count())
    return flag_held(slim, F.xxhash64(hashed), cut(bloom_pages(digests, "d", cells)), cells, flag)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256. Texts are equal after lower-casing A-Z only.

    The row with the largest id of a group stays; nulls in the id count as smallest. A null text counts as
    empty; texts of any length are hashed whole. Rows that repeat both id and text count in group_size, and one of them
    is kept. An empty table gives an empty result; other columns are ignored.
    """
    slim = cut(docs.select(F.col(id_col).alias("i"), text_hash(F.col(text_col)).alias("h")))
    tested = maybe_repeated(slim, "h", "maybe")
    some, alone = tested.filter("maybe"), tested.filter("not maybe")
    groups = cut(some.groupBy("h").agg(F.max("i").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    # Repeats of one id: only the first of them can be kept.
    again = cut(some.groupBy("h", "i").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = some.drop("maybe").join(groups, "h", "left")
    rows = rows.select("i", "h", F.when(F.col("group_size").isNull(), F.col("i")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    rows = rows.withColumn("kept", F.col("i").eqNullSafe(F.col("keep_id")))
    if not again.isEmpty():
        marked = rows.join(again.select(F.col("h").alias("_h"), F.col("i").alias("_i"), F.lit(True).alias("_again")), (F.col("h") == F.col("_h")) & F.col("i").eqNullSafe(F.col("_i")), "left")
        first = F.row_number().over(W.partitionBy("h", "i").orderBy("group_size")) == 1
        rows = marked.filter("_again is null").drop("_h", "_i", "_again").unionByName(marked.filter("_again").withColumn("kept", F.col("kept") & first).drop("_h", "_i", "_again"))
    alone = alone.select("i", "h", F.col("i").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(rows).select(F.col("i").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.col("h").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, the one with the largest id, in all its columns.

    What goes is found on ids and hashes. A second filter, of the ids that go, lets the other rows pass as they are:
    only rows with such an id are shuffled, by id and hash, so a large group of copies is spread. Nulls, ties, long
    texts, repeated rows and empty tables as in exact_dedup().
    """
    h, n = f"{TEMP}h", f"{TEMP}n"
    slim = cut(docs.select(F.col(id_col).alias("i"), text_hash(F.col(text_col)).alias("h")))
    some = cut(maybe_repeated(slim, "h", "maybe").filter("maybe").select("i", "h"))
    keep = cut(some.groupBy("h").agg(F.max("i").alias("k"), F.count("*").alias("n")).filter("n > 1").select(F.col("h").alias("kh"), "k"))
    # Both sides are written and nothing else goes by h, so that adaptive execution can split a hot group.
    gone = cut(some.join(keep, F.col("h") == F.col("kh")).filter(~F.col("i").eqNullSafe(F.col("k"))).select(F.col("i").alias(f"{TEMP}i"), F.col("h").alias(f"{TEMP}gh")))
    again = some.groupBy("h", "i").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("i").alias(f"{TEMP}i"))
    touched, rest = split_by(docs, id_col, cut(gone.select(f"{TEMP}i").unionByName(again).distinct()))
    left = touched.withColumn(h, text_hash(F.col(text_col))).join(gone, (F.col(h) == F.col(f"{TEMP}gh")) & F.col(id_col).eqNullSafe(F.col(f"{TEMP}i")), "left_anti")
    first = left.withColumn(n, F.row_number().over(W.partitionBy(h, id_col).orderBy(F.lit(0)))).filter(F.col(n) == 1)
    return rest.unionByName(first.select(docs.columns))


EXACT_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY n.h, n.doc_id) = 1 AS kept, n.h AS text_sha256
FROM n JOIN g USING (h)"""
