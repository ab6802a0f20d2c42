"""Relational building blocks: keyed picks, snapshot updates, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.session import cut

PART = 500_000  # rows of a task of dealt()


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps only n rows of a key in each task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def parts(rows: int) -> int:
    """Tasks for `rows`: PART each, however many there are."""
    return 1 + rows // PART


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by its keys over as many tasks as its rows need.

    Spark puts tasks together by the bytes that they read, packed; where each row makes many, or long ones, memory then goes
    by what is made of 64 MB, so the number of rows decides here. They are counted before, which for Parquet reads no column.
    """
    return df.repartition(parts(df.count()), *keys)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """`old` with `columns` of the rows whose key `new` has, and the rows of `new` that `old` lacks; other columns keep their values."""
    marked = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    both = old.join(marked, F.col(key) == F.col("_key"), "full")
    pick = lambda c: F.when(F.col("_key").isNotNull() & (F.col(key).isNull() | F.lit(c in columns)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.coalesce(key, "_key").alias(c) if c == key else pick(c) if c in new.columns else F.col(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """`old` without the rows of any parent that `new` has, and the rows of `new`."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_values(old: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """`old` with `column` from the rows of `values` where it has the key."""
    return old.join(values.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def find_or_create(old: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """`old` and one row for each key that it lacks."""
    return old.unionByName(wanted.join(old, key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def prune(root: DataFrame, doomed: Column, chain: Sequence[tuple[DataFrame, str]], key: str = "id") -> list[DataFrame]:
    """New snapshots after a delete that cascades down a chain of (child, foreign key): the root's rows, then each child's whose parent remains."""
    gone, out = root.filter(doomed).select(F.col(key).alias("_gone")), [root.filter(~F.coalesce(doomed, F.lit(False)))]
    for child, fk in chain:
        out.append(child.join(gone, F.col(fk) == F.col("_gone"), "left_anti"))
        if key in child.columns:
            gone = child.join(gone, F.col(fk) == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone"))
    return out


def numbered(df: DataFrame, by: str, name: str = "id") -> DataFrame:
    """`df` with `name`: 1, 2, ... in the order of distinct values of `by`, nulls first.

    Rows are dealt by ranges of `by` and numbered in each range; only the ranges' sizes meet in one task. The ranges are
    written first, as their bounds come from a sample and must be the same for the sizes and the rows.
    """
    dealt = cut(df.repartitionByRange(F.col(by).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.col(by).asc_nulls_first()))
    return dealt.join(starts, "_range").select((F.col("_start") + own).cast("bigint").alias(name), *df.columns)


def experimental(routes: DataFrame, trips: DataFrame, marked: Column, kept: Column) -> DataFrame:
    """`routes` with doomed: marked as an experiment, without any trip, and not on the list to keep. For prune()."""
    used = trips.select(F.col("route_id").alias("_route")).distinct()
    return routes.join(used, F.col("id") == F.col("_route"), "left").withColumn("doomed", marked & F.col("_route").isNull() & ~kept).drop("_route")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 50) -> DataFrame:
    """One page with pages counted from 1 and the size held to 1..most."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def contains_ci(columns: Sequence[str], text: str) -> Column:
    """Any column holds `text` in any case; % and _ stand for themselves."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False))
    return out
