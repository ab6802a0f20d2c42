"""Bloom filters as tables of bit pages, built and tested in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLANES = (0, 1)  # one hash function each
CELLS_PER_KEY = 16  # in each plane: about one key in 250 that isn't held passes both planes
PAGE = 32768  # bits of one bitmap_construct_agg value, 4 KB
MAX_BROADCAST = 4096  # pages of a plane that are broadcast: 16 MB, so at most 32 MB, enough for 8 million keys
TEMP = "__tramline_"  # of columns that are added to a caller's rows for a while


def cells_for(n: int) -> int:
    """Cells (bits) of a plane for n keys."""
    return max(PAGE, 1 << (CELLS_PER_KEY * max(n, 1) - 1).bit_length())


def _cell(digest: Column, plane: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(plane)), F.lit(cells))


def bloom_pages(keys: DataFrame, digest: str, cells: int) -> DataFrame:
    """The filter of the distinct bigint column `digest`: plane, page and bits. Pages are filled before the shuffle."""
    each = keys.select(F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), _cell(F.col(digest), p, cells).alias("cell")) for p in PLANES])).alias("c"))
    page, bit = F.floor(F.col("c.cell") / PAGE).cast("bigint"), F.col("c.cell") % PAGE
    return each.groupBy("c.plane", page.alias("page")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def flag_held(rows: DataFrame, digest: Column, pages: DataFrame, cells: int, flag: str) -> DataFrame:
    """`rows` with `flag`: whether the filter holds `digest`; never false for a key that it was built from.

    Pages are broadcast up to MAX_BROADCAST a plane; a larger filter is joined by page, which moves the rows.
    """
    out, tests = rows, []
    for p in PLANES:
        cell = _cell(digest, p, cells)
        side = pages.filter(F.col("plane") == p).select(F.col("page").alias(f"{TEMP}page{p}"), F.col("bits").alias(f"{TEMP}bits{p}"))
        out = out.join(F.broadcast(side) if cells <= MAX_BROADCAST * PAGE else side, F.floor(cell / PAGE).cast("bigint") == F.col(f"{TEMP}page{p}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"{TEMP}bits{p}"), (cell % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        tests.append(F.coalesce(F.getbit(byte, (cell % 8).cast("int")) == 1, F.lit(False)))
    return out.withColumn(flag, tests[0] & tests[1]).drop(*[f"{TEMP}{k}{p}" for k in ("page", "bits") for p in PLANES])


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose `key` may be among the one column of `keys` (a written table), and the rows whose `key` is not.

    Up to MAX_BROADCAST pages a plane, a filter tells them apart and nothing is shuffled. With more keys they are joined,
    which moves the rows once for each of the two.
    """
    cells = cells_for(keys.count())
    if cells > MAX_BROADCAST * PAGE:
        own = keys.select(F.col(keys.columns[0]).alias(f"{TEMP}key")).distinct()
        same = F.col(key).eqNullSafe(F.col(f"{TEMP}key"))
        return rows.join(own, same, "left_semi"), rows.join(own, same, "left_anti")
    hashed = keys.select(F.xxhash64(keys.columns[0]).alias("d"))
    marked = flag_held(rows, F.xxhash64(key), bloom_pages(hashed, "d", cells), cells, f"{TEMP}held")
    return marked.filter(F.col(f"{TEMP}held")).select(rows.columns), marked.filter(~F.col(f"{TEMP}held")).select(rows.columns)


def rows_of(rows: DataFrame, by: list[str], keys: DataFrame) -> DataFrame:
    """`rows` joined with `keys` (a written table) on the columns `by`, nulls being equal.

    Up to MAX_BROADCAST pages a plane, only rows that a filter of the keys may hold are shuffled; with more keys the
    rows are, once.
    """
    cells = cells_for(keys.count())
    if cells <= MAX_BROADCAST * PAGE:
        pages = bloom_pages(keys.select(F.xxhash64(*by).alias("d")), "d", cells)
        rows = flag_held(rows, F.xxhash64(*by), pages, cells, f"{TEMP}held").filter(F.col(f"{TEMP}held")).drop(f"{TEMP}held")
    own = keys.select(*[F.col(c).alias(f"{TEMP}{c}") if c in by else F.col(c) for c in keys.columns])
    same = [F.col(c).eqNullSafe(F.col(f"{TEMP}{c}")) for c in by]
    return rows.join(own, same).drop(*[f"{TEMP}{c}" for c in by])
