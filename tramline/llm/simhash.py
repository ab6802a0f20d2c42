"""Near-duplicates by SimHash, linked through covering locality-sensitive hashing.

Fingerprints that differ in at most RADIUS bits are linked. Bit i of a fingerprint has a vector m_i of RADIUS + 1 bits;
for each vector v other than zero, a mask keeps the bits with an odd product of m_i and v. Up to RADIUS vectors m_i
span less than the whole space, so some v is orthogonal to all of them: that mask hides every bit in which a
pair differs. With one table for each mask, every pair within the radius meets in one of them, for certain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.bloom import TEMP, split_by
from tramline.llm.text import whole
from tramline.operators.components import connected_components
from tramline.session import cut

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one bucket that are compared in one task. Those of larger buckets are linked through midpoints.
MAX_BUCKET = 8192
SLICE = 1 << 15  # shingles of one text that are counted at a time


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius + 1) - 1 masks."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, n, digest = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest
    starts, ends = starts.tolist(), ends.tolist()
    for k in range(0, n, SLICE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + SLICE], ends[k : k + SLICE], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """Fingerprints of whole texts as bigint; a null counts as empty."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return simhash(whole(text))


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links from each fingerprint of a connected part to the part's smallest one."""
    left, a, b = fps, [], []
    while len(left) > 1:
        part, left, at = [left[:1]], left[1:], 0
        while at < len(part) and len(left):
            for x in part[at]:
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    part.append(left[near])
                    left = left[~near]
            at += 1
        members = np.concatenate(part)
        if len(members) > 1:
            low = members.view(np.int64).min()
            rest = members.view(np.int64)
            a += rest[rest != low].tolist()
            b += [int(low)] * (len(members) - 1)
    return a, b


def _links(radius: int, most: int):
    """Over rows sorted by bucket: links within each bucket, and the members (b null) of buckets above `most`."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, over = None, np.zeros(0, np.uint64), False  # the bucket that is being read
        a: list[int] = []
        b: list[int | None] = []

        def close() -> None:
            if over:
                a.extend(held.view(np.int64).tolist())
                b.extend([None] * len(held))
            elif len(held) > 1:
                links = _forest(np.unique(held), radius)
                a.extend(links[0])
                b.extend(links[1])

        for frame in frames:
            k, fp = frame["k"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
            # Buckets of one row link nothing; the first and last may go on in other batches.
            more = np.diff(np.append(starts, len(k))) > 1
            more[:1] = more[-1:] = True
            for i in np.flatnonzero(more).tolist():
                s, e = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(k)
                if k[s] != key:
                    close()
                    key, held, over = k[s], fp[s:e], False
                else:
                    held = np.concatenate((held, fp[s:e]))
                if len(held) > most:
                    over = True
                    close()
                    held = held[:0]
            yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})
            a.clear(), b.clear()
        close()
        yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})

    return run


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints through the values within half the radius of both: linear in their number."""
    half = [0, *(1 << i for i in range(BITS))]
    if radius >= 4:
        half += [1 << i | 1 << j for i in range(BITS) for j in range(i)]
    signed = [x - (1 << 64) if x >> 63 else x for x in half]
    flips = F.array(*[F.lit(x).cast("bigint") for x in signed])
    points = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    low = points.groupBy("mid").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    return points.join(low, "mid").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, most: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect what is within `radius` (an even number up to 4) among the distinct values `fp`."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keys = F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))
    rows = fps.select("fp", F.explode(keys).alias("k")).select("k", "fp")
    found = cut(rows.repartition("k").sortWithinPartitions("k").mapInPandas(_links(radius, most), "a bigint, b bigint").distinct())
    links, large = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("fp"))
    return links if large.isEmpty() else links.unionByName(_midpoint_links(large.distinct(), radius))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: id, fp (bigint), component_id: the smallest id that is reachable over links, its own included.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length are read whole. Repeated rows
    give repeated rows; an id that is null has the component of its fingerprint. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = cut(docs.select(F.col(id_col).alias("i"), fingerprints(F.col(text_col)).alias("fp")))
    firsts = cut(rows.groupBy("fp").agg(F.min("i").alias("first")))
    roots = connected_components(link_fingerprints(firsts.select("fp"), radius))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = cut(linked.select("fp", "root", "first"))
    lowest = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(linked.join(lowest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(F.col("i").alias(id_col), "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """near_groups() with the fingerprint as 16 hex digits."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the rows of a group other than its smallest id, in all its columns.

    Rows that repeat the id that stays are one document and stay together; a row without an id stays. Only rows whose id
    a Bloom filter of the ids that go may hold are shuffled; the texts of the others stay where they are.
    """
    drop = cut(near_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(f"{TEMP}id")).distinct())
    touched, rest = split_by(docs, "doc_id", drop)
    return rest.unionByName(touched.join(drop, F.col("doc_id") == F.col(f"{TEMP}id"), "left_anti"))
