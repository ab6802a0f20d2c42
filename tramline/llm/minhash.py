"""Near-duplicates by MinHash bands, sequential Bayesian verification and an exact check.

A signature has BANDS x ROWS minima. Sets that agree in all rows of a band meet in a bucket; at the least similarity,
one pair in two million meets in none. A candidate's signatures are compared a batch at a time: after each, the
posterior of the pair's similarity (a uniform prior, binomial matches) says how likely it still reaches the threshold,
and the pair goes once that is below MISS. What is left is verified on the full sets.

No bucket is expanded into its pairs. In each round one set of a bucket, the leader, meets all others, so that it is done
with; a bucket whose sets are all connected is done as a whole. A large group of near copies is thus linked in about one
round, with one candidate a copy. When a round no longer halves what is left, the rest is compared by blocks of
bounded size, in which only sets that aren't connected yet meet, and only links that connect something are put out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tramline.llm.bloom import rows_of
from tramline.llm.text import whole
from tramline.operators.components import connected_components
from tramline.session import cut

SHINGLE, PERCENT = 4, 80  # words; 100 x intersection is at least PERCENT x union
BANDS, ROWS = 28, 4  # (1 - 0.8 ** 4) ** 28 = 4e-7
BATCH = 28  # minima that are compared at a time
MISS = 1e-9  # of the posterior: a pair goes when it is less likely than this to reach the threshold
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20  # of one side of a comparison in one task
SEED, SLICE, CACHE, CHUNK = 11, 1 << 20, 300_000, 4096
SPACE = re.compile(rb"[\x20\x09-\x0d]")

_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class _Words(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text; words are read a slice at a time."""
    data, at, read = text.encode("utf-8", "surrogatepass").lower(), 0, []  # of bytes: A-Z alone
    while at < len(data):
        cut_at = SPACE.search(data, at + SLICE)
        end = cut_at.start() if cut_at else len(data)
        words = data[at:end].split()
        read.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        at = end
    words = np.concatenate(read) if read else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    joined = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        joined += words[k : len(words) - size + 1 + k] * _PLACES[k]
    return np.unique(_mixed(joined))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima over the set; empty for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint16)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), CHUNK):
        np.minimum(best, (low[k : k + CHUNK, None] * _TIMES + _PLUS).min(0), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches with which a pair stays.

    With a uniform prior, n minima of which m match leave a Beta(m + 1, n - m + 1) posterior. Its mass above x is the
    chance of at most m successes in n + 1 trials with chance x. x allows for minima that match by their 16 bits only.
    """
    x, out = percent / 100 + (1 - percent / 100) / 65536, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        mass, m = (1 - x) ** (n + 1), 0
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append(m)
    return out


LEAST = least_matches()


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For signatures in rows (or one against many): which pairs no batch prunes."""
    left, total = np.arange(max(len(a), len(b))), np.zeros(max(len(a), len(b)), np.int64)
    for k, least in enumerate(LEAST):
        part = slice(k * BATCH, (k + 1) * BATCH)
        x, y = (s[:, part] if len(s) == 1 < len(total) else s[left, part] for s in (a, b))
        total[left] += (x == y).sum(1)
        left = left[total[left] >= least]
    out = np.zeros(len(total), bool)
    out[left] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Of two sorted arrays of distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(text: Column) -> Column:
    """Of whole texts: n (size of the set), d (its digest, 128 bits) and sig (its signature); a null counts as empty."""

    @F.pandas_udf("n bigint, d binary, sig binary")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            found = shingle_set(text)
            out.append((len(found), hashlib.md5(found.tobytes(), usedforsecurity=False).digest(), signature(found).tobytes()))
        return pd.DataFrame(out, columns=["n", "d", "sig"])

    return sketched(whole(text))


def _stacked(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, BANDS * ROWS)


@F.pandas_udf(BooleanType())
def _plausible(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(plausible(_stacked(a), _stacked(b)) if len(a) else np.zeros(0, bool))


@F.pandas_udf(BooleanType())
def _similar(leader: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
    """Rows come sorted by the leader, so its set is made once."""
    out, key, held = [], None, None
    for k, a, b in zip(leader, one, other, strict=True):
        if k != key:
            key, held = k, shingle_set(b)
        out.append(similar(shingle_set(a), held))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (d, l) whose sets are similar, each set's text being moved once for each of its pairs."""
    a, b = (sets.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in ("d", "l"))
    sized = pairs.join(a, "d").join(b, "l").filter(100 * F.least("nd", "nl") >= PERCENT * F.greatest("nd", "nl"))
    left = cut(sized.filter(_plausible("sd", "sl")).select("d", "l"))
    full = left.join(texts.withColumnRenamed("text", "td"), "d").join(texts.select(F.col("d").alias("l"), F.col("text").alias("tl")), "l")
    return full.filter(_similar("l", "td", "tl")).select("d", "l").distinct()


def _blocks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by block (k, x, y): links that connect sets of different labels."""

    def close(rows: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(rows, ignore_index=True)
        sigs, side, across = _stacked(block["sig"]), block["part"].to_numpy(), block["x"][0] != block["y"][0]
        names, root = pd.factorize(block["label"])[0], None
        root = names.copy()
        sets: dict[int, np.ndarray] = {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(block["text"][i])
            return sets[i]

        links = []
        for i in range(len(block) - 1):
            rest = np.arange(i + 1, len(block))
            rest = rest[root[rest] != root[i]]
            if across:
                rest = rest[side[rest] != side[i]]
            if not len(rest):
                continue
            for j in rest[plausible(sigs[i : i + 1], sigs[rest])].tolist():
                if root[i] != root[j] and similar(full(i), full(j)):
                    root[root == root[j]] = root[i]
                    links.append((block["d"][i], block["d"][j]))
        return pd.DataFrame(links, columns=["d", "l"])

    key, held = None, []
    for frame in frames:
        for k, rows in frame.groupby(["k", "x", "y"], sort=False):
            if k != key and held:
                yield close(held)
                held = []
            key = k
            held.append(rows)
    if held:
        yield close(held)


def _block_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within buckets (k, d), each cut into parts of bounded size and compared part by part. Equal buckets once."""
    same = buckets.groupBy("k").agg(F.bit_xor(F.xxhash64("d")).alias("h"), F.count("*").alias("c")).groupBy("h", "c").agg(F.min("k").alias("k")).select("k")
    rows = buckets.join(same, "k").join(sets, "d").join(labels.withColumnRenamed("node", "d"), "d", "left").withColumn("label", F.coalesce("root", "d")).drop("root")
    rows = cut(rows)
    sized = rows.groupBy("k").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("parts"))
    rows = rows.join(sized, "k").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).join(texts, "d")
    rows = rows.select("k", "x", "y", "part", "d", "label", "sig", "text")
    return rows.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInPandas(_blocks, "d binary, l binary").distinct()


def link_sets(sets: DataFrame, texts: DataFrame, buckets: DataFrame) -> DataFrame | None:
    """Labels (node, root) of the sets that are connected by links, from buckets (k, d) of two sets at least.

    `sets` has d, n and sig, `texts` a text for each d that is in a bucket; all are written tables.
    """
    links, labels, before = None, None, buckets.count()
    while before:
        leaders = buckets.groupBy("k").agg(F.min("d").alias("l"))
        led = cut(buckets.join(leaders, "k").filter("d <> l"))
        found = cut(_verified(led.select("d", "l").distinct(), sets, texts))
        links = found if links is None else cut(links.unionByName(found))
        labels = connected_components(links, "d", "l")
        left = led.join(labels.withColumnRenamed("node", "d"), "d", "left").select("k", "d", F.coalesce("root", "d").alias("root"))
        left = cut(left)
        mixed = left.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("k")
        buckets = cut(left.join(mixed, "k").select("k", "d"))
        size = buckets.count()
        if 2 * size > before:
            more = cut(_block_links(buckets, labels, sets, texts))
            return connected_components(links.unionByName(more), "d", "l")
        before = size
    return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that is reachable over links, its own included), kept.

    Sets of shingles are linked at PERCENT; equal sets are one. A null text counts as empty; texts without words have
    an empty set and are linked with nothing, so that component_id is their own id, which may be null. Texts of any
    length are read whole. Repeated rows give repeated rows, all with the same kept; a row without an id has the
    component of its set and isn't kept if that has an id, else component_id is null and it is kept. An empty table gives an empty result;
    other columns are ignored.
    """
    t = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("i"), t.alias("t"), sketch(F.col(text_col)).alias("s")).select("i", "t", "s.*")
    rows = cut(rows)
    classes = rows.filter("n > 0").groupBy("d").agg(F.min("i").alias("low"), F.min(F.struct("i", "t")).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes)
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)])
    bands = cut(classes.select("d", F.explode(keys).alias("k")))
    buckets = cut(bands.join(bands.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k"), "k").select("k", "d"))
    need = cut(buckets.select("d").distinct().join(classes, "d").select("d", F.col("one.i").alias("i"), F.col("one.t").alias("t")))
    texts = cut(rows_of(docs.select(F.col(id_col).alias("i"), t.alias("t"), whole(F.col(text_col)).alias("text")), ["i", "t"], need).select("d", "text").dropDuplicates(["d"]))
    labels = link_sets(classes.select("d", "n", "sig"), texts, buckets)
    named = classes.select("d", "low", F.col("d").alias("root"))
    if labels is not None:
        roots = cut(classes.select("d", "low").join(labels.select(F.col("node").alias("d"), F.col("root").alias("r")), "d", "left").select("d", "low", F.coalesce("r", "d").alias("root")))
        lowest = cut(roots.groupBy("root").agg(F.min("low").alias("component_id")))
        named = cut(roots.join(lowest, "root").select("d", "component_id"))
    else:
        named = named.select("d", F.col("low").alias("component_id"))
    slim = rows.select("i", "n", "d")
    out = slim.filter("n > 0").join(named, "d").select("i", "n", "component_id").unionByName(slim.filter("n = 0").select("i", "n", F.col("i").alias("component_id")))
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("i").eqNullSafe(F.col("component_id")).alias("kept"))
