"""The prefix trie of conversations, one row a node.

Turns are numbered, rebuilt and reduced to digests first, so that no text is shuffled; equal conversations become one
sequence with a weight. Sequences with the same first turn are one subtrie: subtries are dealt to buckets by the digest of
that turn, and each bucket builds its tries of pointer dictionaries and adds up its nodes in postorder. A subtrie
of more rows than a bucket takes is split again, by the next turn in which its sequences differ: the turns they share
are a chain of nodes, and what follows are subtries of their own, which may be split in turn. The totals of what was
split off are added to the chains from the deepest up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.session import cut

FAMILY, HEADS = 100, 6  # conversations that share a base, and the turns taken from it: fewer than HEADS
BUCKET_ROWS = 50_000  # turns of distinct sequences in one bucket, and in one subtrie that isn't split
NO_END = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end bigint, inside binary, top boolean"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, d (from 1), t (digest of role and text, 128 bits), size (code points of the text); ties go by role, then digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("t"), F.length(text).cast("bigint").alias("size")
    )
    d = F.row_number().over(W.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "t"))
    return turns.select("c", d.cast("bigint").alias("d"), "t", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (c), and their rows (c, d, t, size): the first h turns of the family's base, then their own after h."""
    base = F.col("c") - F.col("c") % FAMILY
    heads = turns.filter((F.col("c") == base) & (F.col("d") < HEADS)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("d", "t", "size"))).alias("heads"))
    convs = turns.select("c").distinct().select("c", base.alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).alias("h")).join(heads, "base", "left")
    convs = cut(convs.select("c", "h", F.least("h", F.coalesce(F.size("heads"), F.lit(0))).alias("k"), "heads").withColumn("heads", F.when(F.col("k") > 0, F.slice("heads", F.lit(1), F.col("k").cast("int")))))
    first = convs.select("c", F.explode("heads").alias("x")).select("c", "x.*")
    own = turns.join(convs.select("c", "h", "k"), "c").filter("d > h").select("c", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "t", "size")
    return convs.select("c"), cut(first.unionByName(own))


def sequences(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """c and s, the smallest conversation with the same turns. A sequence is told by two digests of its (d, t), in any order."""
    sums = rows.groupBy("c").agg(F.bit_xor(F.xxhash64("d", "t")).alias("p"), F.bit_xor(F.xxhash64("t", "d", F.lit(13))).alias("q"), F.count("*").alias("n"))
    each = convs.join(sums, "c", "left").fillna(0)
    same = each.groupBy("p", "q", "n").agg(F.min("c").alias("s"))
    return each.join(same, ["p", "q", "n"]).select("c", "s", "n")


def _digests(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by s and c: the digest of each s's list, fed to it a batch at a time."""
    key, digest = None, hashlib.sha256()
    for frame in frames:
        out = []
        for s, rows in frame.groupby("s", sort=False):
            if s != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = s, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, rows["c"].tolist())).encode())
        yield pd.DataFrame(out, columns=["s", "sha"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["s", "sha"])


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries of one bucket."""
    rows = rows.sort_values(["s", "d"])
    step: list[dict[bytes, int]] = []
    tops: dict[bytes, int] = {}
    depth, parent, low, convs, size, end, inside, up = [], [], [], [], [], [], [], []
    last, at = None, -1
    for s, w, d, t, z, key, of, above in zip(*(rows[c].tolist() for c in ("s", "w", "d", "t", "size", "key", "inside", "up")), strict=True):
        pointers = tops if s != last else step[at]
        if s != last and last is not None:
            end[at] = last
        name = key if s != last else t
        before, node = (-1 if s != last else at), pointers.get(name)
        if node is None:
            node = pointers[name] = len(step)
            step.append({})
            depth.append(d), parent.append(before), low.append(s), convs.append(0), size.append(z), end.append(None), inside.append(of), up.append(above)
        convs[node] += w
        low[node] = min(low[node], s)
        last, at = s, node
    if last is not None:
        end[at] = last
    leaves, saved = [0] * len(step), [(n - 1) * z for n, z in zip(convs, size, strict=True)]
    for node in range(len(step) - 1, -1, -1):  # children come after their parents
        leaves[node] = leaves[node] or 1
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return pd.DataFrame(
        {
            "conv_id": low, "depth": depth, "parent_conv_id": [low[p] if p >= 0 else u for p, u in zip(parent, up, strict=True)], "n_convs": convs, "n_children": [len(x) for x in step],
            "n_leaves": leaves, "saved_tokens": saved, "end": pd.array(end, "Int64"), "inside": pd.Series(inside, dtype=object), "top": [p < 0 for p in parent],
        }
    )


def _split(work: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the subtries `big`: one row each (chain), the nodes that all its sequences share (links), and the rows beyond.

    `work` has s, w, d, t, size, key (of the subtrie), start (depth above it), inside (key it was split from), up (its
    parent's conv_id).
    """
    rows = cut(work.join(big, "key"))
    whole = rows.filter(F.col("d") == F.col("start") + 1).groupBy("key").agg(F.count("*").alias("seqs"), F.sum("w").alias("convs"), F.min("s").alias("low"), F.first("start").alias("start"), F.first("inside").alias("inside"), F.first("up").alias("up"))
    levels = rows.groupBy("key", "d").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).join(whole.select("key", "seqs"), "key")
    shared = levels.groupBy("key").agg(F.min(F.when((F.col("n") < F.col("seqs")) | (F.col("a") < F.col("b")), F.col("d"))).alias("fork"), F.max("d").alias("deepest"))
    chain = cut(whole.join(shared, "key").withColumn("p", F.coalesce(F.col("fork") - 1, "deepest")))
    near = rows.select("key", "s", "d", "t", "size", "w").join(chain.select("key", "p", "low"), "key")
    links = cut(near.filter("s = low and d <= p").select("key", "d", "size"))
    beyond = near.filter("d > p").select("s", "w", "d", "t", "size", "p", "low", F.col("key").alias("inside"))
    fork = near.filter(F.col("d") == F.col("p") + 1).select("s", F.unhex(F.md5(F.concat("key", "t"))).alias("key"))
    ends = rows.groupBy("key", "s").agg(F.max("d").alias("last")).join(chain.select("key", "p"), "key").filter("last = p").groupBy("key").agg(F.max("s").alias("end"))
    chain = cut(chain.join(ends, "key", "left"))
    return chain, links, cut(beyond.join(fork, "s").select("s", "w", "d", "t", "size", "key", F.col("p").alias("start"), "inside", F.col("low").alias("up")))


def _chain_nodes(chain: DataFrame, links: DataFrame, tops: DataFrame) -> DataFrame:
    """The shared nodes of split subtries, with the totals of what was split off; those stand in `tops`."""
    below = tops.groupBy(F.col("inside").alias("key")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    rows = links.join(chain.join(below, "key", "left"), "key")
    is_last, is_top = F.col("d") == F.col("p"), F.col("d") == F.col("start") + 1
    after = F.sum((F.col("convs") - 1) * F.col("size")).over(W.partitionBy("key").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"), F.when(is_top, F.col("up")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(is_last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + after).cast("bigint").alias("saved_tokens"), F.when(is_last, F.col("end")).alias("end"), "inside", is_top.alias("top"),
    )


def prefix_trie(conversations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty; rows of one turn go by role, then by digest, and repeated rows are turns like
    any other; rows without conv_id are of no conversation. Texts of any length are read whole. A conversation that has
    no turn once rebuilt is a member of the root only. An empty table gives no node; other columns are ignored.
    """
    convs, rows = rebuilt(cut(numbered_turns(conversations)))
    seqs = cut(sequences(convs, rows))
    classes = cut(seqs.groupBy("s").agg(F.count("*").alias("w"), F.max("n").alias("n")))
    root = classes.agg(F.min("s").alias("low"), F.sum("w").alias("convs"), F.min(F.when(F.col("n") == 0, F.col("s"))).alias("end"), F.sum("n").alias("rows")).first()  # four numbers
    mine = rows.withColumnRenamed("c", "s").join(classes.select("s", "w"), "s")
    nothing = F.lit(None).cast("binary")
    work = mine.join(rows.filter("d = 1").select(F.col("c").alias("s"), F.col("t").alias("key")), "s").withColumns({"start": F.lit(0).cast("bigint"), "inside": nothing, "up": F.lit(root["low"]).cast("bigint")})
    work = cut(work)
    small, splits = [], []
    while True:
        big = cut(work.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("key"))
        if big.isEmpty():
            small.append(work)
            break
        small.append(work.join(big, "key", "left_anti"))
        chain, links, work = _split(work, big)
        splits.append((chain, links))
    rows_in = small[0]
    for more in small[1:]:
        rows_in = rows_in.unionByName(more)
    buckets = max(1, math.ceil((root["rows"] or 0) / bucket_rows))
    nodes = cut(rows_in.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_tries, NODE))
    for chain, links in reversed(splits):
        nodes = cut(nodes.unionByName(_chain_nodes(chain, links, nodes.filter("top"))))
    tops = nodes.filter("top and inside is null").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    number = lambda x: F.lit(x).cast("bigint")
    top = tops.select(
        number(root["low"]).alias("conv_id"), number(0).alias("depth"), number(None).alias("parent_conv_id"), number(root["convs"]).alias("n_convs"), F.col("kids").alias("n_children"),
        F.coalesce("leaves", number(1)).alias("n_leaves"), F.coalesce("saved", number(0)).alias("saved_tokens"), number(root["end"]).alias("end"),
    ).filter("conv_id is not null")
    every = nodes.drop("inside", "top").unionByName(top)
    alone = classes.filter("w = 1").select("s", F.sha2(F.col("s").cast("string").cast("binary"), 256).alias("sha"))
    several = seqs.join(classes.filter("w > 1").select("s"), "s").select("s", "c").repartition("s").sortWithinPartitions("s", "c").mapInPandas(_digests, "s bigint, sha string")
    ends = alone.unionByName(several).select(F.col("s").alias("end"), "sha")
    return every.join(ends, "end", "left").drop("end").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_END))).drop("sha")
