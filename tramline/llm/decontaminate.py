"""Benchmark decontamination through CGK embeddings.

A CGK walk reads a window of words with a pointer: each step puts out the word under it and moves on if a random bit,
fixed for that step and word, says so. Windows within a small edit distance fall into step again after each edit, so
their outputs have a small Hamming distance. Bit sampling hashes the output at a few steps. Windows are scaled to the
item: a class of items has windows of about half its length, at every few words of the item, so that one of them holds
few of the edits, and so many walks and samples that the tables alone find TARGET of the items at their last edit. What
they miss is found by a check of parts: an item that may have k edits is cut into k + 1 parts, one of which stands
unchanged in whatever holds the item.

Each text's hits are gathered by key, not by item and place. An item is looked at if enough of its words are in the text
at all, at the places around which enough of them are; there the exact edit distance decides.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.held import held
from tramline.llm.text import whole

SIMILARITY = 0.8  # 1 - edits / words of the item, at least
#: Classes by words of the item: least words, window, stride of windows in the item, steps of a walk, sampled steps, walks, tables of a walk.
CLASSES = ((40, 12, 6, 20, 5, 2, 5), (24, 10, 4, 16, 4, 2, 5), (15, 7, 2, 11, 3, 2, 6), (10, 5, 1, 8, 3, 2, 5), (4, 4, 1, 6, 3, 3, 5), (1, 1, 1, 1, 1, 1, 1))
TARGET = 0.95  # recall of the tables alone, at the most edits that an item may have
SEED = 5
UNKNOWN = 4096  # symbols for words of no item
NONE = -1  # for a word of marks only, which counts neither in items nor in texts
KNOWN_SHARE = 0.7  # of the words of a window that may be hashed
BLOCK_WORDS = 1_000_000  # words of the items that are matched in one pass
TOKENS, CACHE, SLICE, BITS = 1 << 16, 200_000, 1024, 22
HITS = 1 << 20  # of hashes that are gathered before they are looked at
FEW = 16  # places of an item in a text from which its words around them are counted for all at once
STRIP = ".,;:!?()[]{}\"'*$%&#|<>-_"


def normal(word: str) -> str:
    return word.lower().strip(STRIP)


class _Symbols(dict):
    """Word as it stands to its symbol: of an item's word, one of the UNKNOWN ones after them, or NONE."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        key = normal(word)
        found = self.vocabulary.get(key)
        if found is None:
            found = len(self.vocabulary) + zlib.crc32(key.encode("utf-8", "surrogatepass")) % UNKNOWN if key else NONE
        self[word] = found
        return found


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Fewest edits between the item and any part of the region, and that part's end."""
    at = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (region != word))))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min()), int(row.argmin())


def _before(words: np.ndarray) -> np.ndarray:
    """For each word of a text, where it stood last, or -1."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), -1)
    same = words[order[1:]] == words[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _distinct(member: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """For each start, how many distinct words of a set are among the `width` words from it: each counts where it stands first."""
    at = np.flatnonzero(member)
    change = np.bincount(np.maximum(np.maximum(before[at] + 1, at - width + 1), 0), minlength=len(member) + 1)
    return np.cumsum(change - np.bincount(at + 1, minlength=len(member) + 1))[:-1]


class Matcher:
    """Finds items (lists of words) in texts."""

    def __init__(self, items: list[list[str]], similarity: float = SIMILARITY, parts: bool = True):
        vocabulary: dict[str, int] = {}
        self.items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for words in items]
        self.symbols, self.size = _Symbols(vocabulary), len(vocabulary)
        self.edits = [math.floor((1 - similarity) * len(x) + 1e-9) for x in self.items]
        self.pad = self.size + UNKNOWN  # beyond a text's end
        self.bags = [np.unique(x) for x in self.items]
        rng = np.random.default_rng(SEED)
        found: list[tuple[np.ndarray, list[tuple[int, int]]]] = []  # keys, and the item and offset of each
        self.classes, self.parts = [], []
        for k, (least, window, stride, steps, sample, walks, tables) in enumerate(CLASSES):
            most = math.inf if k == 0 else CLASSES[k - 1][0]
            own = [i for i, x in enumerate(self.items) if least <= len(x) < most]
            moves = rng.integers(0, 2, (walks, steps, self.pad + 1)).astype(np.int64)
            samples = np.arange(sample) * steps // sample + rng.integers(0, steps // sample, (walks, tables, sample))  # one of each stretch of steps
            salts = rng.integers(1, 1 << 63, (walks, tables, sample), dtype=np.uint64) | np.uint64(1)
            marks = rng.integers(1, 1 << 63, (walks, tables), dtype=np.uint64)
            if not own:
                continue
            spots = [(i, o) for i in own for o in sorted({*range(0, len(self.items[i]) - window + 1, stride), len(self.items[i]) - window})]
            text = np.concatenate([np.append(self.items[i], np.full(steps + 1, self.pad)) for i in own])
            begin = dict(zip(own, np.cumsum([0, *[len(self.items[i]) + steps + 1 for i in own]]).tolist(), strict=False))
            hashed = self._hash(text, np.array([begin[i] + o for i, o in spots]), moves, samples, salts, marks)
            self.classes.append((window, steps, moves, samples, salts, marks))
            found += [(column, spots) for column in hashed]
        self.salts = rng.integers(1, 1 << 63, max(map(len, self.items), default=0) + 1, dtype=np.uint64) | np.uint64(1)
        spots_of: dict[int, list[tuple[int, int]]] = {}  # by words of a part
        for i, x in enumerate(self.items):
            cuts = [k * len(x) // (self.edits[i] + 1) for k in range(self.edits[i] + 2)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                spots_of.setdefault(high - low, []).append((i, low))
        text = np.concatenate([*self.items, np.zeros(0, np.int64)])
        begin = np.cumsum([0, *map(len, self.items)])
        for length, spots in sorted(spots_of.items()) if parts else ():
            self.parts.append(length)
            found.append((self._hash_part(text, np.array([begin[i] + o for i, o in spots]), length), spots))
        # All keys in order, with the items and offsets of each side by side.
        keys = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)])
        spots = np.array([s for _, some in found for s in some], np.int64).reshape(-1, 2)
        order = np.lexsort((spots[:, 1], spots[:, 0], keys))
        keys, spots = keys[order], spots[order]
        again = np.append(False, (keys[1:] == keys[:-1]) & (spots[1:] == spots[:-1]).all(1)) if len(keys) else np.zeros(0, bool)
        keys, self.spots = keys[~again], spots[~again]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.first = np.append(self.first, len(keys))
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.keys >> np.uint64(64 - BITS)] = True

    def _hash_part(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(starts), np.uint64(length))
        for k in range(length):
            h = (h ^ text[starts + k].astype(np.uint64) * self.salts[k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def _hash(self, text: np.ndarray, starts: np.ndarray, moves: np.ndarray, samples: np.ndarray, salts: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
        """A hash of each walk's sampled outputs from `starts`, by walk and table."""
        out = []
        for walk in range(len(moves)):
            at, said = starts.copy(), []
            for step in range(moves.shape[1]):
                said.append(text[at])
                at = at + moves[walk, step][said[-1]]
            for table in range(samples.shape[1]):
                h = np.full(len(starts), marks[walk, table])
                for salt, step in zip(salts[walk, table], samples[walk, table], strict=True):
                    h = (h ^ said[step].astype(np.uint64) * salt) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append(h * np.uint64(0xBF58476D1CE4E5B9))
        return out

    def find(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each text, its items: the fewest edits, and the word at which that part ends."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        part, count = [], 0
        for i, text in enumerate(texts):
            words = text.split()
            symbols = np.fromiter(map(self.symbols.__getitem__, words), np.int64, len(words))
            kept = np.flatnonzero(symbols != NONE)
            part.append((i, symbols[kept], kept))
            count += len(words)
            if count > TOKENS or i + 1 == len(texts):
                self._scan(part, found)
                part, count = [], 0
        return found

    def _scan(self, part: list[tuple[int, np.ndarray, np.ndarray]], found: list[dict[int, tuple[int, int]]]) -> None:
        gap = np.full(max([c[1] for c in self.classes] + self.parts, default=0) + 1, self.pad)
        text = np.concatenate([x for _, words, _ in part for x in (words, gap)])
        begin = np.cumsum([0, *[len(words) + len(gap) for _, words, _ in part]])
        known = np.concatenate(([0], np.cumsum(text < self.size)))
        keys: list[np.ndarray] = []
        places: list[np.ndarray] = []

        def meet(column: np.ndarray, starts: np.ndarray) -> None:
            hit = np.flatnonzero(self.seen[column >> np.uint64(64 - BITS)])
            at = np.searchsorted(self.keys, column[hit])
            same = self.keys[np.minimum(at, len(self.keys) - 1)] == column[hit]
            keys.append(at[same].astype(np.int32))
            places.append(starts[hit[same]].astype(np.int32))
            if sum(map(len, keys)) > HITS:
                self._gathered(part, begin, np.concatenate(keys), np.concatenate(places), found)
                keys.clear(), places.clear()

        for window, _, *walk in self.classes:
            end = np.minimum(np.arange(len(text)) + window, len(text))
            starts = np.flatnonzero((known[end] - known[:-1] >= math.ceil(KNOWN_SHARE * window)) & (text != self.pad))
            for k in range(0, len(starts), 1 << 18):
                some = starts[k : k + (1 << 18)]
                for column in self._hash(text, some, *walk):
                    meet(column, some)
        for length in self.parts:
            starts = np.flatnonzero(known[length:] - known[:-length] == length)  # an item's part has only known words
            for k in range(0, len(starts), 1 << 18):
                some = starts[k : k + (1 << 18)]
                meet(self._hash_part(text, some, length), some)
        if keys:
            self._gathered(part, begin, np.concatenate(keys), np.concatenate(places), found)

    def _gathered(self, part: list[tuple[int, np.ndarray, np.ndarray]], begin: np.ndarray, key: np.ndarray, place: np.ndarray, found: list[dict[int, tuple[int, int]]]) -> None:
        owner = np.searchsorted(begin, place, side="right") - 1
        order = np.lexsort((place, key, owner))
        key, place, owner = key[order], place[order], owner[order]
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1 if len(owner) else []
        start = 0
        for end in ends:
            self._look(part[owner[start]], key[start:end], place[start:end] - begin[owner[start]], found)
            start = end

    def _look(self, text: tuple[int, np.ndarray, np.ndarray], key: np.ndarray, place: np.ndarray, found: list[dict[int, tuple[int, int]]]) -> None:
        """Verifies what one text may hold: `place` are the words at which a hash is `key`, in the order of both."""
        words = text[1]
        some, low = np.unique(key, return_index=True)
        high = np.append(low[1:], len(key))
        here = np.zeros(self.pad + 1, bool)
        here[words] = True
        of: dict[int, set[tuple[int, int]]] = {}  # by item: number of the key, and offset
        alike: dict[bytes, int] = {}  # keys hit at the same places count once
        for n, k in enumerate(some.tolist()):
            n = alike.setdefault(place[low[n] : high[n]].tobytes(), n)
            for item, offset in self.spots[self.first[k] : self.first[k + 1]].tolist():
                of.setdefault(item, set()).add((n, offset))
        before, member = None, np.zeros(self.pad + 1, bool)
        for item, spots in sorted(of.items()):
            bag, slack = self.bags[item], self.edits[item] + 2
            # Each word of the item that the text lacks is an edit.
            if here[bag].sum() < len(bag) - self.edits[item]:
                continue
            each = [place[low[n] : high[n]] - offset for n, offset in spots]
            if sum(map(len, each)) > FEW:
                if before is None:
                    before = _before(words)
                member[bag] = True
                counts = _distinct(member[words], before, len(self.items[item]) + 4 * slack)
                member[bag] = False
                enough = counts >= len(bag) - self.edits[item]
                each = [at[enough[np.clip(at - 2 * slack, 0, len(words) - 1)]] for at in each]
            at = np.unique(np.concatenate(each))
            # Places a few words apart look at the same region.
            _, first = np.unique(at // (slack + 1), return_index=True)
            for a in at[first].tolist():
                self._verify(text, item, a, 2 * slack, found)

    def _verify(self, text: tuple[int, np.ndarray, np.ndarray], item: int, at: int, slack: int, found: list[dict[int, tuple[int, int]]]) -> None:
        best = found[text[0]].get(item)
        if best and best[0] == 0:
            return
        (_, words, kept), target = text, self.items[item]
        if at >= 0 and np.array_equal(words[at : at + len(target)], target):
            found[text[0]][item] = (0, int(kept[at + len(target) - 1]) + 1)
            return
        low = max(0, at - slack)
        region = words[low : at + len(target) + slack]
        if np.isin(target, region).sum() < len(target) - self.edits[item]:
            return  # each word that the region lacks is an edit
        edits, end = edit_distance(target, region)
        if edits <= self.edits[item] and (best is None or edits < best[0]):
            found[text[0]][item] = (edits, int(kept[low + end - 1]) + 1)


def item_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterable[list[tuple[int, list[str]]]]:
    """The items in blocks of about BLOCK_WORDS words; items without words match nothing and are left out."""
    words = F.size(F.split(F.trim(whole(F.col(text_col))), r"\s+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.filter(block == k).select(id_col, text_col).collect()  # a stated query set, block by block
        if items := [(r[0], w) for r in sorted(rows, key=lambda r: (str(r[0]), str(r[1]))) if (w := item_words(r[1]))]:
            yield items


def _key(items: list) -> str:
    return f"{len(items)}-{zlib.crc32(repr(items).encode('utf-8', 'surrogatepass'))}"


LEAK = "array<struct<item_id:bigint,edits:int,item_words:int,end_word:int>>"


def _leaks(text: Column, items: list[tuple[int, list[str]]], spark) -> Column:
    sent, key = spark.sparkContext.broadcast(items), _key(items)

    @F.pandas_udf(LEAK)
    def leaks(texts: pd.Series) -> pd.Series:
        matcher, ids = held(f"leaks-{key}", lambda: Matcher([w for _, w in sent.value])), sent.value
        found = [f for k in range(0, len(texts), SLICE) for f in matcher.find(texts.iloc[k : k + SLICE].tolist())]
        return pd.Series([[{"item_id": ids[i][0], "edits": e, "item_words": len(ids[i][1]), "end_word": end} for i, (e, end) in sorted(f.items())] for f in found])

    return leaks(whole(text))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per text and item that it holds: doc_id, item_id, edits, item_words, end_word, similarity.

    An item is held if some part of the text is within edit distance (1 - SIMILARITY) x its words, words
    compared in lower case without marks around them, and words of marks only left out. edits is the smallest distance,
    end_word the number of words up to the end of a part with so many edits; of several such parts any may give it. Null
    and empty texts and items hold and match nothing; texts of any length are read whole; repeated rows give repeated
    rows; items that repeat an id count each on its own; an empty table gives an empty result. Each block of
    BLOCK_WORDS words of items is one more pass over the texts.
    """
    parts = [docs.select("doc_id", F.explode(_leaks(F.col("text"), items, docs.sparkSession)).alias("h")).select("doc_id", "h.*") for items in item_blocks(benchmark)]
    if not parts:
        parts = [docs.select("doc_id", F.explode(F.lit(None).cast(LEAK)).alias("h")).select("doc_id", "h.*")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("similarity", F.round(1 - F.col("edits") / F.col("item_words"), 6))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item, in all their columns; nulls and the like as in find_leaks()."""
    out = docs
    for items in item_blocks(benchmark):
        out = out.filter(F.size(_leaks(F.col("text"), items, docs.sparkSession)) == 0)
    return out
