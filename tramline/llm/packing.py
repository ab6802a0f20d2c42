"""Hierarchical packing of token sequences at several context sizes.

Documents are routed to the smallest tier that holds them. Each tier's windows are filled from its own documents,
longest first; what a document leaves of a window is filled with the largest pieces that fit from shorter
tiers, and the last gap by cutting a document there. So every window is exactly full; what a task has left at its
end goes to windows of smaller powers of two, which need no padding either. Windows of one size make up step groups of
equal tokens; the groups that a task has begun for each size are dealt anew at its end, so all but one of its groups are
full. Nothing is shuffled.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.held import held
from tramline.llm.text import whole

TIERS, EOS, STEP_TOKENS = (512, 1024, 2048, 4096), 2, 32768
CACHE = 350_000
#: White space to str.split() but not to the tokenizer, letters whose lower case depends on what follows or is
#: longer, and the head of special tokens: words of texts with these are looked up as they stand.
ODD_SPACE, ODD = ("\x1c", "\x1d", "\x1e", "\x1f"), ("\u03a3", "\u0130", "<|")
#: Marks between letters, digits or white space make a token run of their own.
MARKS = re.compile(r"""[.,;:!?*$%&#()"|-](?<![^\w\s].)(?<!_.)[.,;:!?*$%&#()"|-]*(?![^\w\s]|_)""")
ID_BITS = 33  # sequence_id: the task's partition, then a counter of so many bits


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words_of(text: str) -> list[str] | None:
    """Pieces of a text that are encoded apart with the same ids as in it; None if it has to be encoded whole."""
    if any(c in text for c in ODD_SPACE):
        return None
    low = text.lower()
    if any(c in text for c in ODD) or not (is_normalized("NFC", text) and is_normalized("NFC", low)):
        return text.split()
    return MARKS.sub(r" \g<0> ", low).split()


class Encoder:
    """Ids of whole texts. No token spans white space, so words are encoded once and looked up afterwards.

    Words are kept in two generations of at most CACHE each; the older one goes when the newer is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.older = Tokenizer.from_file(path), {}, {}

    def _look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, words))
        if None in found:
            places = [i for i, ids in enumerate(found) if ids is None]
            missing = {words[i] for i in places}
            known = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
            new = list(missing.difference(known)) if known else list(missing)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
            for i in places:
                found[i] = known[words[i]]
            if len(self.cache) + len(known) > CACHE:
                self.cache, self.older = known, self.cache
            else:
                self.cache.update(known)
        return found

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        lists = [words_of(text) for text in texts]
        found, at = self._look_up(list(chain.from_iterable(words or () for words in lists))), 0
        end = np.uint32(EOS).tobytes()
        for text, words in zip(texts, lists, strict=True):
            if words is None:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, EOS], "<u4")
            else:
                yield np.frombuffer(b"".join([*found[at : at + len(words)], end]), "<u4")
                at += len(words)


def encoder(path: str) -> Encoder:
    return held(f"tokens-{path}", lambda: Encoder(path))


class Packer:
    """Windows of one task. Pieces are (length, number, doc_id, start, ids, tokens of the document)."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next, self.pending, self.total, self.seen = sorted(tiers), first_id, [], 0, 0
        self.open: dict[int, list[list[tuple]]] = {}  # windows of the group that each size has begun
        self.groups = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Takes a document; yields what its full windows of the longest context make."""
        top, n, at = self.tiers[-1], len(ids), 0
        while n - at >= top:
            yield from self._window(top, [(doc_id, at, ids[at : at + top], n)])
            at += top
        self._put(doc_id, at, ids[at:], n)

    def _put(self, doc_id, start: int, ids: np.ndarray, tokens: int) -> None:
        if len(ids):
            bisect.insort(self.pending, (len(ids), self.seen, doc_id, start, ids, tokens), key=lambda p: p[:2])
            self.seen, self.total = self.seen + 1, self.total + len(ids)

    def _take(self, at: int) -> tuple:
        piece = self.pending.pop(at)
        self.total -= piece[0]
        return piece

    def _at(self, longest: int) -> int:
        """Position after the pieces of at most `longest` tokens."""
        return bisect.bisect_right(self.pending, longest, key=lambda p: p[0])

    def fill(self, size: int) -> Iterator[tuple]:
        """One window of `size` tokens from what is pending, which must be as much at least."""
        gap, parts = size, []
        while gap:
            at = self._at(gap)
            n, _, doc_id, start, ids, tokens = self._take(at - 1 if at else 0)
            if n > gap:
                self._put(doc_id, start + gap, ids[gap:], tokens)
                ids, n = ids[:gap], gap
            parts.append((doc_id, start, ids, tokens))
            gap -= n
        return self._window(size, parts)

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Windows of each tier while its documents last, then, at the end, of smaller powers of two, and all open groups."""
        for size, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while self.total >= size and self.pending[-1][0] > below:
                yield from self.fill(size)
        while last and self.total:
            yield from self.fill(min(self.tiers[-1], 1 << (self.total.bit_length() - 1)))
        if last:
            used = STEP_TOKENS  # powers of two in falling order fill groups without a gap
            for size in sorted(self.open, reverse=True):
                for window in self.open.pop(size):
                    if used == STEP_TOKENS:
                        used, self.groups = 0, self.groups + 1
                    used += size
                    yield from ((*row, self.groups - 1) for row in window)

    def _window(self, size: int, parts: list[tuple]) -> Iterator[tuple]:
        """Takes a window; yields the rows of the step group that it fills, if it does."""
        offset, window = 0, []
        for doc_id, start, ids, tokens in parts:
            window.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, offset, size))
            offset += len(ids)
        self.next += 1
        waiting = self.open.setdefault(size, [])
        waiting.append(window)
        if len(waiting) * size >= STEP_TOKENS:
            del self.open[size]
            self.groups += 1
            yield from ((*row, self.groups - 1) for w in waiting for row in w)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long"
_FIELDS = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group.

    Every document is its tokens and an end token; a null or empty text is that token alone. Each token lies
    in one piece. context is the window's size, a power of two; windows are full. step_group has STEP_TOKENS tokens of
    one size, but for a task's last ones, which mix sizes and of which the last may be smaller. Rows that repeat an id
    are packed as documents of their own; equally long pieces go in the order they came. A document of any length is
    cut into full windows as it comes; an empty table gives an empty result; other columns are ignored. Windows and ids
    follow the partitions of `docs`, so write the result once and read that. `tiers` must be powers of two of at most
    STEP_TOKENS.
    """
    if any(t < 1 or t & (t - 1) or t > STEP_TOKENS for t in tiers):
        raise ValueError("tiers must be powers of two of at most STEP_TOKENS")
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << ID_BITS
        packer, encode, rows = Packer(first, tiers), encoder(path), []

        def full(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) > least:
                columns = list(zip(*rows, strict=True))
                columns[8] = [first + g for g in columns[8]]
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), 256):
                texts = batch.column(1).slice(k, 256).to_pylist()
                for doc_id, tokens in zip(ids[k : k + 256], encode(texts), strict=True):
                    rows.extend(packer.add(doc_id, tokens))
                rows.extend(packer.flush())
                yield from full(5000)
        rows.extend(packer.flush(last=True))
        yield from full(0)

    return docs.select(F.col("doc_id").cast("long"), whole(F.col("text")).alias("text")).mapInArrow(pack, SCHEMA)
