"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Features are sparse: hashed words (damped counts), bins of structure statistics of the text, and metadata
(its length). The score is the logistic of w0 + w.x + 1/2 sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): every pair of
features interacts, at a cost linear in their number.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.held import held
from tramline.llm.labelled import training_rows
from tramline.llm.text import held_out, whole

WORDS, RANK, THRESHOLD, CACHE = 1 << 16, 8, 0.5, 300_000
BINS = 16
STATS = ["upper", "digit", "symbol", "space", "other_end", "word_length", "distinct", "top_word", "adjacent", "repeated_lines", "pipes", "line_words", "sentence_words", "short_words", "chars", "words"]
SIZE = WORDS + BINS * len(STATS)
STRIP = ".,;:!?()\"'*$%&#|"


def _kinds() -> np.ndarray:
    """1 for upper-case letters, 2 digits, 3 other signs, 0 the rest, by code point; code points from 0x3000 on share one entry."""
    chars = map(chr, range(0x3000))
    return np.array([1 if c.isupper() else 2 if c.isdigit() else 0 if c.isalnum() or c.isspace() or c == "_" else 3 for c in chars] + [0], np.int8)


KINDS = _kinds()


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """STATS of a text, each between 0 and 1."""
    n, k = max(1, len(text)), max(1, len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, upper, digits, signs = np.bincount(KINDS[np.minimum(codes, 0x3000)], minlength=4) / n
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    short = lambda x, top: min(1.0, math.log1p(x) / math.log1p(top))
    ends = sum(x.rstrip()[-1:] not in ".!?:" for x in lines) / m
    again = sum(map(eq, words, words[1:])) / k
    sentences = text.count(".") + text.count("!") + text.count("?")
    return [
        upper, digits, min(1.0, 4 * signs), min(1.0, 2 * (k - 1) / n), ends, min(1.0, (n / k) / 25),
        len(counts) / k, max(counts.values(), default=0) / k, again, 1 - len(set(lines)) / m, min(1.0, 10 * text.count("|") / k),
        short(k / m, 500), short(k / (1 + sentences), 200), sum(c for w, c in counts.items() if len(w) <= 3) / k, short(n, 1e6), short(k, 1e5),
    ]


class _Buckets(dict):
    """A word's bucket without marks around it and in lower case; -1 if only marks."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        key = word.strip(STRIP).lower()
        self[word] = b = zlib.crc32(key.encode("utf-8", "surrogatepass")) % WORDS if key else -1
        return b


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; words have a norm of 1 together, statistics 0.5 each."""
    words = text.split()
    counts = Counter(words)
    bags: dict[int, int] = {}
    buckets = held("quality-words", _Buckets)
    for word, n in counts.items():
        if (b := buckets[word]) >= 0:
            bags[b] = bags.get(b, 0) + n
    stats = np.array(statistics(text, words, counts))
    bins = WORDS + BINS * np.arange(len(STATS)) + np.minimum((stats * BINS).astype(int), BINS - 1)
    ids = np.fromiter(bags, np.int64, len(bags))
    values = np.log1p(np.fromiter(bags.values(), float, len(bags)))
    values /= max(1e-9, np.sqrt((values**2).sum()))
    return np.concatenate((ids, bins)), np.concatenate((values, np.full(len(STATS), 0.5)))


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        return float(self.w0 + self.w[ids] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, rate: float = 0.1, decay: float = 1e-5, seed: int = 11, batch: int = 64) -> FactorisationMachine:
    """Adagrad on the logistic loss, classes weighted to the prior."""
    rng = np.random.default_rng(seed)
    p = min(max(float(prior), 1e-3), 1 - 1e-3)
    m = FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    q = y.mean()
    weight = np.where(y == 1, p / q, (1 - p) / (1 - q))
    sq_w, sq_v, sq_0 = np.full(SIZE, 1e-4), np.full((SIZE, RANK), 1e-4), 1e-4
    for _ in range(min(40, max(8, 600 * batch // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            n = np.array([len(rows[d][0]) for d in chosen])
            ids, x = np.concatenate([rows[d][0] for d in chosen]), np.concatenate([rows[d][1] for d in chosen])
            starts, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            v = m.v[ids]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = m.w0 + np.add.reduceat(m.w[ids] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            g = weight[chosen] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[chosen]) / len(chosen)
            sq_0 += g.sum() ** 2
            m.w0 -= rate * g.sum() / np.sqrt(sq_0)
            hit, at = np.unique(ids, return_inverse=True)
            gx = g[owner] * x
            g_w = np.bincount(at, gx, len(hit)) + decay * m.w[hit]
            each = gx[:, None] * (total[owner] - vx)
            g_v = np.stack([np.bincount(at, each[:, f], len(hit)) for f in range(RANK)], 1) + decay * m.v[hit]
            sq_w[hit] += g_w**2
            sq_v[hit] += g_v**2
            m.w[hit] -= rate * g_w / np.sqrt(sq_w[hit])
            m.v[hit] -= rate * g_v / np.sqrt(sq_v[hit])
    return m


def fit(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    rows, prior = training_rows(docs, labels, "quality")
    return train([features(t) for t in rows["text"]], rows["y"].to_numpy(), prior)


def quality_score(text: Column, model: FactorisationMachine, spark) -> Column:
    """Score in 0..1 of whole texts; a null counts as empty."""
    sent = spark.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))  # 2.4 MB

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        fm = FactorisationMachine(*sent.value)
        return pd.Series([1 / (1 + math.exp(-min(max(fm.logit(*features(t)), -40.0), 40.0))) for t in texts], dtype=float)

    return score(whole(text))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Repeated rows score alike; other columns are ignored.

    Null texts count as empty and texts of any length are scored whole; an empty table gives an empty result. Without
    labels, or with those of one class only, every score is the share of label 1 among them, held to 0.001 to 0.999.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
