"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into one embedding table, so a misspelling
that was never seen shares most vectors with the word it stands for. The bags of a span of words are
averaged, and a linear softmax over the average says how toxic the span is; table and softmax are trained
together in numpy. A text's score pools the overlapping spans of its distinct words, so a long text isn't
diluted and a word that is repeated counts once.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.held import held
from tramline.llm.labelled import training_rows
from tramline.llm.text import held_out, whole

BUCKETS, DIM, SPAN = 1 << 17, 8, 24
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+(?:[@$*'!0-9][^\W_]+)*")
CACHE, SLICE = 250_000, 256  # words whose sums are kept; texts that are split into words at a time


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of 3 to 5 characters of <word>, and of the words; for each, its word's position."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters from here to the word's end
    buckets, owners = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)], [np.arange(len(words), dtype=np.int32)]
    hashed = codes + np.uint64(1)
    for n in range(2, 6):
        hashed = hashed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n > 2:
            full = left[: len(hashed)] >= n
            buckets.append((hashed[full] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32))
            owners.append(owner[: len(hashed)][full])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owners)


@dataclass
class ToxicityModel:
    """What scoring needs: each bucket's vector times the softmax weights, and the bias."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def spans(n: int, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of overlapping spans over n words; one of fewer words if there are no more."""
    starts = np.arange(0, max(1, n - span // 2), span // 2)
    return starts, np.minimum(starts + span, n)


def pool(logits: np.ndarray) -> np.ndarray:
    """Weights of the spans: the softmax of their logits."""
    e = np.exp(logits - logits.max())
    return e / e.sum()


def distinct_words(text: str) -> list[str]:
    """Each word once, where it first stands: a word that is repeated says no more than once."""
    return list(dict.fromkeys(WORD.findall(text.lower())))


def calibrate(logits: np.ndarray, y: np.ndarray, prior: float, least: int = 40) -> tuple[float, float]:
    """Slope and shift of the logits for the least logistic loss at the prior; 1 and 0 with few texts of a class."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if min(pos, neg) < least:
        return 1.0, 0.0
    weight, best = np.where(y == 1, prior / pos, (1 - prior) / neg), (math.inf, 1.0, 0.0)
    for slope in np.geomspace(0.5, 8, 25):
        for shift in np.linspace(-6, 6, 61):
            z = (2 * y - 1) * (slope * logits + shift)
            best = min(best, (float(weight @ np.logaddexp(0, -z)), float(slope), float(shift)))
    return best[1:]


class _Batch:
    """Texts as positions into their distinct words, and those words' buckets."""

    def __init__(self, texts: list[list[str]]):
        ids: dict[str, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in words], np.int32) for words in texts]
        self.buckets, self.owner = subwords(list(ids)) if ids else (np.zeros(0, np.int32),) * 2
        self.size = np.bincount(self.owner, minlength=len(ids))


def train(texts: list[str], y: np.ndarray, prior: float, rate: float = 0.3, seed: int = 7, batch: int = 64) -> ToxicityModel:
    """Adagrad on the logistic loss of the pooled span logits; both classes weigh the same.

    Every fifth text is left out, to calibrate the logits on afterwards.
    """
    if len(set(y.tolist())) < 2:
        p = min(max(float(prior), 1e-3), 1 - 1e-3)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, DIM).astype(np.float32), 0.0
    sq_emb, sq_w, sq_b = np.full(BUCKETS, 1e-6, np.float32), np.full(DIM, 1e-6, np.float32), 1e-6
    p = y.mean()
    weight = np.where(y == 1, 0.5 / p, 0.5 / (1 - p))
    order = rng.permutation(len(y))
    apart, order = order[::5], np.delete(order, np.s_[::5])
    batches = [(c, _Batch([distinct_words(texts[d]) for d in c])) for c in (order[k : k + batch] for k in range(0, len(order), batch))]
    for epoch in range(min(40, max(8, 500 // len(batches)))):
        for k in rng.permutation(len(batches)):
            chosen, data = batches[k]
            per_word, g_bias = np.zeros(len(data.size)), 0.0
            score = np.bincount(data.owner, (emb @ w)[data.buckets], len(data.size))
            for d, at in zip(chosen, data.docs, strict=True):
                if not len(at):
                    g_bias += weight[d] * (1 / (1 + np.exp(-bias)) - y[d])
                    continue
                s, n = np.concatenate(([0], np.cumsum(score[at]))), np.concatenate(([0], np.cumsum(data.size[at])))
                a, b = spans(len(at))
                count = n[b] - n[a]
                logit = (s[b] - s[a]) / count
                share = pool(logit) if epoch else np.full(len(a), 1 / len(a))
                g = weight[d] * (1 / (1 + np.exp(-np.clip(share @ logit + bias, -40, 40))) - y[d])
                g_bias += g
                edge = np.zeros(len(at) + 1)
                np.add.at(edge, a, g * share / count)
                np.subtract.at(edge, b, g * share / count)
                per_word[at] += np.cumsum(edge)[:-1]
            g_bias /= len(chosen)
            sq_b += g_bias**2
            bias -= rate * g_bias / np.sqrt(sq_b)
            per_bucket = np.bincount(data.buckets, per_word[data.owner], BUCKETS)
            hit = np.flatnonzero(per_bucket)
            g = per_bucket[hit].astype(np.float32)
            g_w = g @ emb[hit]
            sq_w += g_w**2
            sq_emb[hit] += g**2 * (w @ w) / DIM
            emb[hit] -= rate * g[:, None] * w / np.sqrt(sq_emb[hit])[:, None]
            w = w - 0.2 * rate * g_w / np.sqrt(sq_w)
    model = ToxicityModel((emb @ w).astype(np.float32), float(bias))
    logits = np.array(Scorer(model).logits([texts[d] for d in apart]))
    model.slope, model.shift = calibrate(logits, y[apart], prior)
    return model


class Scorer:
    """Scores whole texts; keeps the sums of words that it has seen."""

    def __init__(self, model: ToxicityModel):
        self.model, self.cache = model, {}

    def __call__(self, texts: list[str]) -> list[float]:
        z = self.model.slope * np.array(self.logits(texts), float) + self.model.shift
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()

    def logits(self, texts: list[str]) -> list[float]:
        lists = [distinct_words(t) for t in texts]
        new = list(set().union(*lists).difference(self.cache))
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(set().union(*lists))
        for k in range(0, len(new), 50_000):
            words = new[k : k + 50_000]
            ids, owner = subwords(words)
            self.cache.update(zip(words, (np.bincount(owner, self.model.weight[ids]) + 1j * np.bincount(owner)).tolist(), strict=True))
        return [self._one(words) for words in lists]

    def _one(self, words: list[str]) -> float:
        logit = self.model.bias
        if words:
            sums = np.concatenate(([0], np.cumsum(np.fromiter(map(self.cache.__getitem__, words), np.complex128, len(words)))))
            a, b = spans(len(words))
            sums = sums[b] - sums[a]
            each = sums.real / sums.imag
            logit += float(pool(each) @ each)
        return logit


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows, prior = training_rows(docs, labels, "toxic")
    return train(rows["text"].tolist(), rows["y"].to_numpy(), prior)


class _Sent:
    """A broadcast model with a name that workers know it by."""

    def __init__(self, value):
        self.broadcast, self.id = value, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """Score in 0..1 of whole texts; a null counts as empty, and a text without words has the prior's score."""
    sent = _Sent(spark.sparkContext.broadcast((model.weight, model.bias, model.slope, model.shift)))  # half a megabyte

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        score_all = held(f"toxicity-{sent.id}", lambda: Scorer(ToxicityModel(*sent.value)))
        return pd.Series([s for k in range(0, len(texts), SLICE) for s in score_all(texts.iloc[k : k + SLICE].tolist())], dtype=float)

    return score(whole(text))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Repeated rows score alike; other columns are ignored.

    Null texts count as empty and texts of any length are scored whole; an empty table gives an empty result. Without
    labels, or with those of one class only, every score is the share of label 1 among them, held to 0.001 to 0.999.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """`docs` without the rows whose score reaches THRESHOLD, in all its columns.

    The model learns from the texts of `labelled` (columns doc_id and text), or of `docs`. Nulls, long texts and missing
    labels as in score_toxicity(): without labels the share of label 1 decides over all rows alike. Repeated rows stay
    or go together.
    """
    model = fit(docs if labelled is None else labelled, labels)
    return docs.filter(toxicity_score(F.col("text"), model, docs.sparkSession) < THRESHOLD)
