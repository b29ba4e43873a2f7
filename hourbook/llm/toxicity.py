"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (on UTF-8 bytes, with marks at both
ends), hashed to rows of an embedding table; its vector is their average.  A text
is an average of the vectors of all its words, and a linear softmax over two
classes scores that average.  The words' weights in it follow their own scores,
exp(SHARPNESS * score): an even average would drown one remark in a long text, and
with these weights the words that speak for toxicity make up most of it,
while words that score alike, as those of a clean text do, weigh alike.  The table
and the softmax are trained jointly in numpy; a misspelt or unseen form of a word
shares most n-gram vectors with the forms that were seen.

Labels are of documents.  Training therefore pulls the average of a toxic
document up, and the average and all single words of clean documents down.  The loss
of a toxic document is the generalised cross-entropy (1 - p^TRUST) / TRUST,
which gives up on documents that share no sign with others, as wrongly labelled
ones do.  Training starts from the n-grams' smoothed log odds.  It uses at most ``ROWS_PER_CLASS`` labelled rows of each class, none over ``MAX_BYTES``
long (windows of longer ones if a class has no others), chosen by a hash of the id
among those that the documents hold; scoring covers whole texts of any length.

Defined results: an empty or null text scores as the softmax's bias alone;
equal texts score alike; with no labelled rows of both classes all texts
score 0; extra columns are kept by ``keep_clean``; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import labelled_sample
from hourbook.llm.encoding import slices

ROWS_PER_CLASS = 1500
MAX_BYTES = 8192
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIM = 8
#: Chosen on folds of rows that may teach (0.7 to 2 differ by a point of recall).
SHARPNESS = 1.0
STEPS = 100
RATE = 0.02
TRUST = 0.6
DROPOUT = 0.3
SEED = 5
THRESHOLD = 0.5
DOCS_AT_ONCE, BYTES_AT_ONCE = 1000, 1 << 20


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each word), word by word."""
    framed = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    sizes = np.array([len(f) for f in framed], np.int64)
    raw = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32) + 1
    end = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(raw))
    word = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, max(SIZES) + 1):
        shifted = np.zeros_like(code)
        shifted[: max(0, len(raw) - n + 1)] = raw[n - 1 :]
        code = code * np.uint32(0x01000193) + shifted
        if n in SIZES:
            mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            ok = place + n <= end
            buckets.append((mixed ^ (mixed >> np.uint32(15)))[ok] % np.uint32(BUCKETS))
            owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word number of each word, words per text, distinct words)."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    numbers, distinct = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    return numbers, counts, list(distinct)


def _segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _averages(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(average score, by weight, of each text that has words; each word's weight)."""
    counts = counts[counts > 0]
    starts, text = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    weight = np.exp(SHARPNESS * (scores - np.maximum.reduceat(scores, starts)[text]))
    weight /= np.add.reduceat(weight, starts)[text]
    return np.add.reduceat(weight * scores, starts), weight


@dataclass(frozen=True)
class Model:
    """``weights``: the embedding table times the softmax's class difference;
    None if nothing could be learned."""

    weights: np.ndarray | None
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        numbers, counts, distinct = _bags([t or "" for t in texts])
        average = np.zeros(len(texts))
        if distinct:
            buckets, sizes = grams(distinct)
            logits = _segment_sums(self.weights[buckets], sizes) / np.maximum(sizes, 1)
            average[counts > 0] = _averages(logits[numbers], counts)[0]
        return 1 / (1 + np.exp(-np.clip(average + self.bias, -500, 500)))


def _log_odds(buckets: np.ndarray, owner: np.ndarray, numbers: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Where training starts: how much likelier a toxic text holds an n-gram
    than a clean one, smoothed, as a logarithm.  An n-gram counts once for
    each text and distinct word."""
    text = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(text.astype(np.int64) * (int(numbers.max()) + 1) + numbers)
    word, bad = pairs % (int(numbers.max()) + 1), toxic[pairs // (int(numbers.max()) + 1)]
    in_toxic, in_clean = (np.bincount(word[x], minlength=owner[-1] + 1) for x in (bad, ~bad))
    a, b = (np.bincount(buckets, x[owner], BUCKETS) for x in (in_toxic, in_clean))
    ratio = max(1, toxic.sum()) / max(1, (~toxic).sum())
    return np.log((a + 1) / (b * ratio + 1)).astype(np.float32)


def train(sample: list[tuple[str, int]], steps: int = STEPS, seed: int = SEED) -> Model:
    toxic = np.array([label for _, label in sample], bool)
    if not toxic.any() or toxic.all():
        return Model(None, 0.0)
    rng = np.random.default_rng(seed)
    numbers, counts, distinct = _bags([t for t, _ in sample])
    if not distinct:
        return Model(None, 0.0)
    buckets, sizes = grams(distinct)
    owner = np.repeat(np.arange(len(distinct)), sizes)
    softmax = (np.outer(np.ones(DIM), [-0.5, 0.5]) + rng.normal(0, 0.05, (DIM, 2))).astype(np.float32)
    across = softmax[:, 1] - softmax[:, 0]
    odds = _log_odds(buckets, owner, numbers, counts, toxic)
    table = (odds[:, None] * (across / (across @ across)) + rng.normal(0, 0.02, (BUCKETS, DIM))).astype(np.float32)
    params = [table, softmax, np.array([1.0, -1.0], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    held = counts > 0
    spans, toxic_text = counts[held], toxic[held]
    of_text = np.repeat(np.arange(held.sum()), spans)
    clean_word = ~toxic_text[of_text]
    weight = np.where(toxic_text, 0.5 / max(1, toxic_text.sum()), 0.5 / max(1, (~toxic_text).sum()))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        v = params[1][:, 1] - params[1][:, 0]
        kept = rng.random(len(buckets), dtype=np.float32) >= DROPOUT
        n = np.maximum(np.bincount(owner, kept, len(distinct)), 1)
        logits = np.bincount(owner, (params[0] @ v)[buckets] * kept, len(distinct)) / n
        z = logits[numbers] + (params[2][1] - params[2][0])
        average, part = _averages(z, counts)
        p = sigmoid(average)
        daverage = weight * np.where(toxic_text, -(p**TRUST) * (1 - p), p)
        dz = np.where(clean_word, sigmoid(z) * (weight / spans)[of_text], 0.0)
        dz += daverage[of_text] * part * (1 + SHARPNESS * (z - average[of_text]))
        dword = np.bincount(numbers, dz, len(distinct))
        dgram = np.bincount(buckets, (dword / n)[owner] * kept, BUCKETS).astype(np.float32)
        dv, db = dgram @ params[0], float(dz.sum())
        grads = [dgram[:, None] * v, np.stack([-dv, dv], 1), np.array([-db, db], np.float32)]
        for p, g, (m, s) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    seen = np.bincount(buckets, minlength=BUCKETS) > 0
    weights = np.where(seen, params[0] @ (params[1][:, 1] - params[1][:, 0]), 0).astype(np.float32)
    return Model(weights, float(params[2][1] - params[2][0]))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from ``labels`` (id, toxic), all of which may be used."""
    return train(labelled_sample(docs, labels, "toxic", rows_per_class, MAX_BYTES, id_col, text_col))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [model.score(part.column(0).to_pylist()) for part in slices(batch, 0, DOCS_AT_ONCE, BYTES_AT_ONCE)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return score(text)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.filter(score_column(model, F.col(text_col)) < threshold)
