"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes, each overlapping the
one before by ``CHUNK - STRIDE``, so that the whole text is covered.  In a chunk,
learned filters run over learned byte embeddings; what each filter finds is
max-pooled and averaged over the chunk.  Beside the filters, ``LAGS`` channels
hold how often a byte equals the one k places before it, in the chunk and in the
quarter where it does most (filters on raw bytes can't see that an unknown word
repeats).  A small dense layer turns these into
the chunk's logit of being bad; the maximum over all chunks is the text's, and
one sigmoid turns it into one probability of good quality.

Trained on at most ``ROWS_PER_CLASS`` labelled rows of each class, none over
``MAX_BYTES`` bytes (windows of longer ones if a class has no others), chosen by a
hash of the id among those that the documents hold.  Labels are of documents: a bad
document's worst chunk is pulled up, all chunks of a good one down.  Scoring
covers whole texts of any length.

Defined results: an empty or null text is one chunk without bytes and gets the
network's score for it; equal texts score alike; with no labelled rows of both
classes all texts score 1; extra columns are kept by ``keep_good``; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourbook.llm.common import labelled_sample

ROWS_PER_CLASS = 1000
MAX_BYTES = 16_384
CHUNK = 256
STRIDE = 192
DIM = 8
WIDTH = 8
HOP = 4
FILTERS = 16
LAGS = 32
HIDDEN = 16
STEPS = 500
DOCS_A_STEP = 32
RATE = 0.005
SEED = 7
THRESHOLD = 0.7
CHUNKS_AT_ONCE = 1024

Params = dict[str, np.ndarray]


def chunk_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes padded with 0, bytes in each, chunks per text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    raw = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(starts, counts) + nth * STRIDE
    held = np.clip(np.repeat(sizes, counts) - nth * STRIDE, 0, CHUNK)
    chunks = raw[first[:, None] + np.arange(CHUNK)]
    short = np.flatnonzero(held < CHUNK)
    chunks[short] *= np.arange(CHUNK) < held[short, None]
    return chunks, held, counts


def _lags(chunks: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Share of bytes that equal the byte k places before, k = 1..LAGS: over
    the chunk, and the largest over its quarters."""
    n = len(chunks)
    out = np.empty((n, 2 * LAGS), np.float32)
    size = np.maximum(held, LAGS).astype(np.float32)
    short = np.flatnonzero(held < CHUNK)
    inside = np.arange(CHUNK) < held[short, None]
    same = np.zeros((n, CHUNK), bool)
    for k in range(1, LAGS + 1):
        same[:, :k] = False
        np.equal(chunks[:, k:], chunks[:, :-k], out=same[:, k:])
        same[short] &= inside
        # Eight flags at a time: bytes of 0 and 1 added up as 64-bit words.
        eights = same.view(np.uint64).reshape(n, 4, CHUNK // 32).sum(2)
        quarters = (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)
        out[:, k - 1] = quarters.sum(1) / size
        out[:, LAGS + k - 1] = quarters.max(1) / np.float32(CHUNK // 4)
    return out


def _places(held: np.ndarray) -> np.ndarray:
    """1 for filter places that begin inside the text, chunks x places."""
    return (np.arange(0, CHUNK - WIDTH + 1, HOP) < np.maximum(held, 1)[:, None]).astype(np.float32)


def forward(p: Params, chunks: np.ndarray, held: np.ndarray, keep: bool = False):
    """Logit of being bad of each chunk; with ``keep`` what backward needs."""
    seen = p["bytes"][chunks]
    n, hops = len(chunks), (CHUNK - WIDTH) // HOP + 1
    s = seen.strides
    windows = np.lib.stride_tricks.as_strided(seen, (n, hops, WIDTH * DIM), (s[0], s[1] * HOP, s[2]))
    flat = np.ascontiguousarray(windows).reshape(n * hops, WIDTH * DIM)
    found = flat @ p["filters"]
    found += p["filter_bias"]
    np.maximum(found, 0, out=found)
    found = found.reshape(n, hops, FILTERS)
    some, all_ = held < CHUNK, None
    if some.any():
        all_ = _places(held)
        found[some] *= all_[some][:, :, None]
        total = np.maximum(all_.sum(1), 1)[:, None]
    else:
        total = np.float32(hops)
    top = found.max(1)
    features = np.concatenate([top, found.sum(1) / total, _lags(chunks, held)], 1)
    hidden = np.maximum(features @ p["dense"] + p["dense_bias"], 0)
    logit = hidden @ p["out"] + p["out_bias"][0]
    return (logit, (flat, found, top, total, features, hidden)) if keep else logit


def backward(p: Params, chunks: np.ndarray, kept, dlogit: np.ndarray) -> Params:
    flat, found, top, total, features, hidden = kept
    n, hops, _ = found.shape
    g = {"out": hidden.T @ dlogit, "out_bias": np.array([dlogit.sum()], np.float32)}
    dhidden = np.outer(dlogit, p["out"]) * (hidden > 0)
    g["dense"], g["dense_bias"] = features.T @ dhidden, dhidden.sum(0)
    dfeatures = dhidden @ p["dense"].T
    dfound = np.repeat((dfeatures[:, FILTERS : 2 * FILTERS] / total)[:, None, :], hops, 1)
    at = found.argmax(1)
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    dfound[rows, at, cols] += dfeatures[:, :FILTERS]
    dfound *= found > 0
    dflat_in = dfound.reshape(n * hops, FILTERS)
    g["filters"], g["filter_bias"] = flat.T @ dflat_in, dflat_in.sum(0)
    dwindows = (dflat_in @ p["filters"].T).reshape(n, hops, WIDTH, DIM)
    dbytes = np.zeros((256, DIM), np.float32)
    for j in range(WIDTH):
        own = chunks[:, j : j + HOP * (hops - 1) + 1 : HOP].ravel()
        part = dwindows[:, :, j, :].reshape(-1, DIM)
        for d in range(DIM):
            dbytes[:, d] += np.bincount(own, part[:, d], 256)
    g["bytes"] = dbytes
    return g


@dataclass(frozen=True)
class Model:
    params: Params | None

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of good quality."""
        if self.params is None:
            return np.ones(len(texts))
        if not texts:
            return np.zeros(0)
        worst, texts = np.full(len(texts), -np.inf), [t or b"" for t in texts]
        # Long texts are cut at chunk borders, so that memory has a bound.
        unit = STRIDE * CHUNKS_AT_ONCE
        group, owners, size = [], [], 0

        def flush() -> None:
            if group:
                chunks, held, counts = chunk_bytes(group)
                z = np.concatenate(
                    [forward(self.params, chunks[i : i + CHUNKS_AT_ONCE], held[i : i + CHUNKS_AT_ONCE]) for i in range(0, len(chunks), CHUNKS_AT_ONCE)]
                )
                np.maximum.at(worst, owners, np.maximum.reduceat(z, np.cumsum(counts) - counts))
                group.clear()
                owners.clear()

        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - (CHUNK - STRIDE)), unit):
                part = text[at : at + unit + CHUNK - STRIDE]
                group.append(part)
                owners.append(i)
                size += len(part)
                if size > 4 * unit:
                    flush()
                    size = 0
        flush()
        return 1 / (1 + np.exp(np.clip(worst.astype(np.float64), -500, 500)))


def train(sample: list[tuple[str, int]], steps: int = STEPS, seed: int = SEED) -> Model:
    """sample: (text, 1 for good quality)."""
    texts = [t.encode("utf-8", "replace") for t, _ in sample]
    bad = np.array([label == 0 for _, label in sample], bool)
    if not bad.any() or bad.all():
        return Model(None)
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    p = {
        "bytes": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "filters": normal(WIDTH * DIM, FILTERS), "filter_bias": zeros(FILTERS),
        "dense": normal(2 * FILTERS + 2 * LAGS, HIDDEN), "dense_bias": zeros(HIDDEN), "out": normal(HIDDEN), "out_bias": zeros(1),
    }
    p["out"] = p["out"].reshape(-1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    chunks, held, counts = chunk_bytes(texts)
    begin = np.cumsum(counts) - counts
    of = (np.flatnonzero(bad), np.flatnonzero(~bad))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    half = DOCS_A_STEP // 2
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(x, half, replace=len(x) < half) for x in of])
        at = np.concatenate([np.arange(begin[d], begin[d] + counts[d]) for d in docs])
        logit, kept = forward(p, chunks[at], held[at], keep=True)
        dlogit, place = np.zeros(len(at), np.float32), 0
        for d in docs:
            n = counts[d]
            z = logit[place : place + n]
            worst = int(z.argmax())
            if bad[d]:
                dlogit[place + worst] = (sigmoid(z[worst]) - 1) / half
            else:
                dlogit[place : place + n] = 0.5 * sigmoid(z) / n / half
                dlogit[place + worst] += sigmoid(z[worst]) / half
            place += n
        for k, g in backward(p, chunks[at], kept, dlogit).items():
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(p)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from ``labels`` (id, quality), all of which may be used."""
    return train(labelled_sample(docs, labels, "quality", rows_per_class, MAX_BYTES, id_col, text_col))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(texts.slice(i, 1000).to_pylist()) for i in range(0, len(texts), 1000)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return score(text.cast("binary"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    return docs.filter(score_column(model, F.col(text_col)) >= threshold)
