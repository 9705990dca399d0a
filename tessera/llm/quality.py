"""Quality classifier: random-indexing vectors, a two-layer network, calibrated probabilities.

Every word and every word shape (letters, capitals, digits and marks in runs)
has a sparse random index vector.  A word's vector is its index vector plus the
sum of its neighbours' over the fitting texts (random indexing), scaled to unit
length.  A document is the mean of its word vectors beside the means of its
shape vectors and of three counts (repeated neighbours, words outside the
vocabulary, length).  A network with one hidden layer is trained in numpy on
the pooled vectors, and its logit is divided by a temperature fitted on texts
that the network has not seen.

The fitting texts are a bounded sample of labelled rows (``FIT_ROWS``,
``FIT_BYTES``), read and fitted in one task of an executor; the driver holds
the weights only.  Every document is scored over its whole text.

Defined results: null and empty texts pool to zeros and get the score of that;
with no labelled rows, or labels of one kind only, every score is the share of
label 1 (0.5 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Model, fitted, labelled_sample, pieces, raw_texts, scored, sigmoid

FIT_ROWS = 8_000
FIT_BYTES = 32_000_000
DIMENSIONS = 48
NONZERO = 6
HIDDEN = 32
MAX_WORDS = 60_000
BUCKETS, HELD_OUT, THRESHOLD = 4, 2, 0.7

_KIND = bytes(97 if c > 127 or chr(c).islower() else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def index_vector(mark: int) -> np.ndarray:
    """A few random entries of +1 and -1, fixed by a word's checksum."""
    draw = np.random.default_rng(mark)
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    out[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return out


def shape(kinds: bytes) -> bytes:
    """A word of character kinds with every run of two or more written as two."""
    return _RUN.sub(rb"\1\1", kinds)


class Pooler:
    """Word vectors and the pooled vector of a text."""

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = {}
        for t in texts:
            for w in set(t.lower().split()):
                seen[w] = seen.get(w, 0) + 1
        frequent = sorted((-n, w) for w, n in seen.items() if n > 1)[:MAX_WORDS]
        self.words = {w: k for k, (_, w) in enumerate(frequent)}
        index = np.array([index_vector(zlib.crc32(w)) for w in self.words]).reshape(-1, DIMENSIONS)
        total = index * 4.0
        for t in texts:
            at = np.array([k for k in map(self.words.get, t.lower().split()) if k is not None], dtype=np.int64)
            for gap in (1, 2):
                np.add.at(total, at[gap:], index[at[:-gap]])
                np.add.at(total, at[:-gap], index[at[gap:]])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        self.vectors = np.vstack([total / np.maximum(norm, 1e-9), np.zeros((1, DIMENSIONS))]).astype(np.float32)
        self.shapes: dict[int, int] = {}
        self.memo: dict[bytes, int] = {}
        self.shape_vectors = np.zeros((0, DIMENSIONS), dtype=np.float32)

    def _shape(self, kinds: bytes) -> int:
        got = self.memo.get(kinds)
        if got is None:
            mark = zlib.crc32(b"\0" + shape(kinds))
            got = self.shapes.get(mark)
            if got is None:
                if len(self.shapes) >= 50_000:
                    self.shapes.clear()
                    self.memo.clear()
                got = self.shapes[mark] = len(self.shapes)
                if got == len(self.shape_vectors):
                    self.shape_vectors = np.vstack([self.shape_vectors, np.zeros((max(got, 256), DIMENSIONS), dtype=np.float32)])
                self.shape_vectors[got] = index_vector(mark)
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(kinds) < 64:
                self.memo[kinds] = got
        return got

    def pooled(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        out = np.zeros(2 * DIMENSIONS + 3, dtype=np.float32)
        if not words:
            return out
        n, none = len(words), len(self.words)
        get = self.words.get
        at = np.fromiter([get(w, none) for w in words], dtype=np.int64, count=n)
        counts = np.bincount(at, minlength=none + 1) if n > 4096 else None
        out[:DIMENSIONS] = (counts @ self.vectors if counts is not None else self.vectors[at].sum(axis=0)) / n
        kinds: dict[bytes, int] = {}
        for k in text.translate(_KIND).split():
            kinds[k] = kinds.get(k, 0) + 1
        for k, c in kinds.items():
            i = self._shape(k)
            out[DIMENSIONS : 2 * DIMENSIONS] += self.shape_vectors[i] * (c / n)
        out[2 * DIMENSIONS :] = sum(map(eq, words, words[1:])) / n, np.mean(at == none), np.log1p(n) / 10
        return out

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.pooled(t) for t in texts], dtype=np.float32).reshape(-1, 2 * DIMENSIONS + 3)


class Classifier:
    """A pooler and the network's weights; without weights a constant score."""

    def __init__(self, raw: list[bytes], y: np.ndarray, epochs: int = 60, rate: float = 0.01, seed: int = 5):
        self.share = float(y.mean()) if len(y) else 0.5
        self.layers = None
        if len(set(y.tolist())) < 2:
            return
        self.pooler = Pooler(raw)
        x = self.pooler.matrix(raw)
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(y))
        late = order[: len(y) // 5]
        early = order[len(y) // 5 :] if len(set(y[order[len(y) // 5 :]].tolist())) > 1 else order
        self.mean, self.scale = x[early].mean(axis=0), x[early].std(axis=0) + 0.02
        x = (x - self.mean) / self.scale
        weight = np.where(y == 1, 0.5 / max(self.share, 1e-6), 0.5 / max(1 - self.share, 1e-6))
        layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
        step = 0
        for _ in range(epochs):
            draw.shuffle(early)
            for at in np.array_split(early, max(1, len(early) // 128)):
                hidden = np.tanh(x[at] @ layers[0] + layers[1])
                off = (sigmoid(hidden @ layers[2] + layers[3]) - y[at]) * weight[at] / len(at)
                down = off[:, None] * layers[2] * (1 - hidden**2)
                step += 1
                for w, g, m, v in zip(layers, (x[at].T @ down + 1e-4 * layers[0], down.sum(axis=0), hidden.T @ off + 1e-4 * layers[2], off.sum(keepdims=True)), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.layers = layers
        self.temperature = 1.0
        if len(late) > 20:
            logit = self._logit(x[late])
            grid = np.geomspace(0.5, 8, 61)
            loss = [np.mean(np.logaddexp(0, logit / t) - y[late] * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, raw: list[bytes]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(raw), self.share)
        # Rounded, as the last bits of a product depend on how many texts are scored together.
        return np.round(sigmoid(self._logit((self.pooler.matrix(raw) - self.mean) / self.scale) / self.temperature), 9)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> Model:
    """The classifier, fitted in one task on the bounded sample."""
    return fitted(labelled_sample(docs, labels, column, BUCKETS, HELD_OUT, max_rows, max_bytes), Classifier)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least 0.7) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: held.value.get().score, BUCKETS, HELD_OUT, THRESHOLD)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            keep = held.value.get().score(raw_texts(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
