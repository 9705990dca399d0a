"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of toxic text and one on
windows of ordinary text.  A window is one word between spaces, after a fixed
lead-in that both dictionaries hold, so the compressor never falls back to a
raw block.  A window's distance is its compressed length with the ordinary
dictionary less that with the toxic one: a word that toxic text repeats costs a
few bytes fewer with the toxic dictionary, ordinary words cost more.  Windows of
several words don't do: what their ordinary words differ by in the two
dictionaries hides the few bytes of the word that matters (the README has the
figures).  Distances are kept in a bounded memo, as most words of a corpus come
again and again.

Only windows that mark toxic text train the toxic dictionary: a stem (the first
four or five bytes of a word) marks it if it stands after many different words
in toxic texts and hardly in others, by a likelihood-ratio test.  Counting the
different words before it, not occurrences, keeps copies of one text from
making its words look like marks.

Thresholds are distances that a given share of the ordinary windows of texts
apart from those in the dictionaries stays under.  A document's score is a
logistic function of how many of its different windows reach each threshold and
of the largest distance, calibrated on the same texts; every window counts.  The
fitting texts are a bounded sample of labelled rows (``FIT_ROWS``,
``FIT_BYTES``), read and fitted in one task of an executor; every document is
scored over its whole text.

Defined results: null and empty texts have no windows and get the score of
that; with labels of one kind only, or no marks, every score is the share of
label 1 (0 without labels); bytes of a word beyond ``WINDOW`` form further
windows, so no text is left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import Model, TwoGenerationCache, fitted, labelled_sample, scored, sigmoid

FIT_ROWS = 8_000
FIT_BYTES = 32_000_000
BUCKETS, HELD_OUT, THRESHOLD = 5, 0, 0.5
WINDOW = 64
ORDINARY_DICTIONARY = 65_536
#: Size and segment length of the toxic dictionary; segment length of the ordinary one.
TOXIC_DICTIONARY, TOXIC_SEGMENT = 4_096, 32
ORDINARY_SEGMENT = 64
ORDINARY_WINDOWS = 80_000
LEVEL = 19
#: Shares of ordinary windows that stay under the thresholds.
UNDER = (0.99, 0.999, 0.9999)
#: Distance of a text without windows, and the least that counts as largest.
LEAST = -24
MARK_TEST, MARK_SHARE = 15.0, 0.9
MEMO_WINDOWS = 300_000
LEAD_IN = b" qzjxkvwpbyfgmuc" * 3


def windows(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, long ones cut."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= WINDOW:
        return words
    return [w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]


def marks(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Stems that mark toxic text."""
    before: list[dict[bytes, set[int]]] = [{}, {}]
    for kind, texts in enumerate((ordinary, toxic)):
        found = before[kind]
        for t in texts:
            last = b""
            for w in t.lower().split():
                h = zlib.crc32(w[:4], zlib.crc32(last))
                for n in (4, 5):
                    found.setdefault(w[:n], set()).add(h)
                last = w
    totals = [sum(map(len, b.values())) for b in before]
    share = totals[1] / max(1, sum(totals))
    if not 0 < share < 1:
        return set()
    out = set()
    for stem, seen in before[1].items():
        a, b = len(seen), len(before[0].get(stem, ()))
        test = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if a / (a + b) > MARK_SHARE and test > MARK_TEST:
            out.add(stem)
    return out


def dictionary(words: list[bytes], size: int, segment: int) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on windows, eight to a sample; raw content where there are too few to train on."""
    samples = [LEAD_IN + b"".join(b" " + w + b" " for w in words[i : i + 8]) for i in range(0, len(words), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict((b"".join(samples) + LEAD_IN)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Distance:
    """Window distances; the dictionaries travel as bytes and compressors are made where they are used."""

    def __init__(self, toxic: zstandard.ZstdCompressionDict, ordinary: zstandard.ZstdCompressionDict):
        self.parts = [(d.as_bytes(), d.dict_id() == 0) for d in (toxic, ordinary)]
        self.ready = None

    def __getstate__(self):
        return {"parts": self.parts, "ready": None}

    def _prepare(self):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

        def compressor(part):
            data, raw = part
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress

        self.ready = [compressor(p) for p in self.parts]
        self.memo = TwoGenerationCache(MEMO_WINDOWS)

    def of(self, window: bytes) -> int:
        if self.ready is None:
            self._prepare()
        got = self.memo.get(window)
        if got is None:
            framed = LEAD_IN + b" " + window + b" "
            toxic, ordinary = self.ready
            got = len(ordinary(framed)) - len(toxic(framed))
            self.memo.put(window, got)
        return got

    def all(self, text: bytes) -> np.ndarray:
        """Distances of a text's different windows."""
        return np.array([self.of(w) for w in set(windows(text))] or [LEAST])


class Classifier:
    """Dictionaries, thresholds, and the calibrated logistic function of a document's distances."""

    def __init__(self, raw: list[bytes], y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.0
        self.distance = None
        if len(set(y.tolist())) < 2:
            return
        apart = np.arange(len(y)) % 4 == 0
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart[:] = False
        distance = self._train([r for r, a in zip(raw, apart, strict=True) if not a], y[~apart])
        if distance is None:
            return
        calibrate = apart if apart.any() else ~apart
        held, known = [r for r, a in zip(raw, calibrate, strict=True) if a], y[calibrate]
        plain = sorted({w for r, q in zip(held, known, strict=True) if q != 1 for w in windows(r)})
        self.thresholds = np.floor(np.quantile([distance.of(w) for w in plain], UNDER)) + 1 if plain else np.ones(len(UNDER))
        self.distance = distance
        self.weights = self._logistic(np.array([self.features(r) for r in held]), known)

    def features(self, text: bytes) -> np.ndarray:
        """Logarithms of how many windows reach each threshold, the largest distance, and a constant."""
        found = self.distance.all(text)
        return np.append(np.log1p((found[:, None] >= self.thresholds).sum(axis=0)), (max(LEAST, found.max()), 1.0))

    @staticmethod
    def _train(raw: list[bytes], y: np.ndarray) -> Distance | None:
        toxic, ordinary = [r for r, q in zip(raw, y, strict=True) if q == 1], [r for r, q in zip(raw, y, strict=True) if q != 1]
        stems = marks(toxic, ordinary)
        seen: dict[bytes, int] = {}
        for r in toxic:
            for w in set(windows(r)):
                if w[:4] in stems or w[:5] in stems:
                    seen[w] = seen.get(w, 0) + 1
        if not seen:
            return None
        marking = [w for w in sorted(seen) for _ in range(min(seen[w], 50))]
        common = sorted({w for r in ordinary for w in windows(r)})
        draw = np.random.default_rng(1)
        one, other = [marking[i] for i in draw.permutation(len(marking))], [common[i] for i in draw.permutation(len(common))[:ORDINARY_WINDOWS]]
        return Distance(dictionary(one, TOXIC_DICTIONARY, TOXIC_SEGMENT), dictionary(other, ORDINARY_DICTIONARY, ORDINARY_SEGMENT))

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ridge logistic regression by Newton's method."""
        w = np.zeros(x.shape[1])
        ridge = np.diag([0.02] * (x.shape[1] - 1) + [1e-4])
        for _ in range(40):
            p = sigmoid(x @ w)
            grad = x.T @ (p - y) + ridge @ w
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), grad)
        return w

    def score(self, raw: list[bytes]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(raw), self.share)
        return np.round(sigmoid(np.array([self.features(r) for r in raw]).reshape(-1, len(self.weights)) @ self.weights), 9)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_rows: int = FIT_ROWS, max_bytes: int = FIT_BYTES) -> Model:
    """The classifier, fitted in one task on the bounded sample."""
    return fitted(labelled_sample(docs, labels, column, BUCKETS, HELD_OUT, max_rows, max_bytes), Classifier)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least 0.5) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: held.value.get().score, BUCKETS, HELD_OUT, THRESHOLD)
