import pickle

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.common import Model

from .helpers import awkward, clashing, empty, fold

MODULES = [(quality, "quality", 4, 2, 0.7), (toxicity, "toxic", 5, 0, 0.5)]


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column, buckets, out, threshold", MODULES)
def test_held_out_accuracy(spark, module, column, buckets, out, threshold):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(docs, module.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert (got.held_out == [fold(i, buckets) == out for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= threshold)).all()
    held = got[got.held_out]
    assert (held.predicted == held[column]).mean() >= 0.93
    assert held.score.between(0, 1).all()


@pytest.mark.parametrize("module, column, buckets, out, threshold", MODULES)
def test_awkward_rows(spark, module, column, buckets, out, threshold):
    some = [i for i in range(1, 200) if fold(i, buckets) != out]
    texts = [(i, ("stupid idiot %%% " if i % 2 else "plain calm words ") * 8 + f" w{i}", "en", "a", 1) for i in some]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    labels = _labels(spark, [(i, 1 - i % 2, i % 2) for i in some] + [(some[0], None, None), (None, 1, 1)])
    model = module.fit(docs, labels)
    got = module.score(clashing(awkward(spark)), model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    equal = [r.score for r in got if r.doc_id in (5, 6)]
    assert len(set(equal)) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert module.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("module, column, buckets, out, threshold", MODULES)
def test_labels_of_one_kind_or_none(spark, module, column, buckets, out, threshold):
    docs = awkward(spark)
    none = module.fit(docs, _labels(spark))
    assert len({r.score for r in module.score(docs, none).collect()}) == 1
    one = module.fit(docs, _labels(spark, [(i, 1, 1) for i in range(1, 10)]))
    assert {r.score for r in module.score(docs, one).collect()} == {1.0}


def test_accepted_keeps_all_columns(spark):
    docs = clashing(awkward(spark))
    model = Model(pickle.dumps(quality.Classifier([], np.array([]))))
    assert quality.accepted(docs, model, threshold=0.4).columns == docs.columns
    assert quality.accepted(docs, model, threshold=0.4).count() == 11
    assert quality.accepted(docs, model, threshold=0.6).count() == 0


def test_marks_are_not_made_by_copies():
    copies = [b"rareword follows exactly this one neighbour"] * 40
    toxic = [f"w{i} badword v{i}".encode() for i in range(40)] + copies
    ordinary = [f"q{i} goodword z{i} and more text here".encode() for i in range(300)]
    found = toxicity.marks(toxic, ordinary)
    assert b"badw" in found and b"rare" not in found


def _some_texts(n=240):
    draw = np.random.default_rng(8)
    ordinary = ["".join(draw.choice(list("abcdefgh"), draw.integers(2, 8))) for _ in range(300)]
    texts, y = [], []
    for k in range(n):
        words = list(draw.choice(ordinary, draw.integers(5, 60)))
        if k % 3 == 0:
            for _ in range(3):
                words.insert(int(draw.integers(0, len(words))), str(draw.choice(["Rotten!", "ghastly", "vile-thing"])))
        texts.append(" ".join(words).encode())
        y.append(int(k % 3 == 0))
    return texts, np.array(y)


def test_toxicity_is_the_plain_computation():
    import re

    import zstandard

    texts, y = _some_texts()
    model = toxicity.Classifier(texts, y)
    assert model.distance is not None
    extra = [b"", b"  ", b"x" * 1000, b"Rotten! " * 400, "naïve ghastly".encode()]
    got = model.score([*texts, *extra])
    settings = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    kinds = [zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT for _, raw in model.distance.parts]
    for text, score in zip([*texts, *extra], got, strict=True):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
        found = {w[i : i + 64] for w in words for i in range(0, len(w), 64)}
        distances = []
        for w in found:
            sizes = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=k), compression_params=settings).compress(toxicity.LEAD_IN + b" " + w + b" ")) for (d, _), k in zip(model.distance.parts, kinds, strict=True)]
            distances.append(sizes[1] - sizes[0])
        total = model.weights[-1] + model.weights[-2] * max([*distances, -24])
        for weight, threshold in zip(model.weights, model.thresholds, strict=False):
            total += weight * np.log1p(sum(d >= threshold for d in distances))
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-8)
    assert (got[: len(y)] >= 0.5).tolist() == (y == 1).tolist()


def test_quality_is_the_plain_computation():
    import math
    import zlib

    texts, y = _some_texts()
    model = quality.Classifier(texts, y)
    extra = [b"", b"one", b"AbC 12,5 AbC AbC", "ünï %%% cödé".encode() * 30]
    got = model.score([*texts[:60], *extra])
    pool = model.pooler
    for text, score in zip([*texts[:60], *extra], got, strict=True):
        words = text.lower().split()
        x = [0.0] * (2 * quality.DIMENSIONS + 3)
        for w in words:
            for i, v in enumerate(pool.vectors[pool.words.get(w, len(pool.words))]):
                x[i] += float(v) / len(words)
        for w in text.split():
            kinds = "".join("a" if c > 127 or chr(c).islower() else "A" if chr(c).isupper() else "9" if chr(c).isdigit() else chr(c) for c in w)
            short = "".join(c for i, c in enumerate(kinds) if kinds[max(0, i - 2) : i] != c + c)
            for i, v in enumerate(quality.index_vector(zlib.crc32(b"\0" + short.encode("latin-1")))):
                x[quality.DIMENSIONS + i] += float(v) / len(words)
        if words:
            x[-3:] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), sum(w not in pool.words for w in words) / len(words), math.log1p(len(words)) / 10
        x = [(v - m) / s for v, m, s in zip(x, model.mean.tolist(), model.scale.tolist(), strict=True)]
        hidden = [math.tanh(sum(v * w for v, w in zip(x, column, strict=True)) + b) for column, b in zip(model.layers[0].T.tolist(), model.layers[1].tolist(), strict=True)]
        logit = sum(h * w for h, w in zip(hidden, model.layers[2].tolist(), strict=True)) + float(model.layers[3][0])
        assert score == pytest.approx(1 / (1 + math.exp(-logit / model.temperature)), abs=2e-4)
