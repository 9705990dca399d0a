import hashlib
import random
import sys

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import sentencepiece_codec as codec

from .helpers import awkward, clashing, empty, rows


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.default_model())


def test_random_strings_agree_with_the_library(library):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab e\n.▁é漢\U0001d518 TH<s>") for _ in range(draw.randint(0, 70))) for _ in range(1500)]
    texts += ["x" * 400, " " * 60 + "y", "▁", "\x00", "<0x41>"]
    held = codec.Codec(codec.default_model())
    for text, (found, wrong) in zip(texts, held.encoded(texts), strict=True):
        ids = codec._ids(found)
        assert ids == library.encode(text)
        assert held.decode(ids) == library.decode(ids)
        assert wrong == 0


def test_heap_and_matrix_agree():
    held = codec.Codec(codec.default_model())
    parts = ["thereof", "zzz漢é", "running", "", "a", "internationalisation"]
    assert held.matrix_agenda(parts) == [held.agenda(p) for p in parts]


def test_query_rows(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in codec.roundtrip_digests(docs).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.n_corrected == 0


def test_awkward_rows(spark, library):
    docs = clashing(awkward(spark)).drop("ids")
    got = rows(codec.decode(codec.encode(docs, check="same")))
    assert len(got) == 11
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "") and r["same"]
    assert codec.encode(empty(spark)).count() == 0
    assert codec.roundtrip_digests(empty(spark)).count() == 0
    assert codec.encode(clashing(awkward(spark))).schema["ids"].dataType.simpleString() == "array<int>"
    assert codec.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == ""
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_the_memo_is_small(library):
    """A remembered part costs its ids in decimals beside the part itself; what decodes otherwise and long parts keep their results."""
    held = codec.Codec(codec.default_model())
    texts = [f"word{i} {i}" for i in range(3_000)] + ["y" * 5_000, "a ▁b", "caf́e \U0001d518"]
    for text, (found, shown, _) in zip(texts, held.shown_too(texts), strict=True):
        assert codec._ids(found) == library.encode(text)
        assert shown == library.decode(codec._ids(found)).encode()
    kept = held.memo.young
    assert len(kept) > 6_000 and max(map(len, kept)) <= codec.MEMO_CHARS
    assert all(type(v) is bytes for v in kept.values())
    assert sum(map(sys.getsizeof, kept.values())) < 60 * len(kept)


def test_matrices_are_bounded(monkeypatch):
    held = codec.Codec(codec.default_model())
    sizes, matrix = [], held.matrix_agenda
    monkeypatch.setattr(held, "matrix_agenda", lambda parts: sizes.append(len(parts) * (1 + max(map(len, parts)))) or matrix(parts))
    texts = [" ".join(f"w{i * 77_777:011d}" for i in range(k, k + 20_000)) for k in range(0, 60_000, 20_000)]
    list(held.encoded(texts))
    assert len(sizes) > 1 and max(sizes) <= codec.MATRIX_SYMBOLS


def test_pieces_that_show_otherwise(library):
    """Parts whose ids decode to something else are kept with it."""
    held = codec.Codec(codec.default_model())
    held.shown = [x.replace(b"q", b"Q") for x in held.shown]
    ((found, shown, _),) = held.shown_too(["ab q cd q"])
    assert codec._ids(found) == library.encode("ab q cd q") and shown == b"ab Q cd Q"
