"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text: the hash at a byte depends on the
``32`` bytes up to it, and where its ``MASK_BITS`` highest bits are zero a chunk
ends, so chunk borders move with the text and an insertion changes only the
chunks that it touches.  The rolling sum is made for a whole text at once by
doubling (sums over 1, 2, 4, 8, 16, 32 bytes).  Chunks have at least
``SHORTEST`` and at most ``LONGEST`` bytes and are known by a 128-bit digest.

A chunk repeats if it occurs in different documents.  A passage is a stretch of
neighbouring repeating chunks of at least ``PASSAGE`` bytes; single chunks that
happen to be equal are left alone.  The first document (least doc_id) with a
chunk keeps it, in all others it is a copy.

Chunk borders may fall so that a shared passage holds few whole chunks.  Runs of
``GRAM`` words are therefore chunks as well, which overlap the others: of every
``SHARED - GRAM + 1`` neighbouring runs the one with the least hash.  Any
``SHARED`` words (between ASCII white space) that two documents share hold such a
run in both, and a repeating run of words is a passage of any size.

Counting chunks combines on the map side; marking them joins two shuffled
sides, where Spark splits a digest that a third of all documents share.

Defined results: null and empty texts have no chunks; rows of one doc_id count
as one document, whose repeats within itself are not passages, and rows without
doc_id are left out; offsets count UTF-8 bytes, end exclusive; whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, per_batch, raw_texts, table

MASK_BITS = 5
SHORTEST, LONGEST = 24, 256
PASSAGE = 96
GRAM, SHARED = 25, 50
GEAR = np.random.default_rng(1592653589).integers(0, 1 << 32, 256, dtype=np.uint32)
_BYTES = np.random.default_rng(2718281828).integers(0, 1 << 63, 256, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, GRAM + 1)], dtype=np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of shifted table values of the 32 bytes up to it."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(raw)
    if n == 0:
        return []
    h = rolling(np.frombuffer(raw, dtype=np.uint8).copy())
    places = (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    out, last = [], 0
    for p in places:
        if p - last < SHORTEST:
            continue
        while p - last > LONGEST:
            last += LONGEST
            out.append(last)
        if p - last >= SHORTEST:
            out.append(p)
            last = p
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def grams(raw: bytes) -> list[tuple[int, int]]:
    """Begin and end of the chosen runs of ``GRAM`` words: one of any ``SHARED - GRAM + 1`` neighbours at least.

    Of equal runs one is enough within ``SHARED`` words.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    begins, ends = edges[::2], edges[1::2]
    n, width = len(begins) - GRAM + 1, SHARED - GRAM + 1
    if n < width:
        return []
    # A word's hash: its bytes' values times powers of an odd number by their place in it.
    within = np.arange(len(data)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(data)]])))
    power = np.multiply.accumulate(np.full(int(within.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = np.where(_SPACE[data], np.uint64(0), _BYTES[data] * power[within])
    words = mix64(np.add.reduceat(value, begins))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        total += words[k : k + n] * _POWERS[k]
    total = mix64(total)
    least = np.lib.stride_tricks.sliding_window_view(total, width).argmin(axis=1) + np.arange(n - width + 1)
    out, last = [], {}
    for i in np.unique(least).tolist():
        if i - last.get(h := int(total[i]), -SHARED) >= SHARED:
            last[h] = i
            out.append((int(begins[i]), int(ends[i + GRAM - 1])))
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """digest (two longs), doc_id, begin and end of every chunk, and whether it is a run of words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(batch):
            ids, begins, ends, digests, runs = [], [], [], [], []
            hashed = xxhash.xxh3_128_digest
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                last = 0
                found = cuts(raw)
                for end in found:
                    digests.append(hashed(raw[last:end]))
                    begins.append(last)
                    last = end
                ends += found
                some = grams(raw)
                for begin, end in some:
                    digests.append(hashed(b"\0" + b" ".join(raw[begin:end].split())))
                    begins.append(begin)
                    ends.append(end)
                ids += [doc] * (len(found) + len(some))
                runs += [False] * len(found) + [True] * len(some)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, batch.column("doc_id").type), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(runs, pa.bool_())], names=["d1", "d2", "doc_id", "begin", "end", "gram"])

        return one

    return per_batch(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), make, f"d1 long, d2 long, doc_id {kind}, begin int, end int, gram boolean")


def repeating(found: DataFrame) -> DataFrame:
    """Digests that occur in different documents, with the first of them."""
    return found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where(F.col("first_doc") != F.col("last_doc")).select("d1", "d2", "first_doc")


def repeated(docs: DataFrame) -> DataFrame:
    """The chunks whose digest occurs in different documents.

    Chunks are made once and written, which costs disk and saves a third of the
    time of making them twice; the join reads both sides as they are shuffled,
    so Spark can split a digest that a third of all chunks have.  A chunk's place
    travels as one long.
    """
    found = table(chunks(docs), "zstd")
    placed = found.select("d1", "d2", "doc_id", packed().alias("place"))
    marked = placed.join(table(repeating(found)), ["d1", "d2"])
    return marked.select("d1", "d2", "doc_id", *unpacked(), "first_doc")


def packed():
    """begin, end and gram as one long."""
    return F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("end").cast("long"), 1)).bitwiseOR(F.col("gram").cast("long"))


def unpacked() -> list:
    place = F.col("place")
    low = place.bitwiseAND(F.lit((1 << 32) - 1))
    return [F.shiftright(place, 32).cast("int").alias("begin"), F.shiftright(low, 1).cast("int").alias("end"), (place.bitwiseAND(F.lit(1)) == 1).alias("gram")]


def _runs(parts: list[dict]) -> list[tuple[int, int, list[dict]]]:
    parts = sorted(parts, key=lambda p: (p["begin"], p["end"]))
    out: list = []
    for p in parts:
        if out and out[-1][1] >= p["begin"]:
            out[-1][1] = max(out[-1][1], p["end"])
            out[-1][2].append(p)
        else:
            out.append([p["begin"], p["end"], [p]])
    return [tuple(r) for r in out if r[1] - r[0] >= PASSAGE or any(p["gram"] for p in r[2])]


def _length(parts: set[tuple[int, int]]) -> int:
    """Bytes that parts cover, which may overlap."""
    total = at = 0
    for b, e in sorted(parts):
        total += max(0, e - max(at, b))
        at = max(at, e)
    return total


def passages(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages: doc_id, n_passages, repeated_bytes, copied_bytes, passages, first_docs.

    ``passages`` are the stretches (begin, end) that other documents hold too,
    ``copied_bytes`` the bytes of them that an earlier document holds, and
    ``first_docs`` the first documents of their chunks.
    """
    marked = repeated(docs)
    gathered = marked.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "gram", "first_doc")).alias("parts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_passages long, repeated_bytes long, copied_bytes long, passages array<struct<begin:int,end:int>>, first_docs array<{kind}>"

    def make():
        def one(batch):
            rows = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if runs := _runs(parts):
                    copied = {(p["begin"], p["end"]) for _, _, held in runs for p in held if p["first_doc"] != doc}
                    firsts = sorted({p["first_doc"] for _, _, held in runs for p in held})
                    rows.append((doc, len(runs), sum(e - b for b, e, _ in runs), _length(copied), [{"begin": b, "end": e} for b, e, _ in runs], firsts))
            if not rows:
                return None
            c = list(zip(*rows, strict=True))
            ids = batch.column("doc_id").type
            return pa.RecordBatch.from_arrays([pa.array(c[0], ids), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array(c[4], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(c[5], pa.list_(ids))], names=["doc_id", "n_passages", "repeated_bytes", "copied_bytes", "passages", "first_docs"])

        return one

    return per_batch(gathered, make, schema)


def without_copies(docs: DataFrame) -> DataFrame:
    """Documents without the chunks of passages that an earlier document holds; n_chars is brought up to date.

    A text whose cut would split a character loses that character too.
    """
    marked = repeated(docs)
    gathered = marked.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "gram", "first_doc")).alias("_parts"))
    names = docs.columns
    held = "_".join(["parts", *names])  # no column has this name
    joined = docs.join(gathered.withColumnRenamed("_parts", held), "doc_id", "left").select(*names, held)

    def make():
        def one(batch):
            given, new = batch.column("text").to_pylist(), []
            for doc, text, parts in zip(batch.column("doc_id").to_pylist(), given, batch.column(held).to_pylist(), strict=True):
                if text is None or not parts:
                    new.append(text)
                    continue
                raw, out, at = text.encode(), [], 0
                for b, e in sorted({(p["begin"], p["end"]) for _, _, held in _runs(parts) for p in held if p["first_doc"] != doc}):
                    out.append(raw[at:b])
                    at = max(at, e)
                new.append(b"".join([*out, raw[at:]]).decode("utf-8", "ignore"))
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t or "") for t in new], pa.int64()).cast(cols["n_chars"].type)
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        return one

    return per_batch(joined, make, docs.schema)
