"""Quartile bucket digests of whole texts and a bounded difference score.

Three byte triplets, of differing spans, start at every byte of a text's UTF-8 form; each is hashed
to one of 256 buckets and the buckets are counted.  A bucket's two-bit code
tells between which quartiles of the text's own counts it lies, so the digest
does not depend on the text's length; the length is kept beside it on a
logarithmic scale.  A digest is written as 130 hexadecimal digits: two for the
length and 128 for the codes.

Two digests differ by the sum over buckets of how far their codes are apart
(opposite codes count double) and by their lengths; every term is capped, so
likeness = 1 - difference / largest difference lies between 0 and 1.

Defined results: null and empty texts have the digest of no triplets (all codes
0, length 0) and texts shorter than every triplet the codes 0 with their length; equal
texts have equal digests; texts are read whole; doc_id is read as a 64-bit
integer where documents are ordered by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

BUCKETS = 256
#: Distances of the second and third byte of a triplet from its first.
SPANS = ((2, 5), (3, 7), (5, 11))
LENGTH_BASE = 1.1
LENGTH_CAP = 24
#: Sampled rows for each range that documents are cut into.
CUT_ROWS = 40
_MOST = BUCKETS * 6 + LENGTH_CAP


def _tables() -> np.ndarray:
    """A random byte table for each place in each kind of triplet (fixed seed)."""
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 256, (len(SPANS), 3, 256), dtype=np.uint8)


TABLES = _tables()
#: Difference of two codes: 0, 1, 2, or 6 for opposite ones.
_APART = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int32)


def bucket_counts(raw: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets per text, one row for each."""
    out = np.zeros((len(raw), BUCKETS), dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raw]) if raw else []
    for (second, third), tables in zip(SPANS, TABLES, strict=True):
        n = len(data) - third
        if n <= 0:
            continue
        hashed = (tables[0][data[:n]] + tables[1][data[second : second + n]]) ^ tables[2][data[third:]]
        begin = 0
        for k, end in enumerate(ends):
            if end - third > begin:
                out[k] += np.bincount(hashed[begin : end - third], minlength=BUCKETS)
            begin = end
    return out


def codes(counts: np.ndarray) -> np.ndarray:
    """Two-bit quartile codes per row of counts."""
    ranked = np.sort(counts, axis=1)
    out = np.zeros(counts.shape, dtype=np.uint8)
    for q in (1, 2, 3):
        out += counts > ranked[:, q * BUCKETS // 4 - 1][:, None]
    return out


def length_code(n_bytes: int) -> int:
    return 0 if n_bytes == 0 else min(255, 1 + int(np.log(n_bytes) / np.log(LENGTH_BASE)))


def digests(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one row per text) and length codes."""
    return codes(bucket_counts(raw)), np.array([length_code(len(r)) for r in raw], dtype=np.int32)


def written(code: np.ndarray, length: np.ndarray) -> list[str]:
    shift = np.array([0, 2, 4, 6], dtype=np.uint8)
    packed = (code.reshape(len(code), BUCKETS // 4, 4) << shift).sum(axis=2).astype(np.uint8)
    return [f"{n:02x}{p.tobytes().hex()}" for n, p in zip(length, packed, strict=True)]


def parsed(digest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and length codes of written digests."""
    raw = np.array([list(bytes.fromhex(d)) for d in digest], dtype=np.uint8).reshape(len(digest), 1 + BUCKETS // 4)
    code = (raw[:, 1:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
    return code.reshape(len(digest), BUCKETS), raw[:, 0].astype(np.int32)


def difference(a, b) -> np.ndarray:
    """Difference scores of rows of two (codes, lengths) pairs; 0 to 1560."""
    return _APART[a[0], b[0]].sum(axis=1) + np.minimum(np.abs(a[1] - b[1]), LENGTH_CAP)


def likeness(a, b) -> np.ndarray:
    return 1.0 - difference(a, b) / _MOST


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the written digest of every whole text; other columns stay."""

    @F.pandas_udf("string")
    def make(column: pd.Series) -> pd.Series:
        return pd.Series(written(*digests([(t or "").encode() for t in column])), dtype=object)

    return df.withColumn(out, make(F.col(text)))


def compare(df: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """Add the likeness of two columns of written digests; null where either is null."""

    @F.pandas_udf("double")
    def make(x: pd.Series, y: pd.Series) -> pd.Series:
        got = pd.Series([None] * len(x), dtype="float64")
        if (both := x.notna() & y.notna()).any():
            got[both] = likeness(parsed(list(x[both])), parsed(list(y[both])))
        return got

    return df.withColumn(out, make(F.col(a), F.col(b)))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranges_of(k: np.ndarray, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cuts (rows of two numbers, in order) are at most (k, h), row by row."""
    keys, hashes = np.concatenate([cuts[:, 0], k]), np.concatenate([cuts[:, 1], h])
    mine = np.arange(len(keys)) >= len(cuts)
    order = np.lexsort((mine, hashes, keys))
    below = np.cumsum(~mine[order])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = below
    return out[len(cuts) :]


def _partition_keys(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning deals there."""
    out: dict[int, int] = {}
    size = 64 * n
    while len(out) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()
        out, size = {r.p: r.i for r in rows}, 2 * size
    return [out[p] for p in range(n)]


def with_next(df: DataFrame) -> DataFrame:
    """Documents dealt so that each is followed by its next one in descending order of doc_id.

    Rows are cut into ranges by doc_id and a hash of the text, at quantiles of a
    sample (four ranges a shuffle partition, neighbouring ones in one partition),
    each range is sorted by itself, and the first document of every range is also
    dealt to the range before it, as its ``tail``.  Whole texts are shuffled once;
    only the sample's numbers (about ``CUT_ROWS`` a range) and one row a range
    reach the driver.  After the last document comes the first.  Null ids come
    after all others; rows of one id, as many as there may be, are ordered by the
    hash and then the text, and split as others are; only equal rows stay together.

    Returns range, tail, doc_id, text, sorted within partitions.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    placed = df.select(key.alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, 4 * n * CUT_ROWS / max(1, df.count()))
    some = placed.select("k", "h").where(F.pmod(F.xxhash64("h", "k"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().collect()
    drawn = np.array(sorted((r.k, r.h) for r in some), dtype=np.int64).reshape(-1, 2)
    cuts = np.unique(drawn[[len(drawn) * i // (4 * n) for i in range(1, 4 * n)]], axis=0) if len(drawn) else drawn

    dealt = F.pandas_udf(lambda k, h: pd.Series(ranges_of(k.to_numpy(), h.to_numpy(), cuts)), "long")
    ranged = placed.withColumn("range", dealt("k", "h"))
    first = {r.range: (r.m.k, r.m.h) for r in ranged.groupBy("range").agg(F.max(F.struct("k", "h")).alias("m")).collect()}
    names = sorted(first)
    above = {r: names[(i + 1) % len(names)] for i, r in enumerate(names)}
    keys = _partition_keys(spark, n)
    part = {r: keys[i * n // len(names)] for i, r in enumerate(names)}

    def tail_of(k: pd.Series, h: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([above[r] if first[r] == (x, y) else -1 for x, y, r in zip(k, h, of, strict=True)], dtype="int64")

    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    also = F.struct(F.col("above").alias("range"), F.lit(True).alias("tail"))
    beside = ranged.withColumn("above", F.pandas_udf(tail_of, "long")("k", "h", "range"))
    twice = beside.withColumn("at", F.explode(F.when(F.col("above") < 0, F.array(own)).otherwise(F.array(own, also))))
    where = F.pandas_udf(lambda r: r.map(part).astype("int32"), "int")
    dealt_out = twice.select(where("at.range").alias("part"), "at.range", "at.tail", "k", "h", "doc_id", "text").repartition(n, "part")
    return dealt_out.sortWithinPartitions("range", "tail", F.desc("k"), F.desc("h"), "text").select("range", "tail", "doc_id", "text")


def neighbour_likeness(df: DataFrame) -> DataFrame:
    """Per document: its digest, its edited text's, and their likeness and the next document's."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in pieces(batches):
            ranges, tails = batch.column("range").to_pylist(), batch.column("tail").to_pylist()
            ids, full = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            code, length = digests([t.encode() for t in full])
            if held is not None:
                ranges, tails, ids, full = [held[0], *ranges], [held[1], *tails], [held[2], *ids], [held[3], *full]
                code, length = np.concatenate([held[4][None], code]), np.concatenate([[held[5]], length])
            at = [i for i in range(len(ids) - 1) if not tails[i] and ranges[i] == ranges[i + 1]]
            held = (ranges[-1], tails[-1], ids[-1], full[-1], code[-1], length[-1])
            if not at:
                continue
            new = [edited(full[i], full[i + 1]).encode() for i in at]
            mine, other = (code[at], length[at]), digests(new)
            after = [i + 1 for i in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], id_type), pa.array([len(full[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new]), pa.array(written(*mine)), pa.array(written(*other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, (code[after], length[after])))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(df.select("doc_id", "text")).mapInArrow(run, schema)
