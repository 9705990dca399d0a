"""Exact Jaccard similarity join of word shingles in the metric space of sets.

A document's set holds its distinct shingles of ``WORDS`` words (the whole
sequence where there are fewer words; nothing without words).  Distance is one
less the Jaccard index, a metric; two sets link within ``EPSILON`` = 1 - 0.75.

Equal sets become one point.  Unrelated texts are all at distance 1, so
documents as pivots can't part them; an inverted index does that first: under
one global order of shingles (frequency, then hash) linked sets share
one of their first n - ceil(0.75 n) + 1 shingles, so every such shingle spans a
region, a point lies in the regions of its own first shingles, and regions
without a second point go; regions of the same points count as one, of their
common weight.  In every region the point of least priority is a pivot, and the
pivot that most of a point's regions have is its home.  The points of one home
are a Voronoi cell, and each point's distance to its home is computed.

Cells are joined first, recursively: pivots are drawn in a cell, at first the
point that shares most with others, then points of the smallest components, and
are compared with the cell's points of other components whose distance to the
home lies within ``EPSILON`` of the pivot's own (triangle inequality).  Pivots
that have met their cell leave it, cells that have become connected go, and the
number of pivots grows from round to round.  The index then replicates points
over the cells' boundaries: of every region whose points aren't all connected
by then, points of different cells are joined in the same way.  In both, sizes,
the weight of the regions that two points share (linked sets share at least so
many first shingles) and a parity sketch of the shingles, whose differing bits
bound the symmetric difference from below, keep pairs out that can't link.  No
rule drops a linked pair, so every pair of linked points is compared or already
connected, and components are exact.

Frequent shingles are counted over all documents, in counters of bounded number
a task, small parts together; at most ``MOST_FREQUENT`` of them order the shingles and have their rows
spread, the result is the same for any order.
Components are found by contracting links in the tasks that hold them, and by
alternating stars on distributed tables where many links are left.  Shingles and sets are known by
64-bit hashes.

Defined results: null and empty texts have no shingles, component_id their own
doc_id, and link with nothing; rows of one doc_id with different texts are
linked through their id; rows without doc_id have their own set size and no
component; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, drop_table, mix64, per_batch, pieces, raw_texts, relieve, table

WORDS = 5
#: Link where 100 * intersection >= 75 * union.
PERCENT = 75
EPSILON = 0.25
FREQUENT = 3
MOST_FREQUENT = 200_000
#: Shingles that a task counts at once, and bytes of files that one counts at least, unless cores were idle then.
TASK_SHINGLES, COUNTED_BYTES = 400_000, 16_000_000
#: Least number of parts of a frequent shingle's region, and rows of first shingles that a task sorts.
SALTS, TASK_ROWS = 64, 1_000_000
#: Rows of narrow and of wide tables that are broadcast, by count.
BROADCAST_ROWS, WIDE_ROWS = 400_000, 40_000
#: Links that one task joins at once.
ONE_TASK_LINKS = 500_000
FIRST_PIVOTS, PIVOT_GROWTH = 1, 64
#: Ranks of frequent shingles go up to this, by so many for each doubling of their number.
MOST_RANK, RANKS_A_DOUBLING = 127, 5
#: Bits of a sketch, kept as words of 64.
BITS = 1024
SKETCH = [f"w{k}" for k in range(BITS // 64)]
#: Words of the folded sketch.
FOLDED = [f"f{k}" for k in range(8)]

_BYTE = np.random.default_rng(314159).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.random.default_rng(271828).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, held: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - one table per process
    """The first n powers of the base and of its inverse."""
    if not held or len(held[0]) < n:
        size = max(n, 1 << 16)
        held[:] = [np.full(size, x, dtype=np.uint64) for x in (_BASE, _BACK)]
        for table_ in held:
            table_[0] = 1
            np.cumprod(table_, out=table_)
    return held[0][:n], held[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text (or of texts with a space between), in order.

    A word's hash is the difference of two prefix sums of byte values times
    powers of an odd number, brought to the same power.
    """
    data = np.frombuffer(raw.lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    space = np.concatenate([[True], _SPACE[data], [True]])
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    powers, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64))


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    w = word_hashes(raw)
    n = len(w)
    if n == 0:
        return w
    if n < WORDS:
        total = np.uint64(n)
        with np.errstate(over="ignore"):
            for k in range(n):
                total += w[k] * _PLACES[k]
        return mix64(np.array([total], dtype=np.uint64))
    total = np.zeros(n - WORDS + 1, dtype=np.uint64)
    for k in range(WORDS):
        total += w[k : k + len(total)] * _PLACES[k]
    return np.unique(mix64(total))


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def prefix_size(n):
    return n - (PERCENT * n + 99) // 100 + 1


def linked(inter, union):
    return 100 * inter >= PERCENT * union


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles by their low hash bits, as words."""
    odd = np.bincount((shingles & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def most_common(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """A bound on the intersection of two sets: each differing bit of their sketches stands for an element that only one has."""
    return min(n_a, n_b, (n_a + n_b - int(np.bitwise_count((a ^ b).view(np.uint64)).sum())) // 2)


def document_sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, the id of the set (null if it is empty), its first shingles with their ranks, where they end, and its sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        hot, counts = shipped.value

        def first(shingles):
            keep = prefix_size(len(shingles))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
                found = hot[at] == shingles
                if found.any():
                    rank = np.where(found, counts[at], 0).astype(np.uint8)
                    order = np.argsort(rank, kind="stable")[:keep]
                    end = order[-1]
                    return shingles[order].tobytes() + rank[order].tobytes(), (int(rank[end]) << 56) | (int(shingles[end]) >> 8)
            return shingles[:keep].tobytes() + bytes(keep), int(shingles[keep - 1]) >> 8

        def one(batch):
            sets = [shingle_set(t) for t in raw_texts(batch.column("text"))]
            firsts = [first(s) if len(s) else (None, None) for s in sets]
            words = np.array([sketch(s) for s in sets]).reshape(len(sets), len(SKETCH))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([f for f, _ in firsts], pa.binary()), pa.array([e for _, e in firsts], pa.int64()), *(pa.array(w) for w in words.T)], names=["doc_id", "n_shingles", "point", "first", "last", *SKETCH])

        return one

    return per_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles long, point long, first binary, last long, {', '.join(f'{w} long' for w in SKETCH)}")


def fewer(shingles: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many counted shingles: each number is lowered by the first one that doesn't fit (Misra and Gries)."""
    if len(n) <= most:
        return shingles, n
    n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    return shingles[n > 0], n[n > 0]


def _file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, as Spark estimates them; far too many where it can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def shingle_counts(docs: DataFrame) -> DataFrame:
    """s and n: shingles and in how many of a task's documents they come.

    All documents are counted.  A task holds at most ``TASK_SHINGLES`` counters;
    what it holds too little of a shingle is at most its part's shingles divided
    by that, and one, so rare ones may go and frequent ones never do.  A task
    whose shingles all fit its counters lowers none and returns each, and many
    small ones would return most of the table's: small parts are put together.
    """

    def run(batches):
        claim(None)
        shingles, n, new, size, lowered = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, False

        def counted():
            every = np.concatenate([shingles, *new])
            order = np.argsort(every)
            every, number = every[order], np.concatenate([n, np.ones(size, np.int64)])[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
            return fewer(every[first], np.add.reduceat(number, first) if len(first) else number, TASK_SHINGLES)

        for batch in pieces(batches):
            for text in raw_texts(batch.column("text")):
                new.append(shingle_set(text))
                size += len(new[-1])
                if size > 2 * TASK_SHINGLES:
                    shingles, n = counted()
                    new, size, lowered = [], 0, True
        shingles, n = counted()
        if lowered:  # what came once since tells no more than what went
            shingles, n = shingles[n > 1], n[n > 1]
        for at in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(shingles[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["s", "n"])

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-_file_bytes(docs) // COUNTED_BYTES))
    some = docs.where(F.col("doc_id").isNotNull()).select("text")
    return some.coalesce(min(tasks, (1 << 31) - 1)).mapInArrow(run, "s long, n long")


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come in at least FREQUENT documents, sorted, with their ranks; of more than MOST_FREQUENT the most frequent."""
    # Ranks grow with the logarithm, so that they tell shingles of millions of documents apart.
    rank = F.least(F.floor(F.log2("n") * RANKS_A_DOUBLING), F.lit(MOST_RANK)).cast("byte")
    found = table(shingle_counts(docs).groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("s", rank.alias("n")))
    held, least = 0, MOST_RANK + 1
    for n, many in sorted(((r.n, r["count"]) for r in found.groupBy("n").count().collect()), reverse=True):
        held += many
        if held > MOST_FREQUENT:
            break
        least = n
    kept = found.where(F.col("n") >= least).toArrow()
    shingles, n = kept.column("s").to_numpy().view(np.uint64), kept.column("n").to_numpy().astype(np.uint8)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def postings(sets: DataFrame, salts: int = SALTS) -> DataFrame:
    """salt, s, point and size for the first shingles of every set; salt spreads frequent shingles (-1: not frequent).

    What most rows have in common comes first, so that a shuffled row takes fewer bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            points, sizes, firsts = (batch.column(c).to_pylist() for c in ("point", "n_shingles", "first"))
            new = []
            for i, p in enumerate(points):
                if p not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(p)
                    new.append(i)
            for at in range(0, len(new), 1_000):
                some = new[at : at + 1_000]
                keep = np.array([len(firsts[i]) // 9 for i in some])
                s = np.concatenate([np.frombuffer(firsts[i], dtype=np.int64, count=k) for i, k in zip(some, keep, strict=True)])
                rank = np.concatenate([np.frombuffer(firsts[i], dtype=np.uint8, offset=8 * k) for i, k in zip(some, keep, strict=True)])
                point = np.repeat(np.array([points[i] for i in some], dtype=np.int64), keep)
                salt = np.where(rank > 0, point % salts, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(salt), pa.array(s), pa.array(point), pa.array(np.repeat(np.array([sizes[i] for i in some], dtype=np.int32), keep))], names=["salt", "s", "point", "n"])

    return sets.where(F.col("doc_id").isNotNull() & F.col("point").isNotNull()).select("point", "n_shingles", "first").mapInArrow(run, "salt int, s long, point long, n int")


def regions(found: DataFrame, parts: int) -> DataFrame:
    """region, whether it is spread, point, n, the pivot and its size, and the region's weight.

    One shuffle deals postings by shingle (and salt, for frequent ones); each
    task sorts its own part in numpy, drops regions of one point and writes
    regions of the same points once, with their number as weight.  A frequent
    shingle stays a region of its own, as each task sees only a part of it.
    """

    def run(batches):
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "salt", "point", "n")] for b in batches]
        if not held:
            return
        s, salt, point, size = (np.concatenate(c) for c in zip(*held, strict=True))
        held = None
        # Only shingles that come again matter; few do.
        mixed = mix64(s.view(np.uint64) + (salt.astype(np.int64) + 1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(mixed)
        mixed = mixed[order]
        twice = np.zeros(len(mixed), dtype=bool)
        twice[1:] = mixed[1:] == mixed[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice | (salt[order] >= 0)]
        s, salt, point, size = s[order], salt[order], point[order], size[order]
        if not len(s):
            return
        order = np.lexsort((mix64(point.view(np.uint64)), salt, s))
        s, salt, point, size = s[order], salt[order], point[order], size[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
        again = np.zeros(len(s), dtype=bool)
        again[1:] = ~new[1:] & (point[1:] == point[:-1])
        s, salt, point, size, new = (x[~again] for x in (s, salt, point, size, new))
        begin = np.flatnonzero(new)
        held = np.diff(np.append(begin, len(s)))
        spread = salt[begin] >= 0
        keep = (held > 1) | spread
        name = np.add.reduceat(mix64(point.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)), begin)
        name = np.where(spread, s[begin].view(np.uint64), mix64(name ^ held.astype(np.uint64)))
        # One region for each name; frequent shingles keep theirs, salt by salt.
        unique = np.where(spread, mix64(name + (salt[begin].astype(np.int64) + 2).view(np.uint64)), name)
        _, first, weight = np.unique(unique[keep], return_index=True, return_counts=True)
        chosen = np.flatnonzero(keep)[first]
        take = np.repeat(begin[chosen] - np.cumsum(held[chosen]) + held[chosen], held[chosen]) + np.arange(int(held[chosen].sum()))
        by = lambda x: np.repeat(x, held[chosen])
        cols = (by(name[chosen].view(np.int64)), by(spread[chosen]), point[take], size[take], by(point[begin[chosen]]), by(size[begin[chosen]]), by(weight))
        for at in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in cols], names=["region", "spread", "point", "n", "pivot", "pivot_n", "weight"])

    return found.repartition(parts, "s", "salt").mapInArrow(run, "region long, spread boolean, point long, n int, pivot long, pivot_n int, weight long")


def _fits(a, b):
    """Whether sets of two sizes can link at all."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked for broadcasting if it has few rows by count; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, distance and whether they link, from the whole texts of pairs (a, b, doc_a, doc_b).

    Pairs meet the text of their first and then of their second point.  Few
    pairs are broadcast so that texts without a pair are not shuffled; many are
    joined by shuffle.  Spark splits the rows of a pivot with many points.
    """
    pairs = _small(table(pairs.select("a", "b", "doc_a", "doc_b").distinct()))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    first = texts.withColumnsRenamed({"doc_id": "doc_a", "text": "text_a"}).join(pairs, "doc_a")
    second = texts.join(pairs.select(F.col("doc_b").alias("doc_id")), "doc_id", "left_semi").withColumnsRenamed({"doc_id": "doc_b", "text": "text_b"})
    both = first.select("a", "b", "doc_b", "text_a").join(second.hint("merge"), "doc_b").select("a", "b", "text_a", "text_b")

    def make():
        last: list = [None, None]

        def one(batch):
            rows = []
            for x, y, p, q in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), raw_texts(batch.column("text_a")), raw_texts(batch.column("text_b")), strict=True):
                if last[0] != q:
                    last[:] = q, shingle_set(q)
                mine, other = shingle_set(p), last[1]
                # Rows of one doc_id with different texts would meet here: only the points asked for count.
                if set_id(mine) != x or set_id(other) != y:
                    continue
                inter = len(np.intersect1d(mine, other, assume_unique=True))
                union = len(mine) + len(other) - inter
                rows.append((x, y, 1 - inter / union, linked(inter, union)))
            if not rows:
                return None
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array([bool(x) for x in c[3]])], names=["a", "b", "distance", "link"])

        return one

    return table(per_batch(both, make, "a long, b long, distance double, link boolean"))


def least_of_each(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of links and the least point of each one's component: minima over links and jumps, until nothing changes."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    least = np.arange(len(names))
    while True:
        new = least.copy()
        low = np.minimum(least[x], least[y])
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, least[end], low)
        new = new[new]
        if (new == least).all():
            return names, names[least]
        least = new


def _contracted(links: DataFrame, whole: bool = False) -> DataFrame:
    """The same components from fewer links: each task joins the links that it holds and gives every point its least one.

    With ``whole`` the least points come too, with themselves.
    """

    def run(batches):
        held: list = []

        def flush():
            v, c = least_of_each(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            own = (v != c) | whole
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[own]), pa.array(c[own])], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
                if sum(len(x) for x, _ in held) > ONE_TASK_LINKS:
                    yield from flush()
        if held:
            yield from flush()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """v and c (the least point of its component) of every point with a link (a, b).

    Each task contracts the links that it holds.  Up to ``ONE_TASK_LINKS`` that
    are left are contracted by one more task; more of them by alternating large
    and small stars.
    """
    edges = table(_contracted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")))
    if edges.count() <= (ONE_TASK_LINKS if one_task is None else one_task):
        return _contracted(edges.repartition(1), whole=True).select(F.col("u").alias("v"), F.col("v").alias("c"))
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(edges)
    while before[0]:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = table(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("c")).withColumnRenamed("u", "v").unionByName(edges.select(F.col("v"), F.col("v").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))


def _beyond(n):
    """How many shingles that two linked sets share can lie after the first ones of a set, whose first ones end first."""
    return F.floor((n * PERCENT + 99) / 100) - 1


def _needed():
    """The least weight of regions that linked points a and b share."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    rest = F.when(F.col("last_a") < F.col("last_b"), _beyond(n_a)).when(F.col("last_a") > F.col("last_b"), _beyond(n_b)).otherwise(F.greatest(_beyond(n_a), _beyond(n_b)))
    return F.greatest(F.ceil((n_a + n_b) * PERCENT / (100 + PERCENT)) - rest, F.lit(1))


def _near(words: list[str]):
    """Whether sketches of two points, of the words given, let them link."""
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words[1:]), F.bit_count(F.col(f"{words[0]}_a").bitwiseXOR(F.col(f"{words[0]}_b"))))
    return (F.col("n_a") + F.col("n_b")) * (100 - PERCENT) >= apart * (100 + PERCENT)


def _may_link(weight: str, words: list[str] = SKETCH):
    """What two points must fulfil to link: sizes, shared weight (bounded by each one's) and sketches."""
    return _fits("n_a", "n_b") & (F.least(f"{weight}_a", f"{weight}_b") >= _needed()) & _near(words)


def _side(df: DataFrame, k: str, keep: tuple = ()) -> DataFrame:
    """The frame with its point named ``k`` and all columns but ``keep`` marked by it."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(k if c == "point" else f"{c}_{k}") for c in df.columns])


def _pairs(left: DataFrame, right: DataFrame, on: str, where) -> DataFrame:
    return _side(left, "a", (on,)).join(_side(right, "b", (on,)), on).where(where)


def _joined(label: DataFrame, known: DataFrame) -> DataFrame:
    """Labels (point, c) brought up to date with the links among compared pairs."""
    new = known.where("link").select("a", "b")
    joined = table(components(label.select(F.col("point").alias("a"), F.col("c").alias("b")).unionByName(new)).withColumnRenamed("v", "point"))
    relieve(label.sparkSession)
    return joined


def _labelled(df: DataFrame, label: DataFrame) -> DataFrame:
    return df.join(_small(label), "point", "left").withColumn("c", F.coalesce("c", "point"))


def _drawn(df: DataFrame, group: str, order, step: int, pivots: int) -> DataFrame:
    """A point for each of ``pivots`` places of every group that has one: the first in an order, ties by a hash."""
    place = F.pmod(F.xxhash64("point", F.lit(step)), F.lit(pivots))
    first = F.min(F.struct(order.alias("o"), F.xxhash64("point", F.lit(-step)).alias("then"), F.col("point")))
    return table(df.groupBy(group, place.alias("place")).agg(first.alias("p")).select("p.point"))


def cell_rounds(docs: DataFrame, cells: DataFrame, label: DataFrame) -> DataFrame:
    """Labels after all linked pairs of one cell are connected.

    ``cells`` holds point, doc, n, last, cell, distance, weight, degree and the
    sketch of every point that shares a region with another.
    """
    pivots, step = FIRST_PIVOTS, 0
    while True:
        named = _labelled(cells, label)
        open_ = table(named.groupBy("cell").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")).where("low <> high").select("cell", "least", "most"))
        # A point whose own weight is under what any size in its cell would need links with none there.
        n, both = F.col("n"), lambda other: (F.col("n") + other) * PERCENT / (100 + PERCENT)
        small, large = F.greatest("least", F.ceil(n * PERCENT / 100)), F.least("most", F.floor(n * 100 / PERCENT))
        needed = F.least(F.ceil(both(small)) - _beyond(n), F.ceil(both(large) - large * PERCENT / 100 - 1e-6))
        cells = table(named.join(_small(open_), "cell").where(F.col("weight") >= needed).drop("least", "most"))
        if cells.isEmpty():
            return label
        # At first the point that shares most with others, which is near the middle of a group of copies; then those that share least.
        drawn = _drawn(cells, "cell", -F.col("degree") if step == 0 else F.col("weight"), step, pivots)
        some = _small(drawn)
        within = F.coalesce(F.abs(F.col("distance_a") - F.col("distance_b")) <= EPSILON + 1e-9, F.lit(True))
        asked = _pairs(cells, _small(table(cells.join(some, "point", "left_semi")), WIDE_ROWS), "cell", (F.col("c_a") != F.col("c_b")) & _may_link("weight") & within)
        label = _joined(label, compare(docs, _ordered(asked)))
        cells = cells.drop("c").join(some, "point", "left_anti")
        pivots *= PIVOT_GROWTH
        step += 1


def folded() -> dict:
    """A sketch of fewer bits from the whole one: parities by fewer hash bits are sums of parities."""
    return {f: reduce(lambda x, y: x.bitwiseXOR(y), [F.col(w) for w in SKETCH[k :: len(FOLDED)]]) for k, f in enumerate(FOLDED)}


def _sketched(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (a, b) that whole sketches let link, with the documents of both; only sketches of points in pairs are shuffled."""
    pairs = _small(table(pairs.select("a", "b")))
    side = lambda k: _side(cells.select("point", "doc", "n", *SKETCH), k)
    return side("a").join(pairs, "a").join(side("b").join(pairs.select("b"), "b", "left_semi"), "b").where(_near(SKETCH))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the greater point first."""
    up = F.col("a") > F.col("b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(up, F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_a"), F.when(up, F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc_b"))


def boundary_rounds(docs: DataFrame, cells: DataFrame, members: DataFrame, label: DataFrame) -> DataFrame:
    """Labels after all linked pairs are connected that share a region and lie in different cells."""
    pivots, step = FIRST_PIVOTS, 0
    # Points meet with a folded sketch, as each one comes with all of its regions.
    own = cells.withColumns(folded()).select("point", "n", "last", "cell", *FOLDED)
    while True:
        labelled = _labelled(members, label)
        held = table(labelled.groupBy("region").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("region", "size"))
        # The weight of a point's regions from this one on, larger regions being later: a pair that meets first here shares at most that.
        every = Window.partitionBy("point")
        later = every.orderBy(F.desc("size"), F.desc("region")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        members = labelled.join(_small(held), "region")
        members = table(members.select("region", "point", "c", "weight", F.sum("weight").over(later).alias("reach"), F.sum(F.col("size") * F.col("weight")).over(every).alias("degree")))
        if members.isEmpty():
            return label
        drawn = table(_drawn(members, "region", -F.col("degree") if step == 0 else F.xxhash64("point", F.lit(-step)), step, pivots).distinct())
        some = _small(drawn)
        reached = members.drop("degree").join(own, "point")
        theirs = _small(table(members.drop("degree", "weight").join(some, "point", "left_semi").join(own, "point")), WIDE_ROWS)
        met = _pairs(reached, theirs, "region", (F.col("cell_a") != F.col("cell_b")) & (F.col("c_a") != F.col("c_b")) & _may_link("reach", FOLDED))
        # A linked pair meets at its first region within both points' reach; what the rows left out could add to its weight is bounded too.
        pairs = met.groupBy("a", "b").agg(F.max(_needed()).alias("needed"), F.sum("weight_a").alias("shared"), F.min(F.least("reach_a", "reach_b") - F.col("weight_a")).alias("left"))
        pairs = pairs.where(F.col("shared") + F.least(F.col("left"), F.col("needed") - 1) >= F.col("needed"))
        label = _joined(label, compare(docs, _ordered(_sketched(pairs, cells))))
        members = members.join(some, "point", "left_anti").select("region", "point", "weight")
        pivots *= PIVOT_GROWTH
        step += 1


def point_links(docs: DataFrame, sets: DataFrame, points: DataFrame) -> DataFrame:
    """Links (a, b) between points that connect whatever any links connect.

    The table of ``sets`` with their first shingles, much the largest, is removed as soon as the regions are written.
    """
    rows = points.agg(F.sum(F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + 1)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    where = table(regions(postings(sets, max(SALTS, parts)), parts))
    drop_table(sets)
    relieve(docs.sparkSession)
    members = table(where.groupBy("region", "point").agg(F.sum("weight").alias("weight")))
    sizes = _small(table(members.groupBy("region").agg(F.count(F.lit(1)).alias("size"))))
    own = members.join(sizes, "region").groupBy("point").agg(F.sum("weight").alias("weight"), F.sum(F.col("size") * F.col("weight")).alias("degree"))
    known = table(points.join(own, "point"))
    # A frequent shingle has a pivot for each salt; the least of them is the pivot of the region.
    hot = table(where.where("spread").select("region", "pivot", "pivot_n").distinct())
    head = hot.groupBy("region").agg(F.min(F.struct(F.xxhash64("pivot").alias("o"), "pivot", "pivot_n")).alias("h")).select("region", F.col("h.pivot").alias("b"), F.col("h.pivot_n").alias("n_b"))
    between = hot.join(head, "region").select(F.col("pivot").alias("a"), F.col("pivot_n").alias("n_a"), "b", "n_b").where(F.col("a") != F.col("b")).where(_fits("n_a", "n_b")).select("a", "b")
    votes = where.select(F.col("point").alias("a"), F.col("n").alias("n_a"), F.col("pivot").alias("b"), F.col("pivot_n").alias("n_b"), "weight").where(F.col("a") != F.col("b")).where(_fits("n_a", "n_b")).groupBy("a", "b").agg(F.sum("weight").alias("shared"))
    home = table(votes.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")))
    side = lambda k: _side(known.drop("degree"), k)
    asked = home.unionByName(between).distinct().join(side("a"), "a").join(side("b"), "b").where(_may_link("weight"))
    near = compare(docs, _ordered(asked))
    label = table(components(near.where("link").select("a", "b")).withColumnRenamed("v", "point"))
    relieve(docs.sparkSession)
    both = near.select("a", "b", "distance").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    homes = home.join(both, ["a", "b"], "left").select(F.col("a").alias("point"), F.col("b").alias("home"), "distance")
    # A point without a home is its own, at distance 0; one that can't link with its home isn't compared and has no distance.
    cell, distance = F.coalesce("home", "point"), F.when(F.col("home").isNull(), 0.0).otherwise(F.col("distance"))
    cells = table(known.join(homes, "point", "left").withColumns({"cell": cell, "distance": distance}).drop("home"))
    label = cell_rounds(docs, cells, label)
    label = boundary_rounds(docs, cells, members, label)
    return label.select(F.col("point").alias("a"), F.col("c").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs)
    relieve(docs.sparkSession)
    whole_sets = table(document_sets(docs, frequent))
    sets = table(whole_sets.select("doc_id", "n_shingles", "point"))
    known = F.col("doc_id").isNotNull() & F.col("point").isNotNull()
    named = sets.where(known)
    least = named.groupBy("point").agg(F.min("doc_id").alias("doc"))
    points = table(least.join(whole_sets.where(known).select(F.col("doc_id").alias("doc"), "point", F.col("n_shingles").cast("int").alias("n"), "last", *SKETCH), ["doc", "point"]).dropDuplicates(["point"]))
    links = point_links(docs, whole_sets, points)
    # An id with several texts ties their sets together.
    tied = named.groupBy("doc_id").agg(F.min("point").alias("a"), F.max("point").alias("b")).where("a <> b").select("a", "b")
    several = named.select("doc_id", "point").join(named.groupBy("doc_id").agg(F.min("point").alias("b"), F.max("point").alias("t")).where("b <> t").select("doc_id", "b"), "doc_id").select(F.col("point").alias("a"), "b").where("a <> b")
    label = components(links.unionByName(tied).unionByName(several))
    placed = points.join(label.withColumnsRenamed({"v": "point"}), "point", "left").withColumn("c", F.coalesce("c", "point"))
    first = placed.groupBy("c").agg(F.min("doc").alias("component_id"))
    whole = placed.join(first, "c").select("point", "component_id")
    return sets.select("doc_id", "n_shingles", "point").join(whole, "point", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of every component, with all columns; rows without id stay."""
    kept = classes(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
