"""Benchmark leaks by template windows.

Texts are read as templates: numbers, units and names become typed
placeholders, other words are lower-cased without the marks around them.  A name
is a capitalised word that doesn't begin a sentence.  Windows of ``WINDOW``
template words (the whole of a shorter item) are hashed; windows of a document
and of a benchmark item with equal hashes are joined.  Along one alignment of a
document and an item every value of a placeholder in the item must stand against
one value in the document: then the passage is the item, word by word or with
other parameters.  If a value stands against itself and, elsewhere, against
others, the passage is a copy changed in places, and only the windows with these
places are left out; an alignment with a value that stands against different
ones but never against itself is contradictory and left out.

An item leaks into a document if such alignments cover at least ``COVERAGE`` of
its windows, or if any alignment has ``VERBATIM`` neighbouring words of the item
word by word.  Windows need ``LITERALS`` literal words, or half
their words where they are shorter, so lists of names or numbers match nothing.

The windows of the benchmark are made once and written.  Their hashes sift the
documents' windows on the executors as long as they fit ``SIFT_BYTES``; a larger
benchmark skips the sift and all windows go through the same join by shuffle.
The windows with their values are broadcast as long as they fit
``BROADCAST_BYTES``; larger ones are joined by shuffle.

Defined results: null and empty texts and items leak nothing; equal pairs come
once; rows of one doc_id count as one document, those without doc_id as one
without a name, which :func:`clean` keeps; items of one item_id, or without one,
count as one item; whole texts are read.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, per_batch, table, texts

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
VERBATIM = 20
SIFT_BYTES, BROADCAST_BYTES = 16_000_000, 16_000_000
MEMO_WORDS = 400_000
#: Characters of the texts that are read at once.
BLOCK_CHARS = 1_000_000

# Words for numbers and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice".split())
UNIT_WORDS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh".split())
_NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|k)?%?")
_EDGE = ".,;:!?\"'()[]{}<>*_`|%#&…«»“”‘’"
LITERAL, NUMBER, UNIT, NAME = range(4)
_KIND_HASH = np.array([xxhash.xxh3_64_intdigest(f"\0{k}".encode()) for k in range(4)], dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], dtype=np.uint64)
Slots = list


class _Index(dict):
    """Numbers of words; a new word is learnt when it is asked for.  It doesn't hold its reader, which goes with its task."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> int:
        return self.learn()(word)


class Templates:
    """Words to template symbols, with a bounded memo."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.index = _Index(weakref.WeakMethod(self._learn))
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.ends: list[bool] = []
        self.tables = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=bool))

    def _learn(self, word: str) -> int:
        if word.islower() and word.isalpha():  # as most words: no marks, no digits, no capitals
            low, ends = word, False
            kind = NUMBER if word in NUMBER_WORDS else UNIT if word in UNIT_WORDS else LITERAL
        else:
            core = word.strip(_EDGE)
            low = core.lower()
            if _NUMBER.fullmatch(core) or low in NUMBER_WORDS:
                kind = NUMBER
            elif low in UNIT_WORDS:
                kind = UNIT
            else:
                kind = NAME if core[:1].isupper() and core[1:] == low[1:] and len(core) > 1 else LITERAL
            ends = word.rstrip("\"')]*_”’»")[-1:] in (".", "!", "?", ":", "|") or not core
        self.index[word] = k = len(self.index)
        self.hashes.append(xxhash.xxh3_64_intdigest(low.encode()))
        self.kinds.append(kind)
        self.ends.append(ends)
        return k

    def read_many(self, block: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, symbol hashes and kinds of some texts, one after the other, and where each one begins, with the end.

        What new words add to the tables is appended once a block, as that copies them.
        """
        split = [t.split() for t in block]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)])
        words = split[0] if len(split) == 1 else list(chain.from_iterable(split))
        if len(self.index) > MEMO_WORDS:
            self._reset()
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        if self.hashes:
            new = (np.array(self.hashes, dtype=np.uint64), np.array(self.kinds, dtype=np.int8), np.array(self.ends, dtype=bool))
            self.tables = tuple(np.concatenate(p) for p in zip(self.tables, new, strict=True))
            self.hashes, self.kinds, self.ends = [], [], []
        kinds = self.tables[1][at]
        if len(at):
            begins = np.concatenate([[True], self.tables[2][at[:-1]]])
            begins[bounds[:-1][bounds[:-1] < len(at)]] = True
            kinds = np.where((kinds == NAME) & begins, LITERAL, kinds)
        return words, np.where(kinds == LITERAL, self.tables[0][at], _KIND_HASH[kinds]), kinds, bounds

    def read(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, symbol hashes and kinds."""
        return self.read_many([text])[:3]


def blocks(held: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about BLOCK_CHARS, with the place of the first one."""
    at, size = 0, 0
    for k, text in enumerate(held):
        if size and size + len(text) > BLOCK_CHARS:
            yield at, held[at:k]
            at, size = k, 0
        size += len(text)
    if at < len(held):
        yield at, held[at:]


def window_hashes(symbols: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of every window with enough literal words."""
    n = len(symbols) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += symbols[k : k + n] * _POWERS[k]
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    enough = literal[size:] - literal[:-size] >= min(LITERALS, (size + 1) // 2)
    return np.flatnonzero(enough), mix64(total[enough] + np.uint64(size))


def _slots(words: list[str], kinds: np.ndarray, begin: int, size: int) -> Slots:
    return [f"{kinds[i]}{words[i].strip(_EDGE).lower()}" for i in range(begin, begin + size) if kinds[i] != LITERAL]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, item_pos, total windows, size and slot values of every benchmark window."""

    def make():
        reader = Templates()

        def one(batch):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                words, symbols, kinds = reader.read(text)
                size = min(WINDOW, len(words))
                begins, hashes = window_hashes(symbols, kinds, size)
                rows += [(h, item, b, len(begins), size, _slots(words, kinds, b, size)) for b, h in zip(begins.tolist(), hashes.astype(np.int64).tolist(), strict=True)]
            if not rows:
                return None
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.list_(pa.string()))], names=["hash", "item_id", "item_pos", "item_windows", "size", "item_slots"])

        return one

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return per_batch(plain, make, "hash long, item_id long, item_pos long, item_windows long, size int, item_slots array<string>")


def document_windows(docs: DataFrame, sizes: list[int], sift: np.ndarray | None) -> DataFrame:
    """hash, doc_id, doc_pos and slot values of the documents' windows; with a sift only of those in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(None if sift is None else np.sort(sift.astype(np.uint64)))

    def make():
        reader, wanted = Templates(), held.value
        if wanted is not None:
            marked = np.zeros(1 << 22, dtype=bool)
            marked[(wanted >> np.uint64(42)).astype(np.int64)] = True

        def one(batch):
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for place, block in blocks(texts(batch.column("text"))):
                words, symbols, kinds, bounds = reader.read_many(block)
                for size in sizes:
                    begins, hashes = window_hashes(symbols, kinds, size)
                    if wanted is not None and len(begins):
                        near = marked[(hashes >> np.uint64(42)).astype(np.int64)]
                        begins, hashes = begins[near], hashes[near]
                        if len(begins):
                            near = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
                            begins, hashes = begins[near], hashes[near]
                    of = np.searchsorted(bounds, begins, side="right") - 1
                    within = begins + size <= bounds[of + 1]  # no window holds words of two texts
                    begins, hashes, of = begins[within], hashes[within], of[within]
                    rows += [(h, ids[place + k], b - first, _slots(words, kinds, b, size)) for b, h, k, first in zip(begins.tolist(), hashes.astype(np.int64).tolist(), of.tolist(), bounds[of].tolist(), strict=True)]
            if not rows:
                return None
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.column("doc_id").type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], names=["hash", "doc_id", "doc_pos", "doc_slots"])

        return one

    return per_batch(docs.select("doc_id", "text"), make, f"hash long, doc_id {kind}, doc_pos long, doc_slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, sift_bytes: int = SIFT_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and an item that leaks into it: doc_id, item_id, n_windows, item_windows, coverage, reworded."""
    bench = table(benchmark_windows(benchmark))
    hashes = bench.select("hash").distinct()
    held = F.lit(40) + F.aggregate("item_slots", F.lit(0), lambda a, v: a + F.octet_length(v) + 16)
    measured = bench.agg(F.countDistinct("hash").alias("n"), F.coalesce(F.sum(held), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    sift = hashes.toArrow().column("hash").to_numpy() if 8 * measured.n <= sift_bytes else None
    windows = document_windows(docs, sorted(measured.sizes), sift)
    joined = windows.join(F.broadcast(bench) if measured.bytes <= broadcast_bytes else bench, "hash")
    pair = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.struct(s["item_slots"].alias("i"), s["doc_slots"].alias("d")))
    runs = (
        joined.where(F.size("item_slots") == F.size("doc_slots"))
        .groupBy("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift"))
        .agg(F.first("item_windows").alias("item_windows"), F.sort_array(F.collect_set(F.struct("item_pos", "size", pair.alias("pairs")))).alias("windows"))
        .withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
    )
    own = lambda p: p["i"] == p["d"]
    other = lambda p: F.exists("pairs", lambda o: (o["i"] == p["i"]) & (o["d"] != p["d"]))
    kept_own = lambda p: F.exists("pairs", lambda o: (o["i"] == p["i"]) & own(o))
    runs = runs.withColumn("odd", F.filter("pairs", lambda p: ~own(p) & other(p)))
    contradictory = F.exists("odd", lambda p: ~kept_own(p))
    consistent = F.filter("windows", lambda w: ~contradictory & ~F.arrays_overlap(w["pairs"], F.col("odd")))
    # Windows that overlap or touch make one verbatim stretch.
    start = F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("longest"))

    def further(held, w):
        begin = F.when(w["item_pos"] <= held["end"], held["begin"]).otherwise(w["item_pos"])
        end = w["item_pos"] + w["size"]
        return F.struct(begin.alias("begin"), end.alias("end"), F.greatest(held["longest"], end - begin).alias("longest"))

    runs = runs.withColumns({"consistent": consistent, "same": F.filter("windows", lambda w: F.forall(w["pairs"], own))})
    runs = runs.withColumn("verbatim", F.aggregate("same", start, further)["longest"])
    runs = runs.withColumn("counted", F.when(F.col("verbatim") >= VERBATIM, F.array_union("consistent", "same")).otherwise(F.col("consistent")))
    whole = (
        runs.where(F.size("counted") > 0)
        .groupBy("doc_id", "item_id")
        .agg(
            F.first("item_windows").alias("item_windows"),
            F.size(F.array_distinct(F.flatten(F.collect_list("counted.item_pos")))).cast("long").alias("n_windows"),
            F.max(F.exists(F.flatten("counted.pairs"), lambda p: p["i"] != p["d"])).alias("reworded"),
            F.max("verbatim").alias("verbatim"),
        )
    )
    share = F.col("n_windows") / F.col("item_windows")
    leaked = whole.where((share >= COVERAGE) | (F.col("verbatim") >= VERBATIM))
    return leaked.select("doc_id", "item_id", "n_windows", "item_windows", share.alias("coverage"), "reworded")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaks, with all their columns; documents without id stay."""
    leaked = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
