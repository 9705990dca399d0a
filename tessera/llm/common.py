"""Pieces that several text operators share.

Every operator reads whole texts.  A word is a maximal run of bytes other than
space and 0x09-0x0D of the text with A-Z lower-cased: ``bytes.lower`` changes
ASCII letters only and ``bytes.split`` splits at exactly those six bytes, so no
pattern matching is needed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python; executors hold a few of them off their heaps.
BATCH_BYTES = 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session pass BATCH_BYTES, as rows of whole texts can be large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if given is None or int(given[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in order."""
    return text.lower().split()


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def texts(column) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def id_bucket(doc_id, buckets: int):
    """crc32 of an integer id's decimal text, modulo ``buckets`` (null ids: bucket of the empty text)."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % buckets for i in doc_id]


def crc_mod(column, buckets: int):
    """Column form of :func:`id_bucket`."""
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets).cast("int")


#: Rows of an Arrow batch that are handled at once, so that Python holds few whole texts.
PIECE_ROWS = 2_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of a task; after the last one, memory that is free goes back to the system.

    Worker processes outlive their tasks, and two of them share an executor's memory.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)
    batch = None
    settle()


def settle() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str | None, clear: Callable[[], None] | None = None) -> None:
    """Say which operator's memo this worker process may keep; the others' are cleared.

    Processes serve one stage after another, and a memo that only an earlier
    stage needed would take the later one's memory.
    """
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
    if owner is not None and clear is not None:
        _HELD[owner] = clear


def per_batch(df: DataFrame, make: Callable[[], Callable], schema, owner: str | None = None) -> DataFrame:
    """Map Arrow batches with a function that each task builds once.

    ``make()`` runs on the executor and returns ``f(batch) -> RecordBatch``, so
    models and tables are set up once per task instead of once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        f = make()
        for piece in pieces(batches):
            out = f(piece)
            if out is not None and out.num_rows:
                yield out
            out = None

    return df.mapInArrow(run, schema)


class TwoGenerationCache:
    """Bounded memo: new entries fill a young dict; when it is full it becomes the old one.

    An entry used at least once per ``size`` insertions survives, so frequent
    keys stay while memory is bounded by ``2 * size`` entries.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names; a folder of this machine only where Spark runs in this process alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return tempfile.gettempdir() + "/tessera-shared"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def relieve(spark: SparkSession, share: float = 0.0) -> None:
    """Let the driver forget the plans, broadcasts and shuffles that nothing refers to, if its heap has grown to a share of its most.

    Spark removes them, on executors and disks too, when the driver's JVM collects
    its garbage, which by itself it puts off until most of its heap is taken.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() >= share * heap.maxMemory():
        gc.collect()
        heap.gc()


_MADE: list[str] = []


def table(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Later jobs read the files, so nothing before them is run again, and the
    loss of an executor loses nothing.  :func:`scratch` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _MADE.append(path)
    relieve(spark, 0.5)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; frames that read it must be done."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(made: DataFrame) -> None:
    """Remove what :func:`table` has written; frames that read it must be done."""
    remove(made.sparkSession, made.written_to)
    _MADE.remove(made.written_to)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove, at the end, the tables that :func:`table` has written within; results must be written elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            remove(spark, path)
        del _MADE[before:]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator, elementwise on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, buckets: int, held_out: int, max_rows: int, max_bytes: int) -> DataFrame | None:
    """place, doc_id, y and text of the rows that a classifier is fitted on: a bounded random sample of labelled rows.

    Rows of the held-out fold (crc32 of the id modulo ``buckets``) never enter.
    Ids are drawn in the order of a hash, at most ``max_rows`` of them and as
    many as ``max_bytes`` of text allow; only ids and sizes reach the driver.
    Rows without id, text or label are left out; of several labels of one id the
    smallest counts, of several texts the greatest.  None if no row is left.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    drawn = known.where(crc_mod(F.col("doc_id"), buckets) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("place", F.xxhash64("doc_id"))
    ids = {r.doc_id: (r.place, r.y) for r in drawn.collect()}
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = lambda chosen: F.broadcast(spark.createDataFrame([(i, *ids[i]) for i in chosen], f"doc_id {kind}, place long, y int"))
    there = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = sorted((ids[r.doc_id][0], r.doc_id, r.size) for r in there.join(some(ids), "doc_id").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).collect()) if ids else []
    within, total = [], 0
    for _, i, size in sizes:
        if total + size <= max_bytes:
            total += size
            within.append(i)
    if not within:
        return None
    return there.join(some(within), "doc_id").groupBy("place", "doc_id", "y").agg(F.max("text").alias("text"))


class Model:
    """A fitted model as bytes: small on the driver, read once by each worker process that uses it."""

    def __init__(self, data: bytes):
        self.data, self.held = data, None

    def __getstate__(self):
        return {"data": self.data, "held": None}

    def get(self):
        if self.held is None:
            self.held = pickle.loads(self.data)
        return self.held


def fitted(sample: DataFrame | None, make: Callable) -> Model:
    """``make(raw texts, labels)`` of a bounded sample, run in one task of an executor; only the model comes to the driver.

    Rows are taken in the order of their places, so the model doesn't depend on
    how the documents are dealt, and a lost executor costs one more run.
    """

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), batch.column("y").to_pylist(), strict=True)
        rows.sort(key=lambda r: r[:2])
        raw, y = [r[2] for r in rows], np.array([r[3] for r in rows], dtype=int)
        rows.clear()
        data = pickle.dumps(make(raw, y), protocol=pickle.HIGHEST_PROTOCOL) if raw else None
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])

    if sample is not None:
        got = [bytes(r.model) for r in sample.repartition(1).mapInArrow(run, "model binary").where(F.col("model").isNotNull()).collect()]
        if got:
            return Model(got[0])
    return Model(pickle.dumps(make([], np.zeros(0, dtype=int))))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def scored(df: DataFrame, make_score, buckets: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; ``make_score()`` gives a function of raw texts."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def make():
        score = make_score()

        def one(batch):
            s = np.clip(np.asarray(score(raw_texts(batch.column("text"))), dtype=float), 0.0, 1.0)
            out = [k == held_out for k in id_bucket(batch.column("doc_id").to_pylist(), buckets)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return one

    return per_batch(df.select("doc_id", "text"), make, f"doc_id {kind}, held_out boolean, score double, predicted int")
