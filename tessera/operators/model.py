"""Co-clustering by distributed Gibbs sampling.

Rows are packed and dealt to workers once, and kept by worker (persisted, so
that no sweep shuffles them; a lost executor's part is read again).  One
iteration is one job: every worker sweeps its own rows, from the labels that it
wrote last, and writes its new local labels beside its clusters' statistics to
the shared folder.  The driver reads the statistics only, folds the local
clusters into global ones and sweeps the columns.  What reaches the driver is a
row for every worker's cluster, of columns x (d + d*d) numbers: its size depends
on the clusters and the columns, never on the rows.  Labels that the next
iteration has replaced are removed.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.niw import Niw
from . import gibbs
from .labels import require, worker_of


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names; a folder of this machine only where Spark runs in this process alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return tempfile.gettempdir() + "/tessera-shared"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove what a finished step has written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Fitted:
    """row_labels (row_id, k) and col_labels (col_id, l) as DataFrames, the number of clusters, and the seconds taken."""

    row_labels: DataFrame
    col_labels: DataFrame
    n_row_clusters: int
    n_col_clusters: int
    runtime: float
    history: list[dict]


class BlockMixture:
    """Bayesian non-parametric co-clustering of a matrix of scalar or vector cells.

    alpha and beta are the concentrations of the row and column partitions.
    ``prior`` is a distribution, or how to make one from the data ("precision",
    "covariance", "scatter_precision").  ``merge_space`` says what local row
    clusters are merged by: the rows' means ("row_mean") or their cells per column
    cluster ("block").  ``compat`` takes over the known quirks of the published
    algorithm: one sweep fewer, posterior parameters merged as statistics, and
    columns scored against clusters that hold them.
    """

    def __init__(self, alpha: float = 5.0, beta: float = 2.0, prior: Niw | str = "precision", seed: int = 0, workers: int = 4, local_sweeps: int = 1, merge_space: str = "block", compat: bool = False):
        require(alpha > 0 and beta > 0, "alpha and beta must be positive")
        require(merge_space in ("row_mean", "block"), "merge_space must be row_mean or block")
        self.alpha, self.beta, self.prior, self.seed, self.workers = alpha, beta, prior, seed, workers
        self.local_sweeps, self.merge_space, self.compat = local_sweeps, merge_space, compat

    # -- input ----------------------------------------------------------------

    @staticmethod
    def _vectors(cells: DataFrame) -> DataFrame:
        kind = cells.schema["x"].dataType
        x = F.col("x") if isinstance(kind, T.ArrayType) else F.array("x")
        return cells.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), x.cast("array<double>").alias("x"))

    @staticmethod
    def _packed(cells: DataFrame, path: str) -> DataFrame:
        """row_id and its cells in column order as bytes, written once."""
        rows = cells.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_id", "x"))), lambda c: c["x"]).alias("xs"))

        def pack(batches):
            for batch in batches:
                given = batch.column("xs")
                flat = given.flatten().flatten().to_numpy(zero_copy_only=False)
                each = len(flat) // max(1, len(given))
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([flat[i * each : (i + 1) * each].tobytes() for i in range(len(given))], pa.binary())], names=["row_id", "xs"])

        rows.mapInArrow(pack, "row_id long, xs binary").write.parquet(path)
        return cells.sparkSession.read.parquet(path)

    @staticmethod
    def _dealt(rows: DataFrame, workers: int, n: int) -> DataFrame:
        """Rows by worker; ids are ranked so that gaps between them don't matter."""
        # Ranks by range: ids are cut into ranges, counted, and numbered within each.
        bounds = rows.stat.approxQuantile("row_id", [i / (4 * workers) for i in range(1, 4 * workers)], 0.01)
        part = F.lit(0)
        for b in sorted(set(bounds)):
            part = part + F.when(F.col("row_id") > b, 1).otherwise(0)
        ids = rows.select("row_id", part.alias("_part"))
        before, offsets = 0, {}
        for r in sorted(ids.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
            offsets[r["_part"]] = before
            before += r["count"]
        place = F.row_number().over(Window.partitionBy("_part").orderBy("row_id")) - 1 + F.element_at(F.create_map(*(F.lit(v) for kv in offsets.items() for v in kv)), F.col("_part"))
        worker = worker_of(place.cast("long"), n, workers).alias("worker_id")
        return rows.join(ids.select("row_id", worker), "row_id").select("worker_id", "row_id", "xs").repartition(workers, "worker_id")

    # -- one iteration ----------------------------------------------------------

    def _sweep(self, dealt: DataFrame, last: DataFrame, state: gibbs.State, mapping: dict, prior: Niw, step: int, sweeps: int, path: str) -> tuple[list, gibbs.Stats, gibbs.Stats]:
        """Write the new local labels (row_id, local_k) of every worker and its clusters' statistics; return the latter.

        ``last`` has the labels before, which ``mapping`` (worker, local_k) makes
        global.  The result is the clusters (worker, local_k, rows) in order, their
        statistics by column, and those of their rows' means.
        """
        spark = dealt.sparkSession
        shipped = spark.sparkContext.broadcast((state, prior, mapping))
        alpha, seed, d = self.alpha, self.seed, prior.d

        def run(mine: pa.Table, before: pa.Table) -> pa.Table:
            now, base, of = shipped.value
            worker = mine.column("worker_id")[0].as_py()
            ids = mine.column("row_id").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            held = mine.column("xs").to_pylist()
            x = np.frombuffer(b"".join([held[i] for i in order]), dtype=np.float64).reshape(len(ids), -1, d)
            old = np.zeros(len(ids), dtype=np.int64)
            if before.num_rows:
                k, at = before.column("local_k").to_numpy(), before.column("row_id").to_numpy()
                old[np.searchsorted(ids, at)] = [of[worker, int(i)] for i in k] if of else k
            present, local = np.unique(old, return_inverse=True)
            n_cols = int(now.col_labels.max()) + 1
            own = gibbs.cell_stats(x, now.col_labels, n_cols)
            if now.grid is None:
                outside = gibbs.Stats.zeros((n_cols, len(present)), d)
            else:
                outside = gibbs.Stats(now.grid.n[:, present].copy(), now.grid.total[:, present].copy(), now.grid.square[:, present].copy())
                for r, k in enumerate(local):
                    outside.add((slice(None), k), own[r], -1)
            new = gibbs.row_sweep(x, ids.tolist(), local, now.col_labels, base, alpha, outside, f"{seed}|{step}", sweeps) if sweeps else local
            hot = np.eye(int(new.max()) + 1)[new]
            mean = x.mean(axis=1)
            parts = (np.einsum("rpd,rk->kpd", x, hot), np.einsum("rpd,rpe,rk->kpde", x, x, hot, optimize=True), np.einsum("rd,rk->kd", mean, hot), np.einsum("rd,re,rk->kde", mean, mean, hot, optimize=True))
            clusters = hot.shape[1]
            stats = [b"".join(np.ascontiguousarray(p[k]).tobytes() for p in parts) for k in range(clusters)]
            names = present[new] if not sweeps else new
            by_cluster = [int(present[k]) if not sweeps else k for k in range(clusters)]
            return pa.table([
                pa.array([worker] * (len(ids) + clusters), pa.int64()),
                pa.array([*ids.tolist(), *[None] * clusters], pa.int64()),
                pa.array([*names.tolist(), *by_cluster], pa.int64()),
                pa.array([*[None] * len(ids), *hot.sum(axis=0).tolist()], pa.float64()),
                pa.array([*[None] * len(ids), *stats], pa.binary()),
            ], names=["worker_id", "row_id", "local_k", "n", "stats"])

        made = dealt.groupBy("worker_id").cogroup(last.groupBy("worker_id")).applyInArrow(run, "worker_id long, row_id long, local_k long, n double, stats binary")
        made.write.parquet(path)
        found = sorted(spark.read.parquet(path).where("row_id IS NULL").collect(), key=lambda r: (r.worker_id, r.local_k))
        p = len(state.col_labels)
        flat = np.array([np.frombuffer(r.stats, dtype=np.float64) for r in found])
        n = np.array([r.n for r in found])
        cuts = np.cumsum([p * d, p * d * d, d])
        total, square, mean, mean_square = np.split(flat, cuts, axis=1)
        by_column = gibbs.Stats(np.repeat(n[:, None], p, axis=1), total.reshape(-1, p, d), square.reshape(-1, p, d, d))
        return [(int(r.worker_id), int(r.local_k), float(r.n)) for r in found], by_column, gibbs.Stats(n, mean, mean_square.reshape(-1, d, d))

    # -- the loop ---------------------------------------------------------------

    def fit(self, cells: DataFrame, max_iter: int = 10, row_labels: DataFrame | None = None, col_labels: DataFrame | None = None, tell=None) -> Fitted:
        """Fit from cells (row_id, col_id, x), with x a double or an array of doubles; the matrix must be dense.

        ``tell(began, step)`` hears of every iteration of several workers, as ``sources.io.show_time`` does.
        """
        began = time.perf_counter()
        spark = cells.sparkSession
        cells = self._vectors(cells)
        first = cells.agg(F.countDistinct("row_id").alias("n"), F.countDistinct("col_id").alias("p"), F.max("col_id").alias("last"), F.count(F.lit(1)).alias("cells"), F.min(F.size("x")).alias("d"), F.max(F.size("x")).alias("d_most")).first()
        require(first.n > 0, "the matrix has no cells")
        require(first.d == first.d_most, "cells differ in their dimension")
        require(first.p == first.last + 1 and first.cells == first.n * first.p, "the matrix must be dense, with columns numbered from 0")
        n, p, d = int(first.n), int(first.p), int(first.d)
        prior = self._prior(cells, d)
        workers = max(1, min(self.workers, n))
        columns = np.zeros(p, dtype=int)
        if col_labels is not None:
            given = col_labels.toPandas().sort_values("col_id")
            require(len(given) == p, "the initial column partition must label every column")
            columns = np.unique(given["l"].to_numpy(), return_inverse=True)[1]
        folder = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}/fit-{uuid.uuid4().hex}"
        total = max(1, max_iter - 1) if self.compat else max_iter
        rows = self._packed(cells, f"{folder}/rows")
        if workers == 1 and row_labels is None:
            return self._fit_in_one_task(rows, columns, prior, total, folder, began)
        dealt = self._dealt(rows, workers, n).persist()
        try:
            return self._iterated(dealt, row_labels, columns, prior, n, total, folder, began, tell)
        finally:
            dealt.unpersist()
            remove_folder(spark, f"{folder}/rows")

    def _iterated(self, dealt: DataFrame, row_labels: DataFrame | None, columns: np.ndarray, prior: Niw, n: int, total: int, folder: str, began: float, tell=None) -> Fitted:
        spark, d = dealt.sparkSession, prior.d
        schema = "worker_id long, row_id long, local_k long"
        state, mapping, path = gibbs.State(columns, 1, None), {}, None
        last = spark.createDataFrame([], schema)
        if row_labels is not None:
            require(row_labels.select("row_id").distinct().count() == n, "the initial row partition must label every row")
            given = row_labels.select(F.col("row_id").cast("long").alias("row_id"), F.col("k").cast("long").alias("local_k"))
            dealt.select("worker_id", "row_id").join(given, "row_id").select("worker_id", "row_id", "local_k").write.parquet(f"{folder}/labels-given")
            last, path = spark.read.schema(schema).parquet(f"{folder}/labels-given"), f"{folder}/given"
            clusters, by_column, _ = self._sweep(dealt, last, state, mapping, prior, 0, 0, path)
            n_k = max(k for _, k, _ in clusters) + 1
            require(len({k for _, k, _ in clusters}) == n_k, "row labels must be numbered from 0 without gaps")
            state = gibbs.State(columns, n_k, self._grid(by_column, [k for _, k, _ in clusters], n_k, columns, d)[0])
        history: list[dict] = []
        clock = time.perf_counter()
        for step in range(total):
            if path is not None:
                last = spark.read.schema(schema).parquet(path).where("row_id IS NOT NULL")
            before, path = path, f"{folder}/local-{step}"
            clusters, by_column, means = self._sweep(dealt, last, state, mapping, prior, step, self.local_sweeps, path)
            if before is not None:
                remove_folder(spark, before)
            summary = means if self.merge_space == "row_mean" else self._over_columns(by_column, state.col_labels)
            order = [(w, k, size, summary[i]) for i, (w, k, size) in enumerate(clusters)]
            merged = gibbs.merge_fold(order, prior, self.alpha, f"{self.seed}|{step}", self.compat)
            n_k = max(merged) + 1
            _, per_column = self._grid(by_column, merged, n_k, state.col_labels, d)
            columns = gibbs.column_sweep(per_column, state.col_labels, prior, self.beta, f"{self.seed}|{step}", self.compat)
            grid, _ = self._grid(by_column, merged, n_k, columns, d)
            state = gibbs.State(columns, n_k, grid)
            mapping = {(w, k): g for (w, k, _), g in zip(clusters, merged, strict=True)}
            history.append({"iteration": step + 1, "row_clusters": n_k, "col_clusters": int(columns.max()) + 1})
            if tell is not None:
                clock = tell(clock, f"iteration {step + 1}")
        named = spark.createDataFrame([(w, k, g) for (w, k), g in mapping.items()], "worker_id long, local_k long, k long")
        spark.read.schema(schema).parquet(path).where("row_id IS NOT NULL").join(F.broadcast(named), ["worker_id", "local_k"]).select("row_id", "k").write.parquet(f"{folder}/labels")
        remove_folder(spark, path)
        final = spark.createDataFrame([(j, int(l)) for j, l in enumerate(state.col_labels)], "col_id int, l long")
        return Fitted(spark.read.schema("row_id long, k long").parquet(f"{folder}/labels"), final, state.n_row_clusters, int(state.col_labels.max()) + 1, time.perf_counter() - began, history)

    @staticmethod
    def _grid(by_column: gibbs.Stats, labels: list[int], n_k: int, columns: np.ndarray, d: int) -> tuple[gibbs.Stats, gibbs.Stats]:
        """Statistics by column cluster and row cluster, and by column and row cluster, of local clusters with their global labels."""
        hot = np.eye(n_k)[labels]
        per_column = gibbs.Stats(by_column.n.T @ hot, np.einsum("cpd,ck->pkd", by_column.total, hot), np.einsum("cpde,ck->pkde", by_column.square, hot))
        over = np.eye(int(columns.max()) + 1)[columns]
        return gibbs.Stats(over.T @ per_column.n, np.einsum("pkd,pl->lkd", per_column.total, over), np.einsum("pkde,pl->lkde", per_column.square, over)), per_column

    def _fit_in_one_task(self, rows: DataFrame, columns: np.ndarray, prior: Niw, total: int, folder: str, began: float) -> Fitted:
        """All iterations in the task of the only worker: local clusters are the global ones and nothing is merged.

        One worker holds the whole matrix, whatever its size: choose more where it doesn't fit a task.
        """
        spark = rows.sparkSession
        alpha, beta, seed, sweeps, compat, d = self.alpha, self.beta, self.seed, self.local_sweeps, self.compat, prior.d

        def chain(batches):
            ids, held = [], []
            for batch in batches:
                ids += batch.column("row_id").to_pylist()
                held += batch.column("xs").to_pylist()
            order = np.argsort(ids)
            ids = [ids[i] for i in order]
            x = np.frombuffer(b"".join([held[i] for i in order]), dtype=np.float64).reshape(len(ids), -1, d)
            held.clear()
            found, cols, counts = gibbs.chain(x, ids, columns, prior, alpha, beta, seed, total, sweeps, compat)
            for axis, at, label in (("row", ids, found), ("col", range(len(cols)), cols), ("step", [a * 1_000_000 + b for a, b in counts], range(len(counts)))):
                yield pa.RecordBatch.from_arrays([pa.array([axis] * len(at)), pa.array(list(at), pa.int64()), pa.array(list(label), pa.int64())], names=["axis", "id", "label"])

        rows.repartition(1).mapInArrow(chain, "axis string, id long, label long").write.parquet(f"{folder}/chain")
        remove_folder(spark, f"{folder}/rows")
        done = spark.read.parquet(f"{folder}/chain")
        steps = sorted((r.label, r.id) for r in done.where("axis = 'step'").collect())
        history = [{"iteration": int(i) + 1, "row_clusters": int(v // 1_000_000), "col_clusters": int(v % 1_000_000)} for i, v in steps]
        found = done.where("axis = 'row'").select(F.col("id").alias("row_id"), F.col("label").alias("k"))
        cols = done.where("axis = 'col'").select(F.col("id").cast("int").alias("col_id"), F.col("label").alias("l"))
        return Fitted(found, cols, history[-1]["row_clusters"], history[-1]["col_clusters"], time.perf_counter() - began, history)

    @staticmethod
    def _over_columns(by_cluster: gibbs.Stats, col_labels: np.ndarray) -> gibbs.Stats:
        hot = np.eye(int(col_labels.max()) + 1)[col_labels]
        return gibbs.Stats(by_cluster.n @ hot, np.einsum("cpd,pl->cld", by_cluster.total, hot), np.einsum("cpde,pl->clde", by_cluster.square, hot))

    def _prior(self, cells: DataFrame, d: int) -> Niw:
        if isinstance(self.prior, Niw):
            require(self.prior.d == d, "prior and data differ in their dimension")
            return self.prior
        from .stats import vector_moments

        row = cells.agg(*vector_moments("x", d)).first()
        return Niw.from_moments(row.n, np.array(row.mean), np.array(row.s), self.prior)
