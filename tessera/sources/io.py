"""Matrices, labels, priors and results as files."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import means, pair_moments


def read_matrix(spark: SparkSession, path: str, dim: int = 1) -> DataFrame:
    """row_id, col_id, x from a comma-separated matrix with a header line.

    Cells are numbers, or ``dim`` numbers joined by colons.  Lines are read by
    all executors; rows are numbered in file order by counting the lines of each
    part of the file first.  A cell that is no number fails the query.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    counted = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    offsets, before = [], 0
    for r in sorted(counted.collect(), key=lambda r: (r.file, r.start)):
        offsets.append((r.file, r.start, before, r.first))
        before += r.n
    if not offsets:
        return spark.createDataFrame([], "row_id long, col_id int, x " + ("double" if dim == 1 else "array<double>"))
    table = F.broadcast(spark.createDataFrame(offsets, "file string, start long, before long, first long"))
    rows = lines.join(table, ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") - 1).alias("row_id"), "value").where("row_id >= 0")
    cells = rows.select("row_id", F.posexplode(F.split("value", ",")).alias("col_id", "cell"))
    if dim == 1:
        return cells.select("row_id", "col_id", F.trim("cell").cast("double").alias("x"))
    parts = F.transform(F.split("cell", ":"), lambda c: F.trim(c).cast("double"))
    whole = F.when(F.size(parts) == dim, parts).otherwise(F.raise_error(F.lit(f"a cell hasn't {dim} components")))
    return cells.select("row_id", "col_id", whole.alias("x"))


def write_matrix(cells: DataFrame, path: str) -> None:
    """A matrix as one comma-separated line a row, in row order, with a header of column numbers; vectors joined by colons."""
    kind = cells.schema["x"].dataType.typeName()
    shown = F.concat_ws(":", F.transform("x", lambda v: v.cast("string"))) if kind == "array" else F.col("x").cast("string")
    lines = cells.groupBy("row_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_id", shown.alias("v")))), lambda c: c["v"]), ",").alias("value"))
    header = cells.select("col_id").distinct().agg(F.array_join(F.transform(F.sort_array(F.collect_list("col_id")), lambda c: c.cast("string")), ",").alias("value")).select(F.lit(-1).cast("long").alias("row_id"), "value")
    header.unionByName(lines.select("row_id", "value")).orderBy("row_id").select("value").write.mode("overwrite").text(path)


def read_info(spark: SparkSession, path: str) -> dict:
    """True block, row and column labels (DataFrames) and the prior's location and scale from a JSON description."""
    numbers = "array<double>"
    row = spark.read.schema(f"blockPartition {numbers}, rowPartition {numbers}, colPartition {numbers}, empiricalMean {numbers}, empiricalCovariance {numbers}").json(path, multiLine=True)

    def labels(column: str, index: str, label: str) -> DataFrame:
        return row.select(F.posexplode(column).alias(index, label)).select(F.col(index).cast("long").alias(index), F.col(label).cast("long").alias(label))

    prior = row.select("empiricalMean", "empiricalCovariance").first()
    return {"blocks": labels("blockPartition", "position", "block_id"), "rows": labels("rowPartition", "row_id", "k"), "columns": labels("colPartition", "col_id", "l"), "mean": prior.empiricalMean, "scale": prior.empiricalCovariance}


def write_labels(row_labels: DataFrame, col_labels: DataFrame, path: str) -> None:
    row_labels.write.mode("overwrite").parquet(f"{path}/row_labels")
    col_labels.write.mode("overwrite").parquet(f"{path}/col_labels")


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small value as one line of JSON."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_results(spark: SparkSession, path: str, summary: dict) -> None:
    """Scores and runtime as one JSON record."""
    write_json(spark, path, summary)


def write_prior(cells: DataFrame, path: str, name: str | None = None) -> None:
    """Mean (a list) and inverse covariance (a list of rows) of all cells as JSON; cells are numbers or vectors of one dimension.

    One record at ``path``; with the name of a data set, two: ``global_mean_NAME.json``
    and ``global_precision_NAME.json`` below ``path``, the name up to its first dot.
    """
    x = F.col("x") if cells.schema["x"].dataType.typeName() == "array" else F.array("x")
    vectors = cells.select(x.cast("array<double>").alias("x")).where(F.col("x")[0].isNotNull())
    d = vectors.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        raise ValueError("the matrix has no cells")
    mean = means(vectors, "x", d)
    scatter, n = np.zeros((d, d)), 0
    for r in pair_moments(vectors, "x", d).collect():
        scatter[r.i, r.j], n = r.s, r.n
    precision = np.linalg.inv(scatter / (n - 1)).tolist()
    if name is None:
        write_json(cells.sparkSession, path, {"mean": mean, "precision": precision})
        return
    stem = name.split(".")[0]
    write_json(cells.sparkSession, f"{path}/global_mean_{stem}.json", mean)
    write_json(cells.sparkSession, f"{path}/global_precision_{stem}.json", precision)


def show_time(began: float, step: str) -> float:
    """Print the seconds since ``began`` (``time.perf_counter``) under the step's name; return the time now."""
    now = time.perf_counter()
    print(f"{step}: {now - began:.3f} s")
    return now


def show_scores(ari: float, nmi: float, n_clusters: int, runtime: float) -> str:
    return f"Runtime: {runtime:.3f} s\nARI: {ari:.4f}\nNMI: {nmi:.4f}\nNumber of blocks: {n_clusters}"
