"""Partitions as tables: dealing rows to workers, relabelling, joining labels, numbering blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worker_of(row_id: Column, n_rows: int | Column, workers: int) -> Column:
    """Contiguous slices: worker w holds rows floor(w*n/workers) to floor((w+1)*n/workers) - 1."""
    return F.floor(((row_id + 1) * workers - 1) / n_rows).cast("long")


def collapsed(rows: DataFrame, key: str = "worker_id", row: str = "row_id") -> DataFrame:
    """One record per worker with its rows in order; for small tables only, as a worker's rows meet in one task."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def dense(df: DataFrame, keys: list[str], label: str, out: str = "dense") -> DataFrame:
    """Labels numbered from 0 in their order within each key.

    Distinct labels are ranked and joined back: the window holds labels, not rows.
    """
    distinct = df.select(*keys, label).distinct()
    place = Window.partitionBy(*keys).orderBy(label) if keys else Window.orderBy(label)
    ranked = distinct.withColumn(out, (F.dense_rank().over(place) - 1).cast("long"))
    return df.join(ranked, [*keys, label])


def compacted(label: Column, removed: Column | int) -> Column:
    """Labels after the removal of one: higher ones move down."""
    return F.when(label > removed, label - 1).otherwise(label)


def counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def cluster_map(local: DataFrame, assigned: DataFrame) -> DataFrame:
    """worker_id, local_k, global_k from the local clusters and the global ones in the same order of merging."""
    return local.join(assigned, ["worker_id", "local_k"]).select("worker_id", "local_k", "global_k")


def to_global(local_labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """row_id, global_k, local_k per worker."""
    return local_labels.join(mapping, ["worker_id", "local_k"]).select("worker_id", "row_id", "global_k", "local_k")


def absent(clusters: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters without a row."""
    return clusters.join(labels.select(*keys).distinct(), keys, "left_anti")


def blocks_first_seen(row_labels: DataFrame, col_labels: DataFrame) -> DataFrame:
    """Block of every cell, numbered by first appearance in column-major order.

    A block first appears in the first column of its column cluster at the first
    row of its row cluster, so numbers come from the small tables of clusters.
    """
    k = row_labels.groupBy("k").agg(F.min("row_id").alias("_row"))
    l = col_labels.groupBy("l").agg(F.min("col_id").alias("_col"))  # noqa: E741
    order = Window.orderBy("_col", "_row")
    numbered = k.crossJoin(l).withColumn("block_id", (F.row_number().over(order) - 1).cast("long")).select("k", "l", "block_id")
    return row_labels.crossJoin(col_labels).join(F.broadcast(numbered), ["k", "l"]).select("row_id", "col_id", "block_id")


def blocks_by_arithmetic(row_labels: DataFrame, col_labels: DataFrame, n_cols: int) -> DataFrame:
    """Block of every cell numbered k * columns + l."""
    return row_labels.crossJoin(col_labels).select("row_id", "col_id", (F.col("k") * n_cols + F.col("l")).alias("block_id"))


def transposed(cells: DataFrame) -> DataFrame:
    """The matrix with rows and columns exchanged."""
    return cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "x")


def numbered(df: DataFrame, parts: list[str], order: list[str], out: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``parts`` and ``order``.

    Rows of one value of ``parts`` are sorted together; where each part begins
    follows from the parts' counts, so no task sorts all rows.
    """
    held = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    begin = held.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
    return df.withColumn("_place", place).join(begin, parts).withColumn(out, (F.col("_begin") + F.col("_place")).cast("long")).drop("_begin", "_place")


def reordered(cells: DataFrame, row_labels: DataFrame, col_labels: DataFrame) -> DataFrame:
    """Cells at their places after sorting rows and columns by label; rows of a label are sorted by ranges of their ids."""
    parts = int(row_labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(row_labels.stat.approxQuantile("row_id", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    cut = sum((F.when(F.col("row_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    rows = numbered(row_labels.withColumn("_range", cut), ["k", "_range"], ["row_id"], "new_row")
    cols = col_labels.withColumn("new_col", (F.row_number().over(Window.orderBy("l", "col_id")) - 1).cast("long"))
    return cells.join(rows.select("row_id", "new_row"), "row_id").join(cols.select("col_id", "new_col"), "col_id").select("new_row", "new_col", "x")


def require(condition: bool, message: str) -> None:
    """A guard on sizes that are known to the driver."""
    if not condition:
        raise ValueError(message)


def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """A guard inside the plan: the query fails at the first row that breaks it."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
