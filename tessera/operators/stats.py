"""Mergeable block statistics: count, mean and centred scatter."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(x: str = "x") -> list[Column]:
    """Aggregates n, mean and s (centred scatter) of scalar cells; Spark merges them across partitions."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("s")]


def vector_moments(x: str, d: int) -> list[Column]:
    """Aggregates n, mean (array) and s (row-major array) of d-dimensional cells."""
    part = lambda i: F.col(x)[i]
    cross = {(i, j): F.covar_pop(part(i), part(j)) * F.count(x) for i, j in combinations_with_replacement(range(d), 2)}
    scatter = F.array(*(cross[min(i, j), max(i, j)] for i in range(d) for j in range(d)))
    return [F.count(x).alias("n"), F.array(*(F.avg(part(i)) for i in range(d))).alias("mean"), scatter.alias("s")]


def grouped(cells: DataFrame, *keys: str, x: str = "x") -> DataFrame:
    return cells.groupBy(*keys).agg(*moments(x))


def merged(stats: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the union of parts: weighted mean, and scatters around it.

    The scatter is the parts' own plus that of their means, taken around the
    common mean, which has no cancellation.
    """
    whole = stats.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    back = stats.join(whole, list(keys)) if keys else stats.crossJoin(F.broadcast(whole))
    gap = F.col("mean") - F.col("_mean")
    return back.groupBy(*keys, "_n", "_mean").agg((F.sum("s") + F.sum(F.col("n") * gap * gap)).alias("s")).select(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), "s")


def merged_raw(stats: DataFrame, *keys: str) -> DataFrame:
    """The same by raw second moments; one pass, less exact for means far from zero."""
    n, m = F.col("n"), F.col("mean")
    mean = F.sum(n * m) / F.sum(n)
    return stats.groupBy(*keys).agg(F.sum("n").alias("n"), mean.alias("mean"), (F.sum("s") + F.sum(n * m * m) - F.sum(n) * mean * mean).alias("s"))


def cross_sums(df: DataFrame, x: str, centre: list[float], *keys: str) -> DataFrame:
    """keys, i, j, n and c: per pair of components the sum of products around a centre.

    Tasks sum their rows in numpy batches; only a row a task, key and pair is
    shuffled, whatever the number of rows and components.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    d, mid = len(centre), np.array(centre, dtype=float)

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            column = batch.column(x)
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - mid
            at = [batch.column(k).to_pylist() for k in keys]
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*at, strict=True) if keys else [()] * batch.num_rows):
                groups.setdefault(key, []).append(row)
            for key, rows in groups.items():
                own = values[rows]
                kept = held.setdefault(key, [0, np.zeros((d, d))])
                kept[0] += len(own)
                kept[1] += own.T @ own
        i, j = (a.ravel() for a in np.indices((d, d)))
        for key, (n, c) in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * (d * d)) for v in key), pa.array(i), pa.array(j), pa.array(np.full(d * d, n)), pa.array(c.ravel())], names=[*keys, "i", "j", "n", "c"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "i long, j long, n long, c double"])
    parts = df.where(F.col(x).isNotNull()).select(*keys, x).mapInArrow(run, schema)
    return parts.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def means(df: DataFrame, x: str, d: int) -> list[float]:
    """Means of the components of all rows; d numbers."""
    return [v or 0.0 for v in df.agg(*(F.avg(F.col(x)[i]) for i in range(d))).first()]


def pair_moments(df: DataFrame, x: str, d: int, *keys: str) -> DataFrame:
    """keys, i, j, n, mean (of component i) and s: the centred scatter of every pair of components.

    Sums are taken around the means of all rows, so little is lost when the keys' own means are put back.
    """
    centre = means(df, x, d)
    own = df.select(*keys, F.posexplode(x).alias("i", "v")).groupBy(*keys, F.col("i").cast("long").alias("i")).agg(F.avg("v").alias("mean"))
    gap = own.withColumn("gap", F.col("mean") - F.element_at(F.array(*(F.lit(c) for c in centre)), (F.col("i") + 1).cast("int")))
    other = gap.select(*keys, F.col("i").alias("j"), F.col("gap").alias("gap_j"))
    sums = cross_sums(df, x, centre, *keys).join(gap, [*keys, "i"]).join(other, [*keys, "j"])
    return sums.select(*keys, "i", "j", "n", "mean", (F.col("c") - F.col("n") * F.col("gap") * F.col("gap_j")).alias("s"))


def covariance_about(df: DataFrame, x: str, centre: list[float], diagonal: bool = False) -> DataFrame:
    """Covariance matrix over n - 1, rounded half up to 8 digits; i, j, cov.

    The full form is taken around the given centre; the diagonal form holds the
    components' variances around their own means.
    """
    from ..functions.special import round_half_up

    sums = pair_moments(df, x, len(centre)).where("i = j").withColumnRenamed("s", "c") if diagonal else cross_sums(df, x, centre)
    return sums.select("i", "j", round_half_up(F.col("c") / (F.col("n") - 1), 8).alias("cov"))


def row_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row_id").agg(F.avg("x").alias("mean"))


def scaled_columns(cells: DataFrame) -> DataFrame:
    """Every cell over the sample standard deviation of its column; not centred.

    Columns are aggregated first and joined back, so a column's cells never meet in one task.
    """
    spread = cells.groupBy("col_id").agg(F.stddev_samp("x").alias("_sd"))
    return cells.join(spread, "col_id").withColumn("x", F.col("x") / F.col("_sd")).drop("_sd")


def weighted(df: DataFrame, x: str, w: Column) -> DataFrame:
    """Vectors times weights, component by component."""
    return df.withColumn(x, F.zip_with(F.col(x), w, lambda a, b: a * b))


def shape(cells: DataFrame) -> DataFrame:
    """Numbers of rows and columns."""
    return cells.agg(F.countDistinct("row_id").alias("n_rows"), (F.max("col_id") + 1).cast("long").alias("n_cols"))
