"""Synthetic matrices with known blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .labels import numbered, require

# The published 100x100 fixture (means and variances by column cluster, then row cluster).
ROW_SIZES_100 = (50, 40, 10)
COL_SIZES_100 = (40, 40, 20)
MEANS_100 = ((0.976, 4.303, -1.527), (-2.33, 0.834, 8.5119), (5.563, 9.572, -3.771))
VARIANCES_100 = ((0.669, 1.761, 1.386), (1.851, 1.079, 1.944), (0.933, 1.973, 0.752))
# The published 20000x20 fixture, in the same order.
ROW_SIZES_20000 = (2000,) * 10
COL_SIZES_20000 = (7, 7, 6)
MEANS_20000 = (
    (0.97627008, 4.30378733, 2.05526752, 0.89766366, -1.52690401, 2.91788226, -1.24825577, 7.83546002, 9.27325521, 8.89337834),
    (-2.33116962, 5.83450076, 0.5778984, 1.36089122, 8.51193277, -8.57927884, -8.25741401, -9.59563205, 6.65239691, 0.43696644),
    (5.56313502, 7.40024296, 9.57236684, 5.98317128, -0.77041275, 5.61058353, -7.63451148, 2.79842043, -7.13293425, -1.7067612),
)
VARIANCES_20000 = (
    (0.669336507796175, 1.7612065703879582, 1.3862592599171373, 1.1238622175611195, 1.2457670824447593, 1.6931717416325167, 1.5972692066111005, 1.1159170518255292, 1.219057950452216, 0.8289552408204514),
    (1.8518144848803162, 1.079276132540391, 1.9446262792984377, 0.8714880183032959, 1.532140243991034, 1.084828014988245, 1.2964549237719827, 0.5460550074747246, 1.8643446504119405, 1.876902873474071),
    (0.9333442461964505, 1.9731924700985997, 0.7524495254489219, 0.9777400894782611, 1.7316683965907, 1.0062588416920026, 1.9621619190951707, 1.9494185295668427, 1.8494073742054244, 0.5954647897783252),
)


def label_by_size(index: Column, sizes) -> Column:
    """Cluster of an index when clusters take consecutive runs of these sizes."""
    out, before = F.lit(0), 0
    for k, size in enumerate(sizes):
        out = F.when(index >= before, F.lit(k)).otherwise(out)
        before += size
    return out.cast("long")


def normal(*parts) -> Column:
    """A standard normal number that depends on its parts only (Box-Muller)."""
    return F.sqrt(-2 * F.log(F.greatest(uniform(*parts, "r"), F.lit(1e-12)))) * F.cos(2 * np.pi * uniform(*parts, "a"))


def block_matrix(spark: SparkSession, row_sizes, col_sizes, means, variances, seed: int = 0, mixing: float = 0.0) -> DataFrame:
    """row_id, col_id, k, l, x: scalar cells drawn from their block's normal distribution.

    With ``mixing`` each cell independently comes from a random other block with that probability.
    """
    require(len(means) == len(col_sizes) and all(len(m) == len(row_sizes) for m in means), "means must have a row for each column cluster and an entry for each row cluster")
    require(len(variances) == len(means) and all(len(v) == len(m) for v, m in zip(variances, means, strict=True)), "variances must have the shape of means")
    require(0 <= mixing <= 1, "mixing must be a share")
    n, p = sum(row_sizes), sum(col_sizes)
    cells = spark.range(n).select(F.col("id").alias("row_id")).crossJoin(spark.range(p).select(F.col("id").cast("int").alias("col_id")))
    cells = cells.withColumns({"k": label_by_size(F.col("row_id"), row_sizes), "l": label_by_size(F.col("col_id"), col_sizes)})
    n_k = len(row_sizes)
    own = F.col("l") * n_k + F.col("k")
    other = F.floor(uniform(F.lit(seed), "other", F.col("row_id"), F.col("col_id")) * (n_k * len(col_sizes)))
    block = F.when(uniform(F.lit(seed), "mix", F.col("row_id"), F.col("col_id")) < mixing, other).otherwise(own) + 1
    flat = lambda table: F.array(*(F.lit(float(v)) for row in table for v in row))
    z = normal(F.lit(seed), F.col("row_id"), F.col("col_id"))
    return cells.withColumn("x", F.element_at(flat(means), block.cast("int")) + F.sqrt(F.element_at(flat(variances), block.cast("int"))) * z)


def vector_blocks(spark: SparkSession, row_sizes, col_sizes, means, covariances, seed: int = 0) -> DataFrame:
    """The same for vector cells: means[l][k] are vectors, covariances[l][k] matrices (a Cholesky factor per block)."""
    d = len(means[0][0])
    factors = np.array([[np.linalg.cholesky(np.asarray(c, dtype=float)) for c in row] for row in covariances])
    centre = np.asarray(means, dtype=float)
    scalar = [[0.0] * len(row_sizes) for _ in col_sizes]
    cells = block_matrix(spark, row_sizes, col_sizes, scalar, scalar, seed).drop("x")
    cells = cells.withColumn("z", F.array(*(normal(F.lit(seed), F.lit(i), F.col("row_id"), F.col("col_id")) for i in range(d))))

    @F.pandas_udf("array<double>")
    def placed(k: pd.Series, l: pd.Series, z: pd.Series) -> pd.Series:  # noqa: E741
        k, l = k.to_numpy(), l.to_numpy()  # noqa: E741
        return pd.Series(list(centre[l, k] + np.einsum("nij,nj->ni", factors[l, k], np.array(z.tolist()))))

    return cells.withColumn("x", placed("k", "l", "z")).drop("z")


def assembled(blocks: DataFrame, row_sizes, col_sizes) -> DataFrame:
    """Cells of separate blocks (k, l, i, j, x) at their places in the whole matrix."""
    starts = lambda sizes: [0, *np.cumsum(sizes)[:-1].tolist()]
    at = lambda label, sizes: F.element_at(F.array(*(F.lit(int(s)) for s in starts(sizes))), (F.col(label) + 1).cast("int"))
    return blocks.select((at("k", row_sizes) + F.col("i")).cast("long").alias("row_id"), (at("l", col_sizes) + F.col("j")).cast("int").alias("col_id"), "x")


def permutation(ids: DataFrame, column: str, seed: int, out: str) -> DataFrame:
    """A random order of ids that depends on the seed and the ids only: by a hash, of whose ranges each is sorted for itself."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))
    return numbered(ids.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3)), ["_range"], ["_key", column], out).drop("_key", "_range")


def shuffled(cells: DataFrame, seed: int) -> DataFrame:
    """Cells with rows and columns permuted independently; other columns stay."""
    rows = permutation(cells.select("row_id").distinct(), "row_id", seed, "_row")
    cols = permutation(cells.select("col_id").distinct(), "col_id", seed + 1, "_col")
    moved = cells.join(rows, "row_id").join(cols, "col_id")
    return moved.drop("row_id", "col_id").withColumnsRenamed({"_row": "row_id"}).withColumn("col_id", F.col("_col").cast("int")).drop("_col")


def fixture_100(spark: SparkSession, seed: int = 0, shuffle: bool = False) -> DataFrame:
    """The 100x100 matrix with three row and three column clusters."""
    cells = block_matrix(spark, ROW_SIZES_100, COL_SIZES_100, MEANS_100, VARIANCES_100, seed)
    return shuffled(cells, seed) if shuffle else cells


def fixture_20000(spark: SparkSession, seed: int = 0, shuffle: bool = False) -> DataFrame:
    """The 20000x20 matrix with ten row and three column clusters."""
    cells = block_matrix(spark, ROW_SIZES_20000, COL_SIZES_20000, MEANS_20000, VARIANCES_20000, seed)
    return shuffled(cells, seed) if shuffle else cells
