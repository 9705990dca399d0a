"""Agreement of two labellings from their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table.groupBy("a").agg(F.sum("n").alias("n")), table.groupBy("b").agg(F.sum("n").alias("n")), table.agg(F.sum("n").alias("total"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index, 1 for equal partitions; one row, ``ari``."""
    a, b, total = _margins(table)
    pairs = lambda t, name: t.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias(name))
    parts = pairs(table, "together").crossJoin(pairs(a, "rows")).crossJoin(pairs(b, "cols")).crossJoin(total.select((F.col("total").cast("double") * (F.col("total") - 1) / 2).alias("every")))
    expected = F.col("rows") * F.col("cols") / F.col("every")
    most = (F.col("rows") + F.col("cols")) / 2
    return parts.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("together") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """Twice the mutual information over the sum of entropies; one row, ``nmi``."""
    a, b, total = _margins(table)
    joined = table.join(a.withColumnRenamed("n", "n_a"), "a").join(b.withColumnRenamed("n", "n_b"), "b").crossJoin(total)
    share = F.col("n") / F.col("total")
    mutual = joined.agg(F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))).alias("mutual"))
    entropy = lambda t, name: t.crossJoin(total).agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(name))
    both = mutual.crossJoin(entropy(a, "h_a")).crossJoin(entropy(b, "h_b"))
    return both.select(F.when(F.col("h_a") + F.col("h_b") == 0, F.lit(1.0)).otherwise(2 * F.col("mutual") / (F.col("h_a") + F.col("h_b"))).alias("nmi"))


def n_clusters(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.countDistinct(label).alias("n_clusters"))


def block_contingency(row_labels: DataFrame, col_labels: DataFrame, true_rows: DataFrame, true_cols: DataFrame) -> DataFrame:
    """Contingency of two block partitions of a matrix, from row labels (row_id, k) and column labels (col_id, l).

    A cell's blocks follow from its row's and its column's labels, so the table of
    the blocks is the product of the rows' and the columns' tables: no cell is made.
    """
    rows = contingency(row_labels.select("row_id", F.col("k").alias("e")).join(true_rows.select("row_id", F.col("k").alias("t")), "row_id"), "e", "t")
    cols = contingency(col_labels.select("col_id", F.col("l").alias("e")).join(true_cols.select("col_id", F.col("l").alias("t")), "col_id"), "e", "t")
    pairs = rows.select(F.col("a").alias("k"), F.col("b").alias("true_k"), F.col("n").alias("r")).crossJoin(cols.select(F.col("a").alias("l"), F.col("b").alias("true_l"), F.col("n").alias("c")))
    return pairs.select(F.struct("k", "l").alias("a"), F.struct("true_k", "true_l").alias("b"), (F.col("r") * F.col("c")).alias("n"))


def _all(table: DataFrame) -> DataFrame:
    return adjusted_rand(table).crossJoin(normalized_mutual_information(table)).crossJoin(table.agg(F.countDistinct("a").alias("n_clusters")))


def block_scores(row_labels: DataFrame, col_labels: DataFrame, true_rows: DataFrame, true_cols: DataFrame) -> DataFrame:
    """ari, nmi and n_clusters of the blocks of estimated against true labels."""
    return _all(block_contingency(row_labels, col_labels, true_rows, true_cols))


def n_blocks(row_labels: DataFrame, col_labels: DataFrame) -> DataFrame:
    """Number of blocks: of row clusters times column clusters."""
    rows, cols = row_labels.agg(F.countDistinct("k").alias("r")), col_labels.agg(F.countDistinct("l").alias("c"))
    return rows.crossJoin(cols).select((F.col("r") * F.col("c")).alias("n_clusters"))


def scores(estimated: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """ari, nmi and n_clusters of an estimated against a true partition, both as (keys, block_id)."""
    both = estimated.withColumnRenamed("block_id", "e").join(true.withColumnRenamed("block_id", "t"), keys)
    return _all(contingency(both, "e", "t"))
