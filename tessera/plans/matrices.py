"""Dense matrices made from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of E are dealt to this many workers; its column j belongs to column cluster j % COLUMN_CLUSTERS.
WORKERS = 7
COLUMN_CLUSTERS = 4
#: Components of an embedding, the columns of E.
DIMENSIONS = 64
SEED = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, k and the worker of every embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.crossJoin(F.broadcast(n)).withColumn("worker_id", F.floor(((F.col("row_id") + 1) * WORKERS - 1) / F.col("n_rows")).cast("long")).drop("n_rows")


def e_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a matrix: row_id, col_id, x, with row cluster k, column cluster l and worker_id."""
    cells = e_rows(spark, sf_dir).select("row_id", "k", "worker_id", F.posexplode("v").alias("col_id", "x"))
    return cells.withColumns({"col_id": F.col("col_id").cast("long"), "l": (F.col("col_id") % COLUMN_CLUSTERS).cast("long")})


E_SQL = f"""
rows_e AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS k, embedding, CAST(floor(((vec_id + 1) * {WORKERS} - 1) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE)) AS BIGINT) AS worker_id FROM embeddings),
cells AS (SELECT row_id, k, worker_id, CAST(i - 1 AS BIGINT) AS col_id, CAST(embedding[i] AS DOUBLE) AS x, CAST((i - 1) % {COLUMN_CLUSTERS} AS BIGINT) AS l FROM rows_e, (SELECT unnest(range(1, 65)) AS i) t)
"""


def b_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by supplier nation and brand; rows and columns numbered in their order."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("row_key"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("col_key"))
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("row_key", "col_key").agg(F.avg("l_quantity").alias("x"))


B_SQL = "b AS (SELECT CAST(s_nationkey AS BIGINT) AS row_key, p_brand AS col_key, avg(l_quantity) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def u_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by user and event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row_key"), F.col("event_type").alias("col_key")).agg(F.avg("value").alias("x"))


U_SQL = "u AS (SELECT user_id AS row_key, event_type AS col_key, avg(value) AS x FROM events GROUP BY 1, 2)"


def s_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by supplier and brand."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("col_key"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("row_key"), "col_key").agg(F.avg("l_extendedprice").alias("x"))


S_SQL = "s AS (SELECT l_suppkey AS row_key, p_brand AS col_key, avg(l_extendedprice) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
