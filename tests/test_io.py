import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import labels
from tessera.operators.stats import grouped
from tessera.sources import io
from tessera.streaming import block_stats


def test_matrix_round_trip(spark, tmp_path):
    cells = spark.range(30).select((F.col("id") / 5).cast("long").alias("row_id"), (F.col("id") % 5).cast("int").alias("col_id"), (F.col("id") * 0.5).alias("x"))
    io.write_matrix(cells, str(tmp_path / "m"))
    back = io.read_matrix(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_vector_cells_and_bad_cells(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("a,b\n1:2,3:4\n5:6,7:8\n")
    got = sorted(map(tuple, io.read_matrix(spark, str(path), dim=2).collect()))
    assert got == [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0]), (1, 1, [7.0, 8.0])]
    with pytest.raises(PySparkException):
        io.read_matrix(spark, str(path), dim=3).collect()
    path.write_text("a,b\n1,oops\n")
    with pytest.raises(PySparkException):
        io.read_matrix(spark, str(path)).collect()


def test_info_and_results(spark, tmp_path):
    path = tmp_path / "info.json"
    path.write_text(json.dumps({"blockPartition": [0, 1, 0, 1], "rowPartition": [0, 0], "colPartition": [0, 1], "empiricalMean": [2.5], "empiricalCovariance": [0.1]}))
    info = io.read_info(spark, str(path))
    assert info["mean"] == [2.5] and info["scale"] == [0.1]
    assert [tuple(r) for r in info["columns"].orderBy("col_id").collect()] == [(0, 0), (1, 1)]
    assert info["blocks"].count() == 4
    io.write_results(spark, str(tmp_path / "r"), {"ari": 1.0, "runtime": 2.0})
    part = next(f for f in os.listdir(tmp_path / "r") if f.startswith("part"))
    assert json.loads((tmp_path / "r" / part).read_text())["ari"] == 1.0
    io.write_labels(info["rows"], info["columns"], str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l" / "row_labels")).count() == 2
    io.write_prior(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), str(tmp_path / "p"))
    found = spark.read.json(str(tmp_path / "p")).first()
    assert found["mean"] == pytest.approx([7 / 3]) and found.precision[0] == pytest.approx([1 / (14 / 6)])
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 3)) @ draw.normal(size=(3, 3)) + 5
    io.write_prior(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3), str(tmp_path / "v"))
    found = spark.read.json(str(tmp_path / "v")).first()
    assert found["mean"] == pytest.approx(x.mean(axis=0).tolist())
    assert np.array(found.precision) == pytest.approx(np.linalg.inv(np.cov(x.T)))
    io.write_prior(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), str(tmp_path / "named"), "set.v1.csv")
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "named" / "global_precision_set.json")).collect())
    assert json.loads(text) == [[pytest.approx(1 / (14 / 6))]]
    assert "ARI: 1.0" in io.show_scores(1.0, 1.0, 9, 0.5)


def test_labels_join_elementwise(spark):
    # Ten workers of ten rows; local clusters 0 and 1 map to (worker + local) % 3.
    local = spark.range(100).select((F.col("id") / 10).cast("long").alias("worker_id"), F.col("id").alias("row_id"), (F.col("id") % 2).alias("local_k"))
    mapping = local.select("worker_id", "local_k").distinct().withColumn("global_k", (F.col("worker_id") + F.col("local_k")) % 3)
    got = {r.row_id: (r.worker_id, r.global_k, r.local_k) for r in labels.to_global(local, mapping).collect()}
    assert got == {i: (i // 10, (i // 10 + i % 2) % 3, i % 2) for i in range(100)}


def test_guard_inside_a_plan(spark):
    df = spark.range(5)
    assert labels.guarded(df, F.col("id") < 5, "too large").count() == 5
    with pytest.raises(PySparkException, match="too large"):
        labels.guarded(df, F.col("id") < 4, "too large").collect()


def test_stream_totals_equal_batch(spark, tmp_path):
    cells = spark.range(200).select((F.col("id") % 3).alias("l"), (F.col("id") % 4).alias("k"), (F.col("id") * 0.1).alias("x"))
    for part in range(2):
        cells.where(F.col("k") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    block_stats.follow(stream, ["l", "k"], str(tmp_path / "parts"), str(tmp_path / "state")).awaitTermination()
    got = {(r.l, r.k): (r.n, r["mean"], r.s) for r in block_stats.totals(spark.read.parquet(str(tmp_path / "parts")), ["l", "k"]).collect()}
    for r in grouped(cells, "l", "k").collect():
        assert got[r.l, r.k] == pytest.approx((r.n, r["mean"], r.s))
