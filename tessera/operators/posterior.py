"""Draws of cluster parameters from their posteriors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.niw import Niw
from .stats import pair_moments


def posterior_sample(cells: DataFrame, prior: Niw, keys: list[str], seed: int = 0, compat: bool = False) -> DataFrame:
    """keys, n, mean (array) and covariance (row-major array), drawn from each cluster's or block's posterior.

    Cells are numbers or vectors in column ``x``; ``keys`` are labels from 0: a
    row label for clusters, a column and a row label for blocks.  A draw depends
    on the seed and the keys only.
    """
    d = prior.d
    x = F.col("x") if cells.schema["x"].dataType.typeName() == "array" else F.array("x")
    named = cells.select(*(F.col(k).cast("long").alias(k) for k in keys), x.cast("array<double>").alias("x")).where(F.col("x")[0].isNotNull())
    held = pair_moments(named, "x", d, *keys).groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "j", "mean", "s"))).alias("m"))

    def draw(batches):
        for batch in batches:
            at = [batch.column(k).to_pylist() for k in keys]
            means, covariances = [], []
            for key, n, m in zip(zip(*at, strict=True), batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                s = np.array([e["s"] for e in m]).reshape(d, d)
                after = prior.update(float(n), np.array([e["mean"] for e in m[:: d]]), (s + s.T) / 2)
                mean, sigma = after.sample(np.random.default_rng([seed, *key]), compat)
                means.append(mean.tolist())
                covariances.append(sigma.ravel().tolist())
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("n"), pa.array(means, numbers), pa.array(covariances, numbers)], names=[*keys, "n", "mean", "covariance"])

    return held.mapInArrow(draw, ", ".join([*(f"{k} long" for k in keys), "n long, mean array<double>, covariance array<double>"]))
