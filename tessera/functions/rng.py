"""Random numbers that depend on a seed and an entity only, never on the partitioning.

A uniform number is made from the first 32 bits of the md5 of the joined parts;
Column, numpy and SQL forms agree bit by bit.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    joined = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_value(*parts) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def log_sum_exp(df: DataFrame, keys: list[str], value: str, out: str = "lse") -> DataFrame:
    """Per key the log of the sum of exponentials, shifted by the largest value."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).groupBy(*keys, "_top").agg((F.col("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias(out)).drop("_top")


def softmax(df: DataFrame, keys: list[str], value: str, out: str = "p") -> DataFrame:
    """Probabilities proportional to exp(value) within each key."""
    group = Window.partitionBy(*keys)
    shifted = F.exp(F.col(value) - F.max(value).over(group))
    return df.withColumn("_e", shifted).withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str = "cum") -> DataFrame:
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(whole))


def draw(df: DataFrame, keys: list[str], category: str, p: str, u: Column, out: str = "drawn") -> DataFrame:
    """Inverse-CDF draw per key: the first category whose running sum reaches u, the last one if rounding keeps all below."""
    summed = running_sum(df, keys, category, p, "_cum").withColumn("_u", u)
    first = F.min(F.when(F.col("_cum") >= F.col("_u"), F.col(category)))
    return summed.groupBy(*keys).agg(F.coalesce(first, F.max(category)).alias(out))


def draw_index(logw: np.ndarray, u: float) -> int:
    """Inverse-CDF draw from log weights, in numpy."""
    p = np.exp(logw - logw.max())
    cumulative = np.cumsum(p / p.sum())
    return int(min(np.searchsorted(cumulative, u), len(p) - 1))
