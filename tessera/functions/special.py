"""Special functions as Column expressions, for which Spark SQL has no built-in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LN_PI = math.log(math.pi)
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
#: Bernoulli terms of Stirling's series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: Column) -> Column:
    """Log gamma of a positive number: Stirling's series eight steps up, brought down by the recurrence."""
    z = x + 8.0
    series = F.lit(0.0)
    power = 1.0 / z
    for term in _STIRLING:
        series = series + term * power
        power = power / (z * z)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return (z - 0.5) * F.log(z) - z + HALF_LN_2PI + series - F.log(product)


def mvlgamma(x: Column, d: int) -> Column:
    """Multivariate log gamma of dimension d."""
    out = F.lit(d * (d - 1) / 4 * LN_PI)
    for i in range(1, d + 1):
        out = out + lgamma(x + (1 - i) / 2)
    return out


def log_factorial(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise(lgamma(n.cast("double") + 1.0))


def factorial(n: Column) -> Column:
    """n! up to 20, as a long."""
    return F.factorial(n.cast("int"))


def round_half_up(x: Column, digits: int) -> Column:
    """Rounded with halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def det2(m: Column) -> Column:
    """Determinant of a row-major 2x2 array."""
    return m[0] * m[3] - m[1] * m[2]


def inv2(m: Column) -> Column:
    d = det2(m)
    return F.array(m[3] / d, -m[1] / d, -m[2] / d, m[0] / d)


def trace(m: Column, d: int) -> Column:
    out = m[0]
    for i in range(1, d):
        out = out + m[i * d + i]
    return out


def diagonal(m: Column, d: int) -> Column:
    return F.array(*(m[i * d + i] for i in range(d)))


def log_det(m: Column, d: int) -> Column:
    """Log determinant of a positive definite row-major array: closed form for d up to 2, numpy in Arrow batches beyond."""
    if d == 1:
        return F.log(m[0])
    if d == 2:
        return F.log(det2(m))

    @F.pandas_udf("double")
    def numeric(column: pd.Series) -> pd.Series:
        stacked = np.array(column.tolist()).reshape(-1, d, d)
        return pd.Series(np.linalg.slogdet(stacked)[1])

    return numeric(m)


def outer(x: Column, y: Column) -> Column:
    """Row-major outer product of two arrays."""
    return F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: a * b)))


def scaled(m: Column, by: Column) -> Column:
    return F.transform(m, lambda v: v * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def unit_covariance(x: Column, full: bool = True) -> Column:
    """x xᵀ, or the squares of its components."""
    return outer(x, x) if full else F.transform(x, lambda a: a * a)


def array_mean(x: Column) -> Column:
    """Mean of one vector's components."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)
