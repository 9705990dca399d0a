"""Normal-Inverse-Wishart algebra: Columns for scalar cells, and a numpy twin for any dimension.

A distribution has a location mu with weight kappa, a scale psi and nu degrees
of freedom.  Sufficient statistics are a count, a mean and a centred scatter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import HALF_LN_2PI, LN_PI, lgamma


@dataclass(frozen=True)
class Scalar:
    """A distribution over scalar cells whose parameters are Columns."""

    mu: Column
    kappa: Column
    psi: Column
    nu: Column

    @classmethod
    def of(cls, mu: float, kappa: float = 1.0, psi: float = 1.0, nu: float = 2.0) -> Scalar:
        return cls(*(F.lit(float(v)) for v in (mu, kappa, psi, nu)))

    def update(self, n: Column, mean: Column, scatter: Column) -> Scalar:
        """The posterior after n cells with this mean and scatter; no cells leave it as it is."""
        n = F.coalesce(n.cast("double"), F.lit(0.0))
        mean, scatter = F.coalesce(mean, F.lit(0.0)), F.coalesce(scatter, F.lit(0.0))
        kappa = self.kappa + n
        gap = mean - self.mu
        return Scalar((self.kappa * self.mu + n * mean) / kappa, kappa, self.psi + scatter + n * self.kappa / kappa * gap * gap, self.nu + n)

    def downdate(self, n: Column, mean: Column, scatter: Column) -> Scalar:
        """The distribution that :meth:`update` with the same cells would lead back from."""
        n = n.cast("double")
        kappa = self.kappa - n
        mu = (self.kappa * self.mu - n * mean) / kappa
        gap = mean - mu
        return Scalar(mu, kappa, self.psi - scatter - n * kappa / self.kappa * gap * gap, self.nu - n)

    def log_marginal(self, n: Column, mean: Column, scatter: Column) -> Column:
        """Log probability of cells with the mean and variance integrated out."""
        after = self.update(n, mean, scatter)
        return -F.coalesce(n.cast("double"), F.lit(0.0)) / 2 * LN_PI + F.log(self.kappa / after.kappa) / 2 + lgamma(after.nu / 2) - lgamma(self.nu / 2) + self.nu / 2 * F.log(self.psi) - after.nu / 2 * F.log(after.psi)

    def predictive(self, x: Column) -> Column:
        """Log density of one further cell: Student's t."""
        return student_logpdf(x, self.mu, (self.kappa + 1) / (self.kappa * self.nu) * self.psi, self.nu)

    def inverse_wishart_logpdf(self, variance: Column) -> Column:
        return self.nu / 2 * F.log(self.psi) - self.nu / 2 * math.log(2) - lgamma(self.nu / 2) - (self.nu + 2) / 2 * F.log(variance) - self.psi / variance / 2

    def logpdf(self, mean: Column, variance: Column) -> Column:
        """Log density at a mean and a variance."""
        return normal_logpdf(mean, self.mu, variance / self.kappa) + self.inverse_wishart_logpdf(variance)

    def columns(self, digits: int | None = None) -> list[Column]:
        shown = (lambda c: F.round(c, digits) + F.lit(0.0)) if digits is not None else (lambda c: c)
        return [shown(getattr(self, k)).alias(k) for k in ("mu", "kappa", "psi", "nu")]


def normal_logpdf(x: Column, mean: Column, variance: Column) -> Column:
    return -HALF_LN_2PI - F.log(variance) / 2 - (x - mean) * (x - mean) / variance / 2


def student_logpdf(x: Column, mu: Column, sigma: Column, nu: Column) -> Column:
    gap = x - mu
    return lgamma((nu + 1) / 2) - lgamma(nu / 2) - F.log(math.pi * nu) / 2 - F.log(sigma) / 2 - (nu + 1) / 2 * F.log(1 + gap * gap / sigma / nu)


# ---------------------------------------------------------------- numpy, any dimension

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def mvlgamma(x, d: int):
    x = np.asarray(x, dtype=float)
    return d * (d - 1) / 4 * LN_PI + sum(_LGAMMA(x + (1 - i) / 2) for i in range(1, d + 1))


@dataclass
class Niw:
    """A distribution over d-dimensional cells; arrays may have leading axes (a grid of distributions)."""

    mu: np.ndarray
    kappa: np.ndarray
    psi: np.ndarray
    nu: np.ndarray

    @classmethod
    def make(cls, mu=0.0, kappa=1.0, psi=1.0, nu=None) -> Niw:
        mu = np.atleast_1d(np.asarray(mu, dtype=float))
        psi = np.asarray(psi, dtype=float).reshape(len(mu), len(mu))
        return cls(mu, np.asarray(float(kappa)), psi, np.asarray(float(len(mu) + 1 if nu is None else nu)))

    @classmethod
    def identity(cls, d: int) -> Niw:
        return cls.make(np.zeros(d), 1.0, np.eye(d), d + 1)

    @classmethod
    def from_data(cls, x: np.ndarray, scale: str = "precision") -> Niw:
        """A prior around data: psi is the inverse covariance, the covariance, or the inverse scatter."""
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        mean = x.mean(axis=0)
        return cls.from_moments(len(x), mean, (x - mean).T @ (x - mean), scale)

    @classmethod
    def from_moments(cls, n: int, mean, scatter, scale: str = "precision") -> Niw:
        mean = np.atleast_1d(np.asarray(mean, dtype=float))
        scatter = np.asarray(scatter, dtype=float).reshape(len(mean), len(mean))
        covariance = scatter / max(1, n - 1)
        psi = {"precision": lambda: np.linalg.inv(covariance), "covariance": lambda: covariance, "scatter_precision": lambda: np.linalg.inv(scatter)}
        if scale not in psi:
            raise ValueError(f"unknown scale {scale!r}")
        return cls.make(mean, 1.0, psi[scale](), len(mean) + 1)

    @property
    def d(self) -> int:
        return self.psi.shape[-1]

    def update(self, n, mean, scatter) -> Niw:
        n = np.asarray(n, dtype=float)
        kappa = self.kappa + n
        gap = mean - self.mu
        mu = (self.kappa[..., None] * self.mu + n[..., None] * mean) / kappa[..., None]
        psi = self.psi + scatter + (n * self.kappa / kappa)[..., None, None] * gap[..., :, None] * gap[..., None, :]
        return Niw(mu, kappa, psi, self.nu + n)

    def downdate(self, n, mean, scatter) -> Niw:
        n = np.asarray(n, dtype=float)
        kappa = self.kappa - n
        if np.any(kappa <= 0):
            raise ValueError("more cells removed than were added")
        mu = (self.kappa[..., None] * self.mu - n[..., None] * mean) / kappa[..., None]
        gap = mean - mu
        psi = self.psi - scatter - (n * kappa / self.kappa)[..., None, None] * gap[..., :, None] * gap[..., None, :]
        return Niw(mu, kappa, psi, self.nu - n)

    def log_marginal(self, n, mean, scatter):
        after = self.update(n, mean, scatter)
        n = np.asarray(n, dtype=float)
        d = self.d
        return -n * d / 2 * LN_PI + d / 2 * np.log(self.kappa / after.kappa) + mvlgamma(after.nu / 2, d) - mvlgamma(self.nu / 2, d) + self.nu / 2 * logdet(self.psi) - after.nu / 2 * logdet(after.psi)

    def predictive(self, x):
        """Log density of further cells, one by one: multivariate Student's t."""
        d = self.d
        df = self.nu - d + 1
        sigma = ((self.kappa + 1) / (self.kappa * df))[..., None, None] * self.psi
        gap = np.asarray(x, dtype=float) - self.mu
        form = np.einsum("...i,...ij,...j->...", gap, np.linalg.inv(sigma), gap)
        return _LGAMMA((df + d) / 2) - _LGAMMA(df / 2) - d / 2 * np.log(math.pi * df) - logdet(sigma) / 2 - (df + d) / 2 * np.log1p(form / df)

    def posterior_predictive(self, new, seen) -> float:
        """Log marginal of new cells after others have been seen."""
        return float(self.update(*moments(seen)).log_marginal(*moments(new)))

    def inverse_wishart_logpdf(self, sigma):
        d = self.d
        inverse = np.linalg.inv(sigma)
        return self.nu / 2 * logdet(self.psi) - self.nu * d / 2 * math.log(2) - mvlgamma(self.nu / 2, d) - (self.nu + d + 1) / 2 * logdet(sigma) - np.trace(self.psi @ inverse) / 2

    def logpdf(self, mean, sigma):
        gap = np.atleast_1d(mean) - self.mu
        cov = np.asarray(sigma) / self.kappa
        normal = -self.d * HALF_LN_2PI - logdet(cov) / 2 - gap @ np.linalg.solve(cov, gap) / 2
        return float(normal + self.inverse_wishart_logpdf(sigma))

    def sample(self, rng: np.random.Generator, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A mean and covariance; ``compat`` draws a Wishart matrix for the precision scale instead, as a covariance over kappa squared."""
        scale = self.psi if compat else np.linalg.inv(self.psi)
        low = np.linalg.cholesky(scale)
        bartlett = np.tril(rng.normal(size=(self.d, self.d)), -1)
        bartlett[np.diag_indices(self.d)] = np.sqrt(rng.chisquare(float(self.nu) - np.arange(self.d)))
        wishart = low @ bartlett @ bartlett.T @ low.T
        if compat:
            mean = rng.multivariate_normal(self.mu, np.linalg.inv(wishart * self.kappa))
            return mean, wishart / self.kappa**2
        sigma = np.linalg.inv(wishart)
        return rng.multivariate_normal(self.mu, sigma / self.kappa), sigma

    def equals(self, other: Niw, tolerance: float = 1e-6) -> bool:
        """Equal parameters up to the largest absolute difference."""
        return all(np.shape(a) == np.shape(b) and np.max(np.abs(a - b), initial=0.0) <= tolerance for a, b in zip((self.mu, self.kappa, self.psi, self.nu), (other.mu, other.kappa, other.psi, other.nu), strict=True))

    def __repr__(self) -> str:
        return f"Niw(mu={self.mu.tolist()}, kappa={self.kappa}, psi={self.psi.tolist()}, nu={self.nu})"


def logdet(m):
    m = np.asarray(m, dtype=float)
    if m.shape[-1] == 1:
        if np.any(m <= 0):
            raise ValueError("a scale is not positive definite")
        return np.log(m[..., 0, 0])
    sign, value = np.linalg.slogdet(m)
    if np.any(sign <= 0):
        raise ValueError("a scale is not positive definite")
    return value


def moments(x) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and centred scatter of cells."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    mean = x.mean(axis=0)
    return float(len(x)), mean, (x - mean).T @ (x - mean)


def crp_logprob(alpha: float, counts) -> float:
    """Log probability of a partition under the Chinese restaurant process."""
    counts = [int(c) for c in counts]
    n = sum(counts)
    return len(counts) * math.log(alpha) + sum(math.lgamma(c) for c in counts) - (math.lgamma(alpha + n) - math.lgamma(alpha))
