"""The sequential parts of the sampler, in numpy: row sweep, merge fold, column sweep.

States are small: a sweep sees one worker's rows, the fold sees cluster
statistics, the column sweep sees statistics per column and row cluster.
Distributions form a grid with one entry per column cluster and row cluster,
kept as raw statistics, so removing a row subtracts what adding it added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..functions.niw import LN_PI, Niw, logdet, mvlgamma
from ..functions.rng import draw_index, uniform_value


@dataclass
class Stats:
    """Count, sum and raw second moment of sets of d-dimensional cells, with any leading axes."""

    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    @classmethod
    def zeros(cls, shape: tuple[int, ...], d: int) -> Stats:
        return cls(np.zeros(shape), np.zeros((*shape, d)), np.zeros((*shape, d, d)))

    @classmethod
    def of_moments(cls, n, mean, scatter) -> Stats:
        n, mean = np.asarray(n, dtype=float), np.asarray(mean, dtype=float)
        return cls(n, n[..., None] * mean, np.asarray(scatter, dtype=float) + n[..., None, None] * mean[..., :, None] * mean[..., None, :])

    def moments(self):
        n = np.maximum(self.n, 1)
        mean = self.total / n[..., None]
        scatter = self.square - self.n[..., None, None] * mean[..., :, None] * mean[..., None, :]
        # Subtraction may leave rounding on the diagonal of sets of one value.
        at = np.arange(scatter.shape[-1])
        scatter[..., at, at] = np.maximum(scatter[..., at, at], 0)
        return self.n, mean, scatter

    def __getitem__(self, key) -> Stats:
        return Stats(self.n[key], self.total[key], self.square[key])

    def __add__(self, other: Stats) -> Stats:
        return Stats(self.n + other.n, self.total + other.total, self.square + other.square)

    def add(self, key, other: Stats, sign: int = 1) -> None:
        self.n[key] += sign * other.n
        self.total[key] += sign * other.total
        self.square[key] += sign * other.square

    def without(self, k: int, axis: int) -> Stats:
        return Stats(*(np.delete(a, k, axis=axis) for a in (self.n, self.total, self.square)))

    def with_new(self, axis: int) -> Stats:
        def grown(a):
            shape = list(a.shape)
            shape[axis] = 1
            return np.concatenate([a, np.zeros(shape)], axis=axis)

        return Stats(grown(self.n), grown(self.total), grown(self.square))


def posterior(prior: Niw, stats: Stats) -> Niw:
    return prior.update(*stats.moments())


def cell_stats(x: np.ndarray, labels: np.ndarray, n_labels: int) -> Stats:
    """Statistics of rows' cells by column cluster: x is (rows, columns, d), the result has axes (rows, column clusters)."""
    hot = np.eye(n_labels)[labels]
    n = np.broadcast_to(hot.sum(axis=0), (len(x), n_labels)).copy()
    return Stats(n, np.einsum("rpd,pl->rld", x, hot), np.einsum("rpd,rpe,pl->rlde", x, x, hot, optimize=True))


class Marginals:
    """Log marginal likelihoods of statistics under a prior.

    What depends on the count alone comes from a table, as counts are whole
    numbers; the weight of adding cells to a cluster is the difference of two.
    """

    def __init__(self, prior: Niw, most: float):
        self.prior = prior
        self.table = counted_part(prior, int(most)) if most <= TABLE_COUNTS else None
        self.own = prior.kappa * prior.mu[:, None] * prior.mu[None, :] + prior.psi

    def of(self, stats: Stats):
        p, n = self.prior, stats.n
        kappa = p.kappa + n
        by_count = _by_count(p, n) if self.table is None else self.table[n.astype(int)]
        if p.d == 1:
            psi = self.own[0, 0] + stats.square[..., 0, 0] - (p.kappa * p.mu[0] + stats.total[..., 0]) ** 2 / kappa
            if np.min(psi, initial=np.inf) <= 0:
                raise ValueError("a scale is not positive definite")
            return by_count - (p.nu + n) / 2 * np.log(psi)
        pulled = p.kappa * p.mu + stats.total
        psi = self.own + stats.square - pulled[..., :, None] * pulled[..., None, :] / kappa[..., None, None]
        return by_count - (p.nu + n) / 2 * logdet(psi)


def _by_count(p: Niw, n, gammas=None):
    d = p.d
    gammas = mvlgamma((p.nu + n) / 2, d) if gammas is None else gammas
    return -n * d / 2 * LN_PI + d / 2 * np.log(p.kappa / (p.kappa + n)) + gammas - mvlgamma(p.nu / 2, d) + p.nu / 2 * logdet(p.psi)


def counted_part(p: Niw, most: int, held: dict = {}) -> np.ndarray:  # noqa: B006 - a memo per process
    """What of a marginal depends on the count alone, for counts up to ``most`` at least.

    The gamma function of a half more each time follows from its recurrence.
    """
    size = 1 << max(10, most.bit_length())
    key = (float(p.kappa), float(p.nu), p.d, np.asarray(p.psi).tobytes(), size)
    if key not in held:
        if len(held) >= 8:
            held.clear()
        n, gammas = np.arange(size), np.full(size, p.d * (p.d - 1) / 4 * LN_PI)
        for j in range(p.d):
            for odd in (0, 1):
                z = (float(p.nu) + odd - j) / 2 + np.arange(size // 2)
                gammas[odd::2] += math.lgamma(z[0]) + np.concatenate([[0.0], np.cumsum(np.log(z[:-1]))])
        held[key] = _by_count(p, n, gammas)
    return held[key]


#: Counts up to this have their part of the marginal in a table.
TABLE_COUNTS = 1_000_000


def row_sweep(x: np.ndarray, row_ids, labels: np.ndarray, col_labels: np.ndarray, prior: Niw, alpha: float, outside: Stats, seed, sweeps: int = 1) -> np.ndarray:
    """New local labels of one worker's rows after ``sweeps`` passes in row order.

    A row's weight for a cluster is the number of the worker's rows there times
    the marginal likelihood of its cells given the cluster's, column cluster by
    column cluster; for a new cluster alpha times that under the prior.
    ``outside`` has the statistics of the other workers' rows in the same
    clusters (zeros where there are none); counts are the worker's own.
    """
    n_cols = int(col_labels.max()) + 1
    rows = cell_stats(x, col_labels, n_cols)
    labels = np.asarray(labels).copy()
    grid = Stats(outside.n.copy(), outside.total.copy(), outside.square.copy())
    counts = np.bincount(labels, minlength=grid.n.shape[1]).astype(float)
    for r, k in enumerate(labels):
        grid.add((slice(None), k), rows[r])
    marginal = Marginals(prior, grid.n.sum() + x.shape[0] * x.shape[1])
    fresh = marginal.of(rows).sum(axis=1) + np.log(alpha)
    held = marginal.of(grid)
    for sweep in range(sweeps):
        for r in range(len(labels)):
            k = labels[r]
            grid.add((slice(None), k), rows[r], -1)
            counts[k] -= 1
            if counts[k] == 0:
                grid, counts, held = grid.without(k, 1), np.delete(counts, k), np.delete(held, k, axis=1)
                labels[labels > k] -= 1
            else:
                held[:, k] = marginal.of(grid[:, k])
            own = rows[r]
            joint = marginal.of(Stats(grid.n + own.n[:, None], grid.total + own.total[:, None], grid.square + own.square[:, None]))
            weights = np.append((joint - held).sum(axis=0) + np.log(counts), fresh[r])
            k = draw_index(weights, uniform_value(seed, "row", sweep, row_ids[r]))
            if k == len(counts):
                grid, counts = grid.with_new(1), np.append(counts, 0.0)
                held = np.concatenate([held, np.zeros((n_cols, 1))], axis=1)
            grid.add((slice(None), k), rows[r])
            held[:, k] = marginal.of(grid[:, k])
            counts[k] += 1
            labels[r] = k
    return labels


def merge_fold(clusters: list[tuple], prior: Niw, alpha: float, seed, compat: bool = False) -> list[int]:
    """Global cluster of every local one: an ordered fold over (worker, local_k, rows, Stats).

    Each summary joins a global cluster or opens one, by the marginal likelihood
    of its statistics given the cluster and the number of rows there.  ``compat``
    passes posterior parameters on as if they were statistics, and weighs a
    cluster by its degrees of freedom less the dimension instead of its rows.
    """
    held: list[Stats] = []
    rows: list[float] = []
    out = []
    for worker, local, n_rows, stats in clusters:
        if compat:
            after = posterior(prior, stats)
            entered = Stats.of_moments(after.nu, after.mu, after.psi)
        else:
            entered = stats
        given = [posterior(prior, h) for h in held]
        sizes = [np.max(g.nu) - prior.d for g in given] if compat else rows
        weights = [g.log_marginal(*entered.moments()).sum() + np.log(n) for g, n in zip(given, sizes, strict=True)]
        weights.append(prior.log_marginal(*entered.moments()).sum() + np.log(alpha))
        k = draw_index(np.array(weights), uniform_value(seed, "merge", worker, local))
        if k == len(held):
            held.append(entered)
            rows.append(0.0)
        else:
            held[k] = held[k] + entered
        rows[k] += float(n_rows)
        out.append(k)
    return out


def column_sweep(columns: Stats, labels: np.ndarray, prior: Niw, beta: float, seed, compat: bool = False) -> np.ndarray:
    """New column labels after one pass in column order; columns has axes (column, row cluster).

    ``compat`` scores a column against a cluster that still holds it.
    """
    labels = np.asarray(labels).copy()
    n = int(labels.max()) + 1
    grid = Stats.zeros((n, columns.n.shape[1]), columns.total.shape[-1])
    for j, k in enumerate(labels):
        grid.add(k, columns[j])
    counts = np.bincount(labels, minlength=n).astype(float)
    marginal = Marginals(prior, 2 * grid.n.sum())
    fresh = marginal.of(columns).sum(axis=1) + np.log(beta)
    for j in range(len(labels)):
        k = labels[j]
        counts[k] -= 1
        if not compat or counts[k] == 0:
            grid.add(k, columns[j], -1)
        if counts[k] == 0:
            grid, counts = grid.without(k, 0), np.delete(counts, k)
            labels[labels > k] -= 1
        own = columns[j]
        gain = marginal.of(Stats(grid.n + own.n, grid.total + own.total, grid.square + own.square)) - marginal.of(grid)
        weights = np.append(gain.sum(axis=1) + np.log(counts), fresh[j])
        k = draw_index(weights, uniform_value(seed, "col", j))
        if k == len(counts):
            grid, counts = grid.with_new(0), np.append(counts, 0.0)
        grid.add(k, columns[j])
        counts[k] += 1
        labels[j] = k
    return labels


def chain(x: np.ndarray, row_ids, col_labels: np.ndarray, prior: Niw, alpha: float, beta: float, seed, iterations: int, sweeps: int = 1, compat: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Row labels, column labels and the numbers of clusters after each iteration, where one worker holds all rows."""
    rows, cols = np.zeros(len(x), dtype=int), np.asarray(col_labels).copy()
    d = x.shape[2]
    counts = []
    for step in range(iterations):
        outside = Stats.zeros((int(cols.max()) + 1, int(rows.max()) + 1), d)
        rows = row_sweep(x, row_ids, rows, cols, prior, alpha, outside, f"{seed}|{step}", sweeps)
        hot = np.eye(int(rows.max()) + 1)[rows]
        n = np.broadcast_to(hot.sum(axis=0), (x.shape[1], hot.shape[1])).copy()
        per_column = Stats(n, np.einsum("rpd,rk->pkd", x, hot), np.einsum("rpd,rpe,rk->pkde", x, x, hot, optimize=True))
        cols = column_sweep(per_column, cols, prior, beta, f"{seed}|{step}", compat)
        counts.append((int(rows.max()) + 1, int(cols.max()) + 1))
    return rows.astype("int64"), cols.astype("int64"), counts


@dataclass
class State:
    """What an iteration hands to the next: the small side of the model."""

    col_labels: np.ndarray
    n_row_clusters: int
    grid: Stats | None
    history: list[dict] = field(default_factory=list)
