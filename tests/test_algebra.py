import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions.niw import Niw, Scalar, crp_logprob, moments, mvlgamma

cells = st.lists(st.floats(-50, 50), min_size=2, max_size=12)


def test_lgamma_column(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.5, 1e4, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x"))).collect()
    for x, row in zip(xs, got, strict=True):
        assert row[0] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-12)


@settings(max_examples=40, deadline=None)
@given(cells)
def test_downdate_undoes_update(x):
    prior = Niw.make(0.3, 1.5, 0.7, 3)
    back = prior.update(*moments(x)).downdate(*moments(x))
    assert back.mu == pytest.approx(prior.mu, abs=1e-6)
    assert back.psi == pytest.approx(prior.psi, abs=1e-5)
    assert float(back.nu) == 3


@settings(max_examples=30, deadline=None)
@given(cells, st.randoms())
def test_marginal_is_the_product_of_predictives_in_any_order(x, random):
    prior = Niw.make(0.0, 1.0, 1.0, 2)
    random.shuffle(x)
    total, now = 0.0, prior
    for v in x:
        total += float(now.predictive([v]))
        now = now.update(*moments([v]))
    assert total == pytest.approx(float(prior.log_marginal(*moments(x))), abs=1e-6)


def test_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3))
    prior = Niw.identity(3)
    total, now = 0.0, prior
    for v in x:
        total += float(now.predictive(v))
        now = now.update(*moments(v[None]))
    assert total == pytest.approx(float(prior.log_marginal(*moments(x))), abs=1e-8)
    assert now.equals(prior.update(*moments(x)))
    assert prior.posterior_predictive(x[:5], x[5:]) == pytest.approx(float(prior.log_marginal(*moments(x))) - float(prior.log_marginal(*moments(x[5:]))), abs=1e-8)


def test_scalar_columns_agree_with_numpy(spark):
    x = [0.2, -1.0, 3.0, 0.7]
    n, mean, scatter = moments(x)
    df = spark.createDataFrame([(n, float(mean[0]), float(scatter[0, 0]))], "n double, m double, s double")
    prior, twin = Scalar.of(0.1, 2.0, 0.5, 3.0), Niw.make(0.1, 2.0, 0.5, 3)
    row = df.select(prior.log_marginal(F.col("n"), F.col("m"), F.col("s")), prior.inverse_wishart_logpdf(F.lit(0.8)), prior.logpdf(F.lit(0.3), F.lit(0.8)), prior.predictive(F.lit(1.1))).first()
    assert row[0] == pytest.approx(float(twin.log_marginal(n, mean, scatter)))
    assert row[1] == pytest.approx(float(twin.inverse_wishart_logpdf(np.array([[0.8]]))))
    assert row[2] == pytest.approx(twin.logpdf([0.3], np.array([[0.8]])))
    assert row[3] == pytest.approx(float(twin.predictive([1.1])))


def test_priors_from_data():
    x = np.random.default_rng(2).normal(size=(50, 2))
    _, mean, scatter = moments(x)
    assert Niw.from_data(x, "covariance").psi == pytest.approx(scatter / 49)
    assert Niw.from_data(x).psi == pytest.approx(np.linalg.inv(scatter / 49))
    assert Niw.from_data(x, "scatter_precision").psi == pytest.approx(np.linalg.inv(scatter))
    with pytest.raises(ValueError):
        Niw.from_data(x, "other")


def test_samples_have_the_right_mean():
    rng = np.random.default_rng(3)
    dist = Niw.make([1.0, -1.0], 5.0, np.array([[4.0, 1.0], [1.0, 3.0]]), 10)
    drawn = [dist.sample(rng) for _ in range(3000)]
    assert np.mean([m for m, _ in drawn], axis=0) == pytest.approx([1, -1], abs=0.05)
    assert np.mean([s for _, s in drawn], axis=0) == pytest.approx(dist.psi / (10 - 3), abs=0.05)
    mean, sigma = dist.sample(rng, compat=True)
    assert mean.shape == (2,) and sigma.shape == (2, 2)


def test_partition_probabilities_sum_to_one():
    # All partitions of three items: one block, three ways of two, three singles.
    total = math.exp(crp_logprob(1.7, [3])) + 3 * math.exp(crp_logprob(1.7, [2, 1])) + math.exp(crp_logprob(1.7, [1, 1, 1]))
    assert total == pytest.approx(1)


def test_multivariate_gamma():
    assert float(mvlgamma(2.5, 1)) == pytest.approx(math.lgamma(2.5))
    assert float(mvlgamma(2.5, 2)) == pytest.approx(0.5 * math.log(math.pi) + math.lgamma(2.5) + math.lgamma(2.0))


def test_guards(spark):
    with pytest.raises(ValueError):
        Niw.make(0, 1, 1, 2).downdate(2, 0.0, 0.0)
    with pytest.raises(ValueError):
        Niw.make(0, 1, -1, 2).log_marginal(*moments([1.0, 2.0]))


def test_log_det_of_larger_matrices(spark):
    m = np.array([[4.0, 1, 0], [1, 3, 0.5], [0, 0.5, 2]])
    got = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(special.log_det(F.col("m"), 3)).first()[0]
    assert got == pytest.approx(np.linalg.slogdet(m)[1])
