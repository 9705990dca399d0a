import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.niw import Niw, moments
from tessera.operators import datagen, gibbs, labels, score
from tessera.operators.gibbs import Stats
from tessera.operators.model import BlockMixture


def _scores(spark, done, cells, p):
    truth = labels.blocks_by_arithmetic(cells.select("row_id", "k").distinct(), cells.select("col_id", "l").distinct(), p)
    return score.scores(labels.blocks_by_arithmetic(done.row_labels, done.col_labels, p), truth, ["row_id", "col_id"]).first()


def test_stats_add_and_remove():
    x = np.random.default_rng(0).normal(size=(6, 5, 2))
    cols = np.array([0, 1, 0, 1, 1])
    rows = gibbs.cell_stats(x, cols, 2)
    whole = Stats.zeros((2,), 2)
    for r in range(6):
        whole.add(slice(None), rows[r])
    whole.add(slice(None), rows[3], -1)
    want = gibbs.cell_stats(np.delete(x, 3, axis=0).reshape(1, -1, 2), np.tile(cols, 5), 2)[0]
    for a, b in zip(whole.moments(), want.moments(), strict=True):
        assert a == pytest.approx(b)


def test_weights_are_marginals_given_the_cluster():
    rng = np.random.default_rng(7)
    prior = Niw.make([0.2, -0.1], 1.5, np.array([[1.0, 0.2], [0.2, 2.0]]), 4)
    held, new = rng.normal(size=(9, 2)), rng.normal(size=(4, 2))
    of = lambda x: Stats(np.array([float(len(x))]), x.sum(0)[None], (x.T @ x)[None])
    for most in (100, 2_000_000):
        marginal = gibbs.Marginals(prior, most)
        want = prior.update(*moments(held)).log_marginal(*moments(new))
        assert (marginal.of(of(held) + of(new)) - marginal.of(of(held)))[0] == pytest.approx(float(want))


def test_row_sweep_separates_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-5, 1, (10, 8, 1)), rng.normal(5, 1, (10, 8, 1))])
    out = gibbs.row_sweep(x, list(range(20)), np.zeros(20, int), np.zeros(8, int), Niw.make(0, 1, 1, 2), 1.0, Stats.zeros((1, 1), 1), 3, sweeps=4)
    assert len(set(out[:10])) == len(set(out[10:])) == 1 and out[0] != out[10]


def test_merge_and_column_sweep():
    rng = np.random.default_rng(2)
    prior = Niw.make(0, 1, 1, 2)
    parts = []
    for w in range(3):
        for k, mean in enumerate((-4, 4)):
            x = rng.normal(mean, 1, (12, 1))
            parts.append((w, k, 12, Stats(np.array([12.0]), x.sum(0)[None], (x.T @ x)[None])))
    merged = gibbs.merge_fold(parts, prior, 1.0, 5)
    assert merged == [0, 1] * 3
    columns = Stats.zeros((6, 1), 1)
    for j in range(6):
        x = rng.normal(-3 if j < 3 else 3, 1, (40, 1))
        columns.n[j], columns.total[j], columns.square[j] = 40, x.sum(0), x.T @ x
    for compat in (False, True):
        out = gibbs.column_sweep(columns, np.zeros(6, int), prior, 1.0, 7, compat)
        out = gibbs.column_sweep(columns, out, prior, 1.0, 8, compat)
        assert sorted(set(out)) == list(range(len(set(out))))
    assert len(set(out[:3])) == len(set(out[3:])) == 1 and out[0] != out[3]


def test_fit_finds_the_blocks(spark):
    cells = datagen.fixture_100(spark, 4, shuffle=True)
    done = BlockMixture(seed=2, workers=3).fit(cells, max_iter=5)
    got = _scores(spark, done, cells, 100)
    assert got.ari > 0.95 and got.nmi > 0.95
    assert done.row_labels.count() == 100 and done.col_labels.count() == 100


@pytest.mark.parametrize("settings", [{"workers": 1}, {"merge_space": "row_mean"}, {"compat": True}])
def test_fit_variants(spark, settings):
    cells = datagen.block_matrix(spark, (12, 10), (6, 6), [[-4.0, 0.0], [4.0, 8.0]], [[0.5, 0.5], [0.5, 0.5]], seed=3)
    done = BlockMixture(seed=1, **{"workers": 2} | settings).fit(cells, max_iter=5)
    assert _scores(spark, done, cells, 12).ari > 0.7


def test_fit_of_vectors_from_given_labels(spark):
    eye = [[1.0, 0.0], [0.0, 1.0]]
    cells = datagen.vector_blocks(spark, (8, 8), (5, 5), [[[0, 0], [6, 6]], [[-6, 6], [6, -6]]], [[eye, eye], [eye, eye]], seed=1)
    rows = cells.select("row_id", "k").distinct()
    cols = cells.select("col_id", "l").distinct()
    done = BlockMixture(seed=1, workers=2, prior="covariance").fit(cells, max_iter=3, row_labels=rows, col_labels=cols)
    assert _scores(spark, done, cells, 10).ari > 0.9


def test_iterations_are_told(spark, capsys):
    from tessera.sources.io import show_time

    cells = datagen.block_matrix(spark, (6, 6), (3, 3), [[0, 5], [5, 0]], [[1, 1], [1, 1]], seed=1)
    BlockMixture(seed=1, workers=2).fit(cells.select("row_id", "col_id", "x"), max_iter=2, tell=show_time)
    assert [line.split(":")[0] for line in capsys.readouterr().out.splitlines() if line.startswith("iteration")] == ["iteration 1", "iteration 2"]


def test_same_seed_same_labels(spark):
    cells = datagen.block_matrix(spark, (9, 9), (4, 4), [[-3.0, 0.0], [3.0, 6.0]], [[0.5, 0.5], [0.5, 0.5]], seed=5)
    runs = [sorted(map(tuple, BlockMixture(seed=9, workers=2).fit(c, max_iter=2).row_labels.collect())) for c in (cells, cells.repartition(7))]
    assert runs[0] == runs[1]


def test_bad_input(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "row_id long, col_id int, x double")
    with pytest.raises(ValueError, match="dense"):
        BlockMixture().fit(cells)
    with pytest.raises(ValueError, match="no cells"):
        BlockMixture().fit(cells.limit(0))
    with pytest.raises(ValueError, match="dimension"):
        BlockMixture(prior=Niw.identity(2)).fit(cells.where("row_id = 0"))
    with pytest.raises(ValueError):
        BlockMixture(alpha=0)


def test_generator_checks_shapes(spark):
    with pytest.raises(ValueError):
        datagen.block_matrix(spark, (2, 2), (3,), [[0.0]], [[1.0]])
    mixed = datagen.block_matrix(spark, (300, 300), (10,), [[0.0, 100.0]], [[0.01, 0.01]], mixing=0.5)
    share = mixed.agg(F.avg(((F.col("x") > 50).cast("int") != (F.col("k") == 1).cast("int")).cast("int"))).first()[0]
    assert 0.2 < share < 0.3
