import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.niw import Niw, moments
from tessera.operators import datagen, gibbs, labels, posterior, score, stats
from tessera.operators.gibbs import Stats

# The global clusters of the published label-mapping fixture, worker by worker; a worker's local ids count from 0.
GLOBAL_BY_WORKER = (
    (4, 4, 6, 0, 0, 0, 6, 7, 1),
    (0, 7, 6),
    (7, 6, 6, 7, 7, 8, 2, 9, 4),
    (8, 8, 0),
    (2, 8, 1, 1, 3, 3, 7, 5),
    (1, 2),
    (3,),
    (2, 3, 0, 5, 9),
    (9, 1),
    (1, 2, 6, 9, 1),
)


def test_local_clusters_map_to_global_ones(spark):
    rows = [(w, k, g) for w, held in enumerate(GLOBAL_BY_WORKER) for k, g in enumerate(held)]
    assigned = spark.createDataFrame(rows, "worker_id long, local_k long, global_k long").repartition(3)
    got = labels.cluster_map(assigned.select("worker_id", "local_k"), assigned)
    assert sorted(map(tuple, got.collect())) == rows and len(rows) == 47


def test_numbers_follow_parts_and_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("row_id"), (F.col("id") % 3).alias("k"))
    got = {r.row_id: r.place for r in labels.numbered(df, ["k"], ["row_id"], "place").collect()}
    want = sorted((r.k, r.row_id) for r in df.collect())
    assert got == {row: i for i, (_, row) in enumerate(want)}
    ids = spark.range(400).withColumnRenamed("id", "row_id")
    order = [r.new for r in datagen.permutation(ids, "row_id", 3, "new").orderBy("row_id").collect()]
    assert sorted(order) == list(range(400)) and order != sorted(order)


def test_reordered_matrix(spark):
    cells = datagen.block_matrix(spark, (5, 4), (3, 2), [[0, 1], [2, 3]], [[1, 1], [1, 1]], seed=2)
    k, l = {r: (r * 5) % 2 for r in range(9)}, {c: (c * 3) % 2 for c in range(5)}  # noqa: E741
    rows = spark.createDataFrame(list(k.items()), "row_id long, k long")
    cols = spark.createDataFrame(list(l.items()), "col_id long, l long")
    new_row = {r: i for i, r in enumerate(sorted(k, key=lambda r: (k[r], r)))}
    new_col = {c: i for i, c in enumerate(sorted(l, key=lambda c: (l[c], c)))}
    want = {(new_row[r.row_id], new_col[r.col_id]): r.x for r in cells.collect()}
    assert {(r.new_row, r.new_col): r.x for r in labels.reordered(cells, rows, cols).collect()} == want
    turned = labels.transposed(labels.transposed(cells))
    assert sorted(map(tuple, turned.collect())) == sorted((r.row_id, r.col_id, r.x) for r in cells.collect())


def test_block_scores_need_no_cells(spark):
    draw = np.random.default_rng(5)
    rows, true_rows = draw.integers(0, 3, 30), draw.integers(0, 4, 30)
    cols, true_cols = draw.integers(0, 2, 8), draw.integers(0, 3, 8)
    table = lambda v, at, name: spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], f"{at} long, {name} long")
    est, true = (table(rows, "row_id", "k"), table(cols, "col_id", "l")), (table(true_rows, "row_id", "k"), table(true_cols, "col_id", "l"))
    by_cell = score.scores(labels.blocks_by_arithmetic(*est, 10), labels.blocks_by_arithmetic(*true, 10), ["row_id", "col_id"]).first()
    assert tuple(score.block_scores(*est, *true).first()) == pytest.approx(tuple(by_cell))
    assert score.n_blocks(*est).first().n_clusters == 6


def test_moments_of_vectors(spark):
    draw = np.random.default_rng(6)
    x, k = draw.normal(3, 2, (90, 4)), draw.integers(0, 3, 90)
    df = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(k, x, strict=True)], "k long, v array<double>").repartition(4)
    for r in stats.pair_moments(df, "v", 4, "k").collect():
        own = x[k == r.k]
        assert r.n == len(own) and r["mean"] == pytest.approx(own[:, r.i].mean())
        assert r.s == pytest.approx(((own[:, r.i] - own[:, r.i].mean()) * (own[:, r.j] - own[:, r.j].mean())).sum(), abs=1e-9)
    centre = [0.5, -0.5, 0.0, 1.0]
    full = {(r.i, r.j): r.cov for r in stats.covariance_about(df, "v", centre).collect()}
    want = (x - centre).T @ (x - centre) / 89
    assert all(full[i, j] == pytest.approx(want[i, j], abs=1e-7) for i in range(4) for j in range(4))
    diag = {(r.i, r.j): r.cov for r in stats.covariance_about(df, "v", centre, diagonal=True).collect()}
    assert diag == {(i, i): pytest.approx(x[:, i].var(ddof=1), abs=1e-7) for i in range(4)}


def test_posterior_draws(spark):
    draw = np.random.default_rng(9)
    x, k = draw.normal(0, 1, (4000, 2)) + np.array([[4, -4]]), draw.integers(0, 2, 4000)
    x[k == 1] += 10
    cells = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(k, x, strict=True)], "k long, x array<double>")
    prior = Niw.identity(2)
    got = {r.k: r for r in posterior.posterior_sample(cells, prior, ["k"], seed=3).collect()}
    assert set(got) == {0, 1} and got[0].n + got[1].n == 4000
    for a, r in got.items():
        assert r["mean"] == pytest.approx(x[k == a].mean(axis=0).tolist(), abs=0.2)
        assert np.array(r.covariance).reshape(2, 2) == pytest.approx(np.eye(2), abs=0.2)
    again = {r.k: r for r in posterior.posterior_sample(cells.repartition(7), prior, ["k"], seed=3).collect()}
    assert all(again[a]["mean"] == pytest.approx(r["mean"]) for a, r in got.items())
    single = spark.createDataFrame([(0, 1, 2.0), (0, 1, None), (0, 0, 1.0)], "l long, k long, x double")
    blocks = posterior.posterior_sample(single, Niw.make(0, 1, 1, 3), ["l", "k"]).collect()
    assert sorted((r.l, r.k, r.n) for r in blocks) == [(0, 0, 1), (0, 1, 1)]


def test_published_merge_weights():
    draw = np.random.default_rng(4)
    prior = Niw.make(0, 1, 1, 2)
    parts = []
    for w in range(2):
        x = draw.normal(0, 1, (12, 1))
        parts.append((w, 0, 12, Stats(np.array([12.0]), x.sum(0)[None], (x.T @ x)[None])))
    entered = []
    for *_, held in parts:
        after = gibbs.posterior(prior, held)
        entered.append(Stats.of_moments(after.nu, after.mu, after.psi))
    cluster = gibbs.posterior(prior, entered[0])
    joined = float(cluster.log_marginal(*entered[1].moments()).sum() + np.log(cluster.nu[0] - 1))
    fresh = float(prior.log_marginal(*entered[1].moments()).sum() + np.log(3.0))
    p = 1 / (1 + np.exp(fresh - joined))
    merged = [gibbs.merge_fold(parts, prior, 3.0, seed, compat=True)[1] for seed in range(300)]
    assert np.mean([m == 0 for m in merged]) == pytest.approx(p, abs=0.1)


def test_counts_have_their_part_in_a_table():
    for d in (1, 2, 3):
        prior = Niw.from_moments(50, np.zeros(d), np.eye(d) * 9, "precision")
        held = gibbs.counted_part(prior, 3000)
        x = np.random.default_rng(d).normal(size=(40, d))
        n, mean, scatter = moments(x)
        whole = held[40] - (prior.nu + 40) / 2 * np.linalg.slogdet(prior.update(n, mean, scatter).psi)[1]
        assert whole == pytest.approx(float(prior.log_marginal(n, mean, scatter)))


def test_a_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from tessera.operators.model import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    assert shared_folder(session("spark://host:7077", "hdfs:/x")) == "hdfs:/x"
    assert shared_folder(session("local[4]")).endswith("tessera-shared")
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
