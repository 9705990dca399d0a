"""Named queries over the star-schema tables, each beside the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import niw, rng, special
from ..functions.niw import Scalar
from ..operators import datagen, labels, posterior, score, stats
from .matrices import B_SQL, COLUMN_CLUSTERS, DIMENSIONS, E_SQL, S_SQL, SEED, U_SQL, b_cells, e_cells, e_rows, s_cells, table, u_cells

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The prior of the queries: location, its weight, scale, degrees of freedom; and the concentrations.
MU, KAPPA, PSI, NU = 0.0, 1.0, 0.25, 2.0
ALPHA, BETA = 5.0, 2.0


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r(column: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def q(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def shown(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return df.select(*(F.col(k).cast("long").alias(k) for k in keys), *(r(c).alias(n) for n, c in columns.items()))


def prior() -> Scalar:
    """Made when it is used: Columns need a session."""
    return Scalar.of(MU, KAPPA, PSI, NU)


MOMENTS = "count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s"


def posterior_sql(n: str, m: str, s: str, mu=f"{MU}", kappa=f"{KAPPA}", psi=f"{PSI}", nu=f"{NU}") -> dict[str, str]:
    return {
        "kappa": f"({kappa} + {n})",
        "nu": f"({nu} + {n})",
        "mu": f"(({kappa} * {mu} + {n} * {m}) / ({kappa} + {n}))",
        "psi": f"({psi} + {s} + {n} * {kappa} / ({kappa} + {n}) * ({m} - {mu}) * ({m} - {mu}))",
    }


def marginal_sql(n: str, m: str, s: str, mu=f"{MU}", kappa=f"{KAPPA}", psi=f"{PSI}", nu=f"{NU}") -> str:
    p = posterior_sql(n, m, s, mu, kappa, psi, nu)
    return f"(-{n} / 2.0 * ln(pi()) + ln({kappa} / {p['kappa']}) / 2 + lgamma({p['nu']} / 2) - lgamma({nu} / 2) + {nu} / 2 * ln({psi}) - {p['nu']} / 2 * ln({p['psi']}))"


def student_sql(x: str, mu: str, sigma: str, nu: str) -> str:
    return f"(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2) - ln(pi() * {nu}) / 2 - ln({sigma}) / 2 - ({nu} + 1) / 2 * ln(1 + ({x} - {mu}) * ({x} - {mu}) / {sigma} / {nu}))"


def uniform_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) / 4294967296.0)"


# ---------------------------------------------------------------- matrices, shapes, dealing rows


@query(f"WITH {E_SQL} SELECT row_id, col_id, {q('x')} AS x FROM cells")
def matrix_long(spark, sf_dir):
    return shown(e_cells(spark, sf_dir), ["row_id", "col_id"], x=F.col("x"))


@query(f"WITH {B_SQL} SELECT row_key, dense_rank() OVER (ORDER BY col_key) - 1 AS col_id, {q('x')} AS x FROM b")
def matrix_brand(spark, sf_dir):
    return shown(labels.dense(b_cells(spark, sf_dir), [], "col_key", "col_id"), ["row_key", "col_id"], x=F.col("x"))


@query(f"WITH {U_SQL} SELECT row_key, col_key, {q('x')} AS x FROM u")
def matrix_user(spark, sf_dir):
    return u_cells(spark, sf_dir).select("row_key", "col_key", r(F.col("x")).alias("x"))


@query(f"WITH {S_SQL} SELECT row_key, count(*) AS n_cols, {q('min(x)', 4)} AS low, {q('max(x)', 4)} AS high FROM s GROUP BY 1")
def matrix_supplier_range(spark, sf_dir):
    return s_cells(spark, sf_dir).groupBy("row_key").agg(F.count(F.lit(1)).alias("n_cols"), r(F.min("x"), 4).alias("low"), r(F.max("x"), 4).alias("high"))


@query(f"WITH {E_SQL} SELECT CAST(count(DISTINCT row_id) AS BIGINT) AS n_rows, CAST(max(col_id) + 1 AS BIGINT) AS n_cols FROM cells")
def matrix_shape(spark, sf_dir):
    return stats.shape(e_cells(spark, sf_dir))


@query(f"WITH {E_SQL} SELECT worker_id, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM rows_e GROUP BY 1")
def worker_split(spark, sf_dir):
    return e_rows(spark, sf_dir).groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@query(f"WITH {E_SQL} SELECT worker_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows FROM rows_e GROUP BY 1")
def partition_collapse(spark, sf_dir):
    held = labels.collapsed(e_rows(spark, sf_dir))
    return held.select("worker_id", F.array_join(F.transform("rows", lambda v: v.cast("string")), ",").alias("rows"))


@query(f"WITH {E_SQL} SELECT col_id AS row_id, row_id AS col_id, {q('x')} AS x FROM cells")
def transposed(spark, sf_dir):
    return shown(labels.transposed(e_cells(spark, sf_dir)), ["row_id", "col_id"], x=F.col("x"))


@query(f"WITH {E_SQL} SELECT row_id, string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY col_id) AS cols, {q('sum(x)')} AS total FROM cells WHERE l = 0 GROUP BY 1")
def flattened(spark, sf_dir):
    rows = e_rows(spark, sf_dir).select("row_id", F.flatten(F.array(F.transform("v", lambda x, i: F.struct(i.cast("long").alias("c"), x.alias("x"))))).alias("cells"))
    kept = F.filter("cells", lambda c: c["c"] % COLUMN_CLUSTERS == 0)
    return rows.select("row_id", F.array_join(F.transform(kept, lambda c: c["c"].cast("string")), ",").alias("cols"), r(F.aggregate(kept, F.lit(0.0), lambda a, c: a + c["x"])).alias("total"))


# ---------------------------------------------------------------- statistics


@query(f"WITH {E_SQL} SELECT row_id, {q('avg(x)')} AS mean FROM cells GROUP BY 1")
def row_means(spark, sf_dir):
    return shown(stats.row_means(e_cells(spark, sf_dir)), ["row_id"], mean=F.col("mean"))


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    return shown(df, [*keys, "n"], mean=F.col("mean"), s=F.col("s"))


def _moments_sql(keys: str, source: str = "cells") -> str:
    return f"WITH {E_SQL} SELECT {keys}{', ' if keys else ''}count(*) AS n, {q('avg(x)')} AS mean, {q('var_pop(x) * count(*)')} AS s FROM {source}{' GROUP BY ' + keys if keys else ''}"


@query(_moments_sql(""))
def global_moments(spark, sf_dir):
    return _moments(e_cells(spark, sf_dir).agg(*stats.moments()), [])


@query(_moments_sql("worker_id"))
def worker_moments(spark, sf_dir):
    return _moments(stats.grouped(e_cells(spark, sf_dir), "worker_id"), ["worker_id"])


@query(_moments_sql(""))
def merged_moments(spark, sf_dir):
    return _moments(stats.merged(stats.grouped(e_cells(spark, sf_dir), "worker_id")), [])


@query(_moments_sql("l, k"))
def merged_block_moments(spark, sf_dir):
    return _moments(stats.merged_raw(stats.grouped(e_cells(spark, sf_dir), "worker_id", "col_id", "l", "k"), "l", "k"), ["l", "k"])


@query(_moments_sql("l, k"))
def block_moments(spark, sf_dir):
    return _moments(stats.grouped(e_cells(spark, sf_dir), "l", "k"), ["l", "k"])


@query(_moments_sql("col_id, k"))
def column_moments(spark, sf_dir):
    return _moments(stats.grouped(e_cells(spark, sf_dir), "col_id", "k"), ["col_id", "k"])


@query(_moments_sql("worker_id, col_id, k"))
def worker_column_moments(spark, sf_dir):
    return _moments(stats.grouped(e_cells(spark, sf_dir), "worker_id", "col_id", "k"), ["worker_id", "col_id", "k"])


@query(f"WITH {E_SQL}, means AS (SELECT worker_id, k, row_id, avg(x) AS x FROM cells GROUP BY ALL) SELECT worker_id, k, count(*) AS n, {q('avg(x)')} AS mean, {q('var_pop(x) * count(*)')} AS s FROM means GROUP BY 1, 2")
def row_cluster_moments(spark, sf_dir):
    means = e_cells(spark, sf_dir).groupBy("worker_id", "k", "row_id").agg(F.avg("x").alias("x"))
    return _moments(stats.grouped(means, "worker_id", "k"), ["worker_id", "k"])


def _part(i: str) -> str:
    """A component of the embedding, numbered from 0, in SQL."""
    return f"CAST(embedding[{i} + 1] AS DOUBLE)"


_PAIRS = f"FROM embeddings, (SELECT unnest(range({DIMENSIONS})) AS i) a, (SELECT unnest(range({DIMENSIONS})) AS j) b"


@query(f"SELECT CAST(label AS BIGINT) AS k, i, j, count(*) AS n, {q('avg(' + _part('i') + ')')} AS mean, {q('covar_pop(' + _part('i') + ', ' + _part('j') + ') * count(*)')} AS s {_PAIRS} GROUP BY 1, 2, 3")
def vector_moments(spark, sf_dir):
    return _moments(stats.pair_moments(e_rows(spark, sf_dir), "v", DIMENSIONS, "k"), ["k", "i", "j"])


@query(f"SELECT i, {q('covar_samp(' + _part('i') + ', ' + _part('i + 1') + ')')} AS cov FROM embeddings, (SELECT unnest(range({DIMENSIONS - 1})) AS i) a GROUP BY 1")
def covariance_scalar(spark, sf_dir):
    """The covariance of every component with the next."""
    pairs = [F.struct(F.lit(i).cast("long").alias("i"), F.col(f"c{i}").alias("cov")) for i in range(DIMENSIONS - 1)]
    held = e_rows(spark, sf_dir).agg(*(F.covar_samp(F.col("v")[i], F.col("v")[i + 1]).alias(f"c{i}") for i in range(DIMENSIONS - 1)))
    return shown(held.select(F.explode(F.array(*pairs)).alias("e")).select("e.*"), ["i"], cov=F.col("cov"))


def _half_up_sql(x: str) -> str:
    return f"floor(({x}) * 1e8 + 0.5) / 1e8"


_CENTRE = [(i % 5 - 2) / 20 for i in range(DIMENSIONS)]


@query(f"SELECT i, j, {q(_half_up_sql('sum((' + _part('i') + ' - (i % 5 - 2) / 20.0) * (' + _part('j') + ' - (j % 5 - 2) / 20.0)) / (count(*) - 1)'), 8)} AS cov {_PAIRS} GROUP BY 1, 2")
def covariance_full(spark, sf_dir):
    return stats.covariance_about(e_rows(spark, sf_dir), "v", _CENTRE).select("i", "j", r(F.col("cov"), 8).alias("cov"))


@query(f"SELECT i, i AS j, {q(_half_up_sql('var_samp(' + _part('i') + ')'), 8)} AS cov FROM embeddings, (SELECT unnest(range({DIMENSIONS})) AS i) a GROUP BY 1")
def covariance_diag(spark, sf_dir):
    """Every component around its own mean, whatever the centre."""
    return stats.covariance_about(e_rows(spark, sf_dir), "v", _CENTRE, diagonal=True).select("i", "j", r(F.col("cov"), 8).alias("cov"))


@query(f"WITH {E_SQL}, sd AS (SELECT col_id, stddev_samp(x) AS sd FROM cells GROUP BY 1) SELECT row_id, col_id, {q('x / sd')} AS x FROM cells JOIN sd USING (col_id)")
def column_scale(spark, sf_dir):
    return shown(stats.scaled_columns(e_cells(spark, sf_dir)), ["row_id", "col_id"], x=F.col("x"))


@query(f"WITH {E_SQL} SELECT row_id, col_id, {q('x * ((col_id % 7 - 3) / 2.0)')} AS x FROM cells")
def weighted_cells(spark, sf_dir):
    held = stats.weighted(e_rows(spark, sf_dir), "v", F.array(*(F.lit((i % 7 - 3) / 2) for i in range(DIMENSIONS))))
    return shown(held.select("row_id", F.posexplode("v").alias("col_id", "x")), ["row_id", "col_id"], x=F.col("x"))


@query("SELECT vec_id AS row_id, " + q("list_aggregate(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), 'avg')") + " AS mean FROM embeddings")
def component_means(spark, sf_dir):
    return shown(e_rows(spark, sf_dir), ["row_id"], mean=special.array_mean(F.col("v")))


@query(f"WITH {E_SQL}, t AS (SELECT row_id, sum(x) AS total, max(CASE WHEN col_id = {DIMENSIONS - 1} THEN x END) AS final FROM cells GROUP BY 1) SELECT row_id, col_id AS i, {q('x * total')} AS row_sum, {q('x * final')} AS at_end, {q('x * x')} AS diag FROM cells JOIN t USING (row_id)")
def unit_covariance(spark, sf_dir):
    """Rows of every vector's outer product with itself: their sums and last entries, and the diagonal form."""
    held = e_rows(spark, sf_dir).select("row_id", special.unit_covariance(F.col("v")).alias("full"), special.unit_covariance(F.col("v"), full=False).alias("diag"))
    rows = held.select("row_id", "full", F.posexplode("diag").alias("i", "diag"))
    row = F.slice("full", F.col("i") * DIMENSIONS + 1, DIMENSIONS)
    return shown(rows, ["row_id", "i"], row_sum=F.aggregate(row, F.lit(0.0), lambda a, v: a + v), at_end=F.element_at(row, -1), diag=F.col("diag"))


@query(f"""WITH m AS (SELECT CAST(label AS BIGINT) AS k, i, covar_pop({_part('2 * i')}, {_part('2 * i')}) * count(*) + 1 AS a, covar_pop({_part('2 * i')}, {_part('2 * i + 1')}) * count(*) AS b, covar_pop({_part('2 * i + 1')}, {_part('2 * i + 1')}) * count(*) + 1 AS c FROM embeddings, (SELECT unnest(range({DIMENSIONS // 2})) AS i) p GROUP BY 1, 2)
SELECT k, i, """ + ", ".join(f"{q(e)} AS {n}" for n, e in (("det", "a * c - b * b"), ("log_det", "ln(a * c - b * b)"), ("i00", "c / (a * c - b * b)"), ("i01", "-b / (a * c - b * b)"), ("trace", "a + c"), ("d1", "c"))) + " FROM m")
def matrix_algebra(spark, sf_dir):
    """Scatter matrices of neighbouring pairs of components, of every cluster."""
    pairs = e_rows(spark, sf_dir).select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS // 2 - 1)), lambda i: F.slice("v", 2 * i + 1, 2))).alias("i", "v"))
    held = pairs.groupBy("k", "i").agg(*stats.vector_moments("v", 2))
    eye = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 1.0)))
    held = held.withColumn("p", special.added(F.col("s"), eye))
    p = F.col("p")
    return shown(held, ["k", "i"], det=special.det2(p), log_det=special.log_det(p, 2), i00=special.inv2(p)[0], i01=special.inv2(p)[1], trace=special.trace(p, 2), d1=special.diagonal(p, 2)[1])


@query("SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, floor(l_extendedprice * l_discount * 100.0 + 0.5) / 100.0 AS half_up FROM lineitem")
def half_up_round(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), special.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("half_up"))


@query(f"SELECT CAST(p_size AS BIGINT) AS size, CAST(CASE WHEN p_size <= 20 THEN factorial(p_size) ELSE 0 END AS BIGINT) AS factorial, {q('lgamma(p_size + 1.0)')} AS log_factorial, {q('0.5 * ln(pi()) + lgamma(p_size / 2.0 + 1) + lgamma(p_size / 2.0 + 0.5)')} AS mvlgamma_2 FROM part GROUP BY p_size")
def gamma_functions(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("size")).distinct()
    return sizes.select("size", F.coalesce(special.factorial(F.when(F.col("size") <= 20, F.col("size"))), F.lit(0)).cast("long").alias("factorial"), r(special.log_factorial(F.col("size"))).alias("log_factorial"), r(special.mvlgamma(F.col("size") / 2 + 1, 2)).alias("mvlgamma_2"))


# ---------------------------------------------------------------- the distribution's algebra


def _blocks(spark, sf_dir) -> DataFrame:
    return stats.grouped(e_cells(spark, sf_dir), "l", "k").withColumn("n", F.col("n").cast("double"))


_BLOCKS_SQL = f"{E_SQL}, blocks AS (SELECT l, k, {MOMENTS} FROM cells GROUP BY 1, 2)"


def _stats() -> tuple[Column, Column, Column]:
    return F.col("n"), F.col("mean"), F.col("s")



def _parameters(df: DataFrame, keys: list[str], p: Scalar) -> DataFrame:
    return shown(df, keys, mu=p.mu, kappa=p.kappa, psi=p.psi, nu=p.nu)


def _parameters_sql(keys: str, p: dict[str, str], source: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"{q(p[c])} AS {c}" for c in ("mu", "kappa", "psi", "nu")) + f" FROM {source}"


@query(f"WITH {_BLOCKS_SQL} " + _parameters_sql("l, k", posterior_sql("n", "m", "s"), "blocks"))
def niw_update(spark, sf_dir):
    return _parameters(_blocks(spark, sf_dir), ["l", "k"], prior().update(*_stats()))


@query(f"WITH {_BLOCKS_SQL} " + _parameters_sql("l, k", posterior_sql("n", "m", "s"), "blocks"))
def block_niw_grid(spark, sf_dir):
    """The grid assembled from statistics per worker, column and cluster."""
    parts = stats.grouped(e_cells(spark, sf_dir), "worker_id", "col_id", "l", "k")
    whole = stats.merged(parts, "l", "k").withColumn("n", F.col("n").cast("double"))
    return _parameters(whole, ["l", "k"], prior().update(*_stats()))


@query(
    f"""WITH {E_SQL}, a AS (SELECT k, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s FROM cells GROUP BY 1), b AS (SELECT k, count(*) AS n1, avg(x) AS m1, var_pop(x) * count(*) AS s1 FROM cells WHERE l > 0 GROUP BY 1) """
    + _parameters_sql("k", posterior_sql("n1", "m1", "s1"), "a JOIN b USING (k)")
)
def niw_downdate(spark, sf_dir):
    """All cells of a row cluster added and those of column cluster 0 removed: as if those had never been there."""
    cells = e_cells(spark, sf_dir)
    every = stats.grouped(cells, "k").withColumn("n", F.col("n").cast("double"))
    gone = stats.grouped(cells.where("l = 0"), "k").select("k", F.col("n").cast("double").alias("n0"), F.col("mean").alias("mean0"), F.col("s").alias("s0"))
    both = every.join(gone, "k")
    return _parameters(both, ["k"], prior().update(*_stats()).downdate(F.col("n0"), F.col("mean0"), F.col("s0")))


@query(f"WITH {_BLOCKS_SQL} SELECT l, k, {q(MU)} AS mu, {q(KAPPA)} AS kappa, {q(PSI)} AS psi, {q(NU)} AS nu FROM blocks")
def niw_roundtrip(spark, sf_dir):
    return _parameters(_blocks(spark, sf_dir), ["l", "k"], prior().update(*_stats()).downdate(*_stats()))


@query(f"WITH {E_SQL}, g AS (SELECT {MOMENTS} FROM cells) SELECT " + ", ".join(f"{q(e)} AS {n}" for n, e in (("mu", "m"), ("precision_psi", "(n - 1) / s"), ("covariance_psi", "s / (n - 1)"), ("scatter_psi", "1 / s"), ("kappa", "1"), ("nu", "2"))) + " FROM g")
def prior_factories(spark, sf_dir):
    g = e_cells(spark, sf_dir).agg(*stats.moments())
    n, s = F.col("n"), F.col("s")
    return shown(g, [], mu=F.col("mean"), precision_psi=(n - 1) / s, covariance_psi=s / (n - 1), scatter_psi=1 / s, kappa=F.lit(1), nu=F.lit(2))


@query(f"WITH {_BLOCKS_SQL} SELECT l, k, CAST(n AS BIGINT) AS n, {q(marginal_sql('n', 'm', 's'), 4)} AS log_marginal FROM blocks")
def log_marginal(spark, sf_dir):
    """Log marginal likelihood of every block of the embedding matrix."""
    return _blocks(spark, sf_dir).select("l", "k", F.col("n").cast("long").alias("n"), r(prior().log_marginal(*_stats()), 4).alias("log_marginal"))


_POST = posterior_sql("n", "m", "s")


@query(f"WITH {_BLOCKS_SQL}, p AS (SELECT l, k, {_POST['mu']} AS mu, {_POST['kappa']} AS kappa, {_POST['psi']} AS psi, CAST({_POST['nu']} AS DOUBLE) AS nu FROM blocks) SELECT row_id, col_id, {q(student_sql('x', 'mu', '((kappa + 1) / (kappa * nu) * psi)', 'nu'))} AS logpdf FROM cells JOIN p USING (l, k)")
def student_logpdf(spark, sf_dir):
    after = prior().update(*_stats())
    params = _blocks(spark, sf_dir).select("l", "k", *after.columns())
    p = Scalar(*(F.col(c) for c in ("mu", "kappa", "psi", "nu")))
    return shown(e_cells(spark, sf_dir).join(F.broadcast(params), ["l", "k"]), ["row_id", "col_id"], logpdf=p.predictive(F.col("x")))


@query(f"WITH {E_SQL}, a AS (SELECT l, k, {MOMENTS} FROM cells WHERE worker_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT l, k, count(*) AS n1, avg(x) AS m1, var_pop(x) * count(*) AS s1 FROM cells WHERE worker_id % 2 = 1 GROUP BY 1, 2) SELECT l, k, {q(marginal_sql('n1', 'm1', 's1', _POST['mu'], _POST['kappa'], _POST['psi'], 'CAST(' + _POST['nu'] + ' AS DOUBLE)'), 4)} AS log_predictive FROM a JOIN b USING (l, k)")
def posterior_predictive(spark, sf_dir):
    """Odd workers' cells, given the even workers' cells of the block."""
    cells = e_cells(spark, sf_dir)
    seen = stats.grouped(cells.where("worker_id % 2 = 0"), "l", "k").withColumn("n", F.col("n").cast("double"))
    new = stats.grouped(cells.where("worker_id % 2 = 1"), "l", "k").select("l", "k", F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("s").alias("s1"))
    value = prior().update(*_stats()).log_marginal(F.col("n1"), F.col("m1"), F.col("s1"))
    return seen.join(new, ["l", "k"]).select("l", "k", r(value, 4).alias("log_predictive"))


_IW_SQL = f"({NU} / 2 * ln({PSI}) - {NU} / 2 * ln(2) - lgamma({NU} / 2) - ({NU} + 2) / 2 * ln(v) - {PSI} / v / 2)"


@query(f"WITH {_BLOCKS_SQL}, t AS (SELECT l, k, s / n AS v FROM blocks) SELECT l, k, {q(_IW_SQL)} AS logpdf FROM t")
def invwishart_logpdf(spark, sf_dir):
    return shown(_blocks(spark, sf_dir), ["l", "k"], logpdf=prior().inverse_wishart_logpdf(F.col("s") / F.col("n")))


@query(f"WITH {_BLOCKS_SQL}, t AS (SELECT l, k, m, s / n AS v FROM blocks) SELECT l, k, {q(f'(-ln(2 * pi()) / 2 - ln(v / {KAPPA}) / 2 - (m - {MU}) * (m - {MU}) / (v / {KAPPA}) / 2 + ' + _IW_SQL[1:])} AS logpdf FROM t")
def niw_logpdf(spark, sf_dir):
    return shown(_blocks(spark, sf_dir), ["l", "k"], logpdf=prior().logpdf(F.col("mean"), F.col("s") / F.col("n")))


@query(f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS clusters, {q(f'count(*) * ln({ALPHA}) + sum(lgamma(CAST(n AS DOUBLE))) - (lgamma({ALPHA} + sum(n)) - lgamma({ALPHA}))', 4)} AS log_prob FROM c")
def crp_logprob(spark, sf_dir):
    counts = labels.counts(e_rows(spark, sf_dir), "k")
    n = F.sum("n").cast("double")
    value = F.count(F.lit(1)) * math.log(ALPHA) + F.sum(special.lgamma(F.col("n").cast("double"))) - special.lgamma(n + ALPHA) + math.lgamma(ALPHA)
    return counts.agg(F.count(F.lit(1)).alias("clusters"), r(value, 4).alias("log_prob"))


_CELL_SQL = "(-ln(2 * pi()) / 2 - ln(v) / 2 - (x - m) * (x - m) / v / 2)"
_NIW_SQL = f"(-ln(2 * pi()) / 2 - ln(v / {KAPPA}) / 2 - (m - {MU}) * (m - {MU}) / (v / {KAPPA}) / 2 + {_IW_SQL})"


def _crp_sql(source: str, label: str, n: str, alpha: float) -> str:
    return f"(SELECT count(*) * ln({alpha}) + sum(lgamma(CAST({n} AS DOUBLE))) - (lgamma({alpha} + sum({n})) - lgamma({alpha})) FROM (SELECT {label}, count(*) AS {n} FROM {source} GROUP BY 1))"


@query(f"WITH {_BLOCKS_SQL}, t AS (SELECT l, k, m, s / n AS v FROM blocks), cols AS (SELECT DISTINCT col_id, l FROM cells) SELECT {q(f'(SELECT sum({_CELL_SQL}) FROM cells JOIN t USING (l, k)) + (SELECT sum({_NIW_SQL}) FROM t) + ' + _crp_sql('rows_e', 'k', 'c', ALPHA) + ' + ' + _crp_sql('cols', 'l', 'c', BETA), 2)} AS log_joint")
def joint_loglik(spark, sf_dir):
    """Log joint density of labels, block parameters (the blocks' own means and variances) and cells."""
    cells = e_cells(spark, sf_dir)
    parts = _blocks(spark, sf_dir).select("l", "k", "mean", (F.col("s") / F.col("n")).alias("v"))
    own = parts.agg(F.sum(prior().logpdf(F.col("mean"), F.col("v"))).alias("own"))
    every = cells.join(F.broadcast(parts), ["l", "k"]).agg(F.sum(niw.normal_logpdf(F.col("x"), F.col("mean"), F.col("v"))).alias("cells"))

    def crp(df: DataFrame, label: str, alpha: float, name: str) -> DataFrame:
        n = F.sum("n").cast("double")
        value = F.count(F.lit(1)) * math.log(alpha) + F.sum(special.lgamma(F.col("n").cast("double"))) - special.lgamma(n + alpha) + math.lgamma(alpha)
        return labels.counts(df, label).agg(value.alias(name))

    rows = crp(e_rows(spark, sf_dir), "k", ALPHA, "rows")
    cols = crp(cells.select("col_id", "l").distinct(), "l", BETA, "cols")
    return every.crossJoin(own).crossJoin(rows).crossJoin(cols).select(r(F.col("cells") + F.col("own") + F.col("rows") + F.col("cols"), 2).alias("log_joint"))


# ---------------------------------------------------------------- one step of the sampler


def _row_weights(spark, sf_dir) -> DataFrame:
    """row_id, cluster (-1: a new one) and log weight; the grid holds all rows, as at the beginning of a step."""
    cells = e_cells(spark, sf_dir)
    own = stats.grouped(cells, "row_id", "l").select("row_id", "l", F.col("n").cast("double").alias("rn"), F.col("mean").alias("rm"), F.col("s").alias("rs"))
    sizes = e_rows(spark, sf_dir).groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    grid = stats.grouped(cells, "l", "k").withColumn("n", F.col("n").cast("double")).join(F.broadcast(sizes), "k")
    value = prior().update(*_stats()).log_marginal(F.col("rn"), F.col("rm"), F.col("rs"))
    held = own.join(F.broadcast(grid), "l").groupBy("row_id", "k").agg((F.sum(value) + F.log(F.first("size"))).alias("logw"))
    fresh = own.groupBy("row_id").agg((F.sum(prior().log_marginal(F.col("rn"), F.col("rm"), F.col("rs"))) + math.log(ALPHA)).alias("logw")).select("row_id", F.lit(-1).cast("long").alias("k"), "logw")
    return held.select("row_id", "k", "logw").unionByName(fresh)


_ROW_SQL = f"""{_BLOCKS_SQL}, own AS (SELECT row_id, l, count(*) AS rn, avg(x) AS rm, var_pop(x) * count(*) AS rs FROM cells GROUP BY 1, 2),
sizes AS (SELECT k, count(*) AS size FROM rows_e GROUP BY 1),
weights AS (SELECT row_id, k, sum({marginal_sql('rn', 'rm', 'rs', _POST['mu'], _POST['kappa'], _POST['psi'], 'CAST(' + _POST['nu'] + ' AS DOUBLE)')}) + ln(first(size)) AS logw FROM own JOIN blocks USING (l) JOIN sizes USING (k) GROUP BY 1, 2
UNION ALL SELECT row_id, CAST(-1 AS BIGINT), sum({marginal_sql('rn', 'rm', 'rs')}) + ln({ALPHA}) FROM own GROUP BY 1)"""


@query(f"WITH {_ROW_SQL} SELECT row_id, k, {q('logw', 4)} AS logw FROM weights WHERE k >= 0")
def row_membership_logw(spark, sf_dir):
    return _row_weights(spark, sf_dir).where("k >= 0").select("row_id", "k", r(F.col("logw"), 4).alias("logw"))


@query(f"WITH {_ROW_SQL} SELECT row_id, {q('logw', 4)} AS logw FROM weights WHERE k = -1")
def new_row_logw(spark, sf_dir):
    return _row_weights(spark, sf_dir).where("k = -1").select("row_id", r(F.col("logw"), 4).alias("logw"))


@query(f"WITH {_ROW_SQL}, top AS (SELECT row_id, max(logw) AS t FROM weights GROUP BY 1) SELECT row_id, {q('max(t) + ln(sum(exp(logw - t)))', 4)} AS lse FROM weights JOIN top USING (row_id) GROUP BY 1")
def log_sum_exp(spark, sf_dir):
    return rng.log_sum_exp(_row_weights(spark, sf_dir), ["row_id"], "logw").select("row_id", r(F.col("lse"), 4).alias("lse"))


_SOFTMAX_SQL = f"{_ROW_SQL}, e AS (SELECT row_id, CASE WHEN k < 0 THEN 1000 ELSE k END AS k, exp(logw - max(logw) OVER (PARTITION BY row_id)) AS e FROM weights), p AS (SELECT row_id, k, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e)"


def _probabilities(spark, sf_dir) -> DataFrame:
    weights = _row_weights(spark, sf_dir).withColumn("k", F.when(F.col("k") < 0, F.lit(1000).cast("long")).otherwise(F.col("k")))
    return rng.softmax(weights, ["row_id"], "logw").select("row_id", "k", "p")


@query(f"WITH {_SOFTMAX_SQL} SELECT row_id, k, {q('p', 5)} AS p FROM p")
def softmax(spark, sf_dir):
    return _probabilities(spark, sf_dir).select("row_id", "k", r(F.col("p"), 5).alias("p"))


@query(f"WITH {_SOFTMAX_SQL} SELECT row_id, k, {q('sum(p) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING)', 5)} AS cum FROM p")
def running_probability(spark, sf_dir):
    return rng.running_sum(_probabilities(spark, sf_dir), ["row_id"], "k", "p").select("row_id", "k", r(F.col("cum"), 5).alias("cum"))


_U_ROW = uniform_sql(f"{SEED}", "'row'", "row_id")


@query(f"WITH {_SOFTMAX_SQL}, c AS (SELECT row_id, k, sum(p) OVER (PARTITION BY row_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM p) SELECT row_id, coalesce(min(CASE WHEN cum >= {_U_ROW} THEN k END), max(k)) AS drawn FROM c GROUP BY row_id")
def row_draw(spark, sf_dir):
    u = rng.uniform(SEED, "row", F.col("row_id"))
    return rng.draw(_probabilities(spark, sf_dir), ["row_id"], "k", "p", u)


@query(f"SELECT vec_id AS row_id, {q(uniform_sql(str(SEED), 'vec_id'), 9)} AS u, CAST(least(ceil({uniform_sql(str(SEED), 'vec_id')} * 6), 6) - 1 AS BIGINT) AS category FROM embeddings")
def seeded_draw(spark, sf_dir):
    """A uniform number per row and a draw from six equally likely categories by it."""
    rows = e_rows(spark, sf_dir).select("row_id")
    u = rng.uniform(SEED, F.col("row_id"))
    return rows.select("row_id", r(u, 9).alias("u"), (F.least(F.ceil(u * 6), F.lit(6)) - 1).cast("long").alias("category"))


_COL_SQL = f"""{E_SQL}, cs AS (SELECT col_id, k, count(*) AS cn, avg(x) AS cm, var_pop(x) * count(*) AS css FROM cells GROUP BY 1, 2),
grid AS (SELECT l, k, {MOMENTS} FROM cells GROUP BY 1, 2), sizes AS (SELECT l, count(DISTINCT col_id) AS size FROM cells GROUP BY 1)"""


@query(f"""WITH {_COL_SQL} SELECT col_id, l, {q("sum(" + marginal_sql('cn', 'cm', 'css', _POST['mu'], _POST['kappa'], _POST['psi'], 'CAST(' + _POST['nu'] + ' AS DOUBLE)') + ") + ln(first(size))", 3)} AS logw FROM cs JOIN grid USING (k) JOIN sizes USING (l) GROUP BY 1, 2
UNION ALL SELECT col_id, CAST(-1 AS BIGINT), {q("sum(" + marginal_sql('cn', 'cm', 'css') + f") + ln({BETA})", 3)} FROM cs GROUP BY 1""")
def col_membership_logw(spark, sf_dir):
    cells = e_cells(spark, sf_dir)
    own = stats.grouped(cells, "col_id", "k").select("col_id", "k", F.col("n").cast("double").alias("cn"), F.col("mean").alias("cm"), F.col("s").alias("cs"))
    sizes = cells.groupBy("l").agg(F.countDistinct("col_id").alias("size"))
    grid = stats.grouped(cells, "l", "k").withColumn("n", F.col("n").cast("double")).join(F.broadcast(sizes), "l")
    theirs = (F.col("cn"), F.col("cm"), F.col("cs"))
    held = own.join(F.broadcast(grid), "k").groupBy("col_id", "l").agg((F.sum(prior().update(*_stats()).log_marginal(*theirs)) + F.log(F.first("size"))).alias("logw"))
    fresh = own.groupBy("col_id").agg((F.sum(prior().log_marginal(*theirs)) + math.log(BETA)).alias("logw")).select("col_id", F.lit(-1).cast("long").alias("l"), "logw")
    return held.select("col_id", "l", "logw").unionByName(fresh).select("col_id", "l", r(F.col("logw"), 3).alias("logw"))


@query(f"""WITH {E_SQL}, means AS (SELECT worker_id, k, row_id, avg(x) AS x FROM cells GROUP BY ALL), inc AS (SELECT k AS local_k, count(*) AS rn, avg(x) AS rm, var_pop(x) * count(*) AS rs FROM means WHERE worker_id = 0 GROUP BY 1),
held AS (SELECT k, {MOMENTS} FROM means WHERE worker_id > 0 GROUP BY 1)
SELECT local_k, k, {q(marginal_sql('rn', 'rm', 'rs', _POST['mu'], _POST['kappa'], _POST['psi'], 'CAST(' + _POST['nu'] + ' AS DOUBLE)') + ' + ln(n)', 4)} AS logw FROM inc, held
UNION ALL SELECT local_k, CAST(-1 AS BIGINT), {q(marginal_sql('rn', 'rm', 'rs') + f' + ln({ALPHA})', 4)} FROM inc""")
def merge_logw(spark, sf_dir):
    """Worker 0's row clusters against the clusters of all other workers, or a new one, by row means."""
    means = e_cells(spark, sf_dir).groupBy("worker_id", "k", "row_id").agg(F.avg("x").alias("x"))
    new = stats.grouped(means.where("worker_id = 0"), "k").select(F.col("k").alias("local_k"), F.col("n").cast("double").alias("rn"), F.col("mean").alias("rm"), F.col("s").alias("rs"))
    held = stats.grouped(means.where("worker_id > 0"), "k").withColumn("n", F.col("n").cast("double"))
    theirs = (F.col("rn"), F.col("rm"), F.col("rs"))
    pairs = new.crossJoin(held).select("local_k", "k", (prior().update(*_stats()).log_marginal(*theirs) + F.log("n")).alias("logw"))
    fresh = new.select("local_k", F.lit(-1).cast("long").alias("k"), (prior().log_marginal(*theirs) + math.log(ALPHA)).alias("logw"))
    return pairs.unionByName(fresh).select("local_k", "k", r(F.col("logw"), 4).alias("logw"))


_ENTERED = posterior_sql("rn", "rm", "rs")


@query(f"""WITH {E_SQL}, means AS (SELECT worker_id, k, row_id, avg(x) AS x FROM cells GROUP BY ALL), inc AS (SELECT k AS local_k, count(*) AS rn, avg(x) AS rm, var_pop(x) * count(*) AS rs FROM means WHERE worker_id = 0 GROUP BY 1),
entered AS (SELECT local_k, CAST({_ENTERED['nu']} AS DOUBLE) AS en, {_ENTERED['mu']} AS em, {_ENTERED['psi']} AS es FROM inc),
held AS (SELECT k, {MOMENTS} FROM means WHERE worker_id > 0 GROUP BY 1)
SELECT local_k, k, {q(marginal_sql('en', 'em', 'es', _POST['mu'], _POST['kappa'], _POST['psi'], 'CAST(' + _POST['nu'] + ' AS DOUBLE)') + ' + ln(' + _POST['nu'] + ' - 1)', 4)} AS logw FROM entered, held
UNION ALL SELECT local_k, CAST(-1 AS BIGINT), {q(marginal_sql('en', 'em', 'es') + f' + ln({ALPHA})', 4)} FROM entered""")
def merge_logw_compat(spark, sf_dir):
    """The same with the published weights: degrees of freedom less the dimension, and posterior parameters as statistics."""
    means = e_cells(spark, sf_dir).groupBy("worker_id", "k", "row_id").agg(F.avg("x").alias("x"))
    new = stats.grouped(means.where("worker_id = 0"), "k").withColumn("n", F.col("n").cast("double"))
    after = prior().update(*_stats())
    new = new.select(F.col("k").alias("local_k"), after.nu.alias("rn"), after.mu.alias("rm"), after.psi.alias("rs"))
    held = stats.grouped(means.where("worker_id > 0"), "k").withColumn("n", F.col("n").cast("double"))
    theirs, own = (F.col("rn"), F.col("rm"), F.col("rs")), prior().update(*_stats())
    pairs = new.crossJoin(held).select("local_k", "k", (own.log_marginal(*theirs) + F.log(own.nu - 1)).alias("logw"))
    fresh = new.select("local_k", F.lit(-1).cast("long").alias("k"), (prior().log_marginal(*theirs) + math.log(ALPHA)).alias("logw"))
    return pairs.unionByName(fresh).select("local_k", "k", r(F.col("logw"), 4).alias("logw"))


@query("SELECT vec_id AS row_id, CAST(0 AS BIGINT) AS k FROM embeddings")
def initial_labels(spark, sf_dir):
    return e_rows(spark, sf_dir).select("row_id", F.lit(0).cast("long").alias("k"))


# ---------------------------------------------------------------- labels and joins


@query(f"WITH {E_SQL}, odd AS (SELECT worker_id, row_id, k * 3 + 1 AS k FROM rows_e) SELECT worker_id, row_id, k, dense_rank() OVER (PARTITION BY worker_id ORDER BY k) - 1 AS dense FROM odd")
def dense_relabel(spark, sf_dir):
    rows = e_rows(spark, sf_dir).select("worker_id", "row_id", (F.col("k") * 3 + 1).alias("k"))
    return labels.dense(rows, ["worker_id"], "k").select("worker_id", "row_id", "k", "dense")


@query("SELECT vec_id AS row_id, CAST(CASE WHEN label > 4 THEN label - 1 ELSE label END AS BIGINT) AS k FROM embeddings WHERE label <> 4")
def id_compaction(spark, sf_dir):
    return e_rows(spark, sf_dir).where("k <> 4").select("row_id", labels.compacted(F.col("k"), 4).alias("k"))


def _map(spark, sf_dir) -> DataFrame:
    held = labels.dense(e_rows(spark, sf_dir).select("worker_id", "row_id", "k"), ["worker_id"], "k", "local_k")
    return held


@query(f"WITH {E_SQL}, loc AS (SELECT worker_id, row_id, k, dense_rank() OVER (PARTITION BY worker_id ORDER BY k) - 1 AS local_k FROM rows_e) SELECT DISTINCT worker_id, local_k, (k * 7 + 3) % 10 AS global_k FROM loc")
def local_global_map(spark, sf_dir):
    held = _map(spark, sf_dir)
    local = held.select("worker_id", "local_k").distinct()
    assigned = held.select("worker_id", "local_k", ((F.col("k") * 7 + 3) % 10).alias("global_k")).distinct()
    return labels.cluster_map(local, assigned)


@query(f"WITH {E_SQL}, loc AS (SELECT worker_id, row_id, k, dense_rank() OVER (PARTITION BY worker_id ORDER BY k) - 1 AS local_k FROM rows_e) SELECT worker_id, row_id, (k * 7 + 3) % 10 AS global_k, local_k FROM loc")
def local_to_global(spark, sf_dir):
    held = _map(spark, sf_dir)
    mapping = held.select("worker_id", "local_k", ((F.col("k") * 7 + 3) % 10).alias("global_k")).distinct()
    return labels.to_global(held.select("worker_id", "row_id", "local_k"), mapping)


@query(f"WITH {E_SQL}, peaks AS (SELECT worker_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS k FROM rows_e), c AS (SELECT CAST(unnest(range({DIMENSIONS})) AS BIGINT) AS k), w AS (SELECT DISTINCT worker_id FROM rows_e) SELECT worker_id, k FROM w, c EXCEPT SELECT worker_id, k FROM peaks")
def absent_clusters(spark, sf_dir):
    """Clusters of rows by their largest component that a worker has no row of."""
    rows = e_rows(spark, sf_dir).select("worker_id", (F.array_position("v", F.array_max("v")) - 1).alias("k"))
    every = rows.select("worker_id").distinct().crossJoin(spark.range(DIMENSIONS).withColumnRenamed("id", "k"))
    return labels.absent(every, rows, ["worker_id", "k"]).select("worker_id", "k")


@query("SELECT CAST(label AS BIGINT) AS k, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_counts(spark, sf_dir):
    return labels.counts(e_rows(spark, sf_dir), "k")


@query("SELECT CAST(max(label) AS BIGINT) AS max_label, count(DISTINCT label) AS n_labels FROM embeddings")
def label_extent(spark, sf_dir):
    return e_rows(spark, sf_dir).agg(F.max("k").alias("max_label"), F.countDistinct("k").alias("n_labels"))


def _row_labels(spark, sf_dir) -> DataFrame:
    return e_rows(spark, sf_dir).select("row_id", "k")


def _col_labels(spark) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("col_id"), (F.col("id") % COLUMN_CLUSTERS).alias("l"))


_BLOCK_SQL = f"{E_SQL}, seen AS (SELECT k, l, min(col_id * 1000000 + row_id) AS place FROM cells GROUP BY 1, 2), numbered AS (SELECT k, l, dense_rank() OVER (ORDER BY place) - 1 AS block_id FROM seen)"


@query(f"WITH {_BLOCK_SQL} SELECT row_id, col_id, block_id FROM cells JOIN numbered USING (k, l)")
def block_partition_first_seen(spark, sf_dir):
    return labels.blocks_first_seen(_row_labels(spark, sf_dir), _col_labels(spark))


@query(f"WITH {E_SQL} SELECT row_id, col_id, k * 64 + l AS block_id FROM cells")
def block_partition_arith(spark, sf_dir):
    return labels.blocks_by_arithmetic(_row_labels(spark, sf_dir), _col_labels(spark), 64)


@query(f"WITH {E_SQL}, rr AS (SELECT row_id, row_number() OVER (ORDER BY k, row_id) - 1 AS new_row FROM rows_e), cc AS (SELECT col_id, row_number() OVER (ORDER BY l, col_id) - 1 AS new_col FROM (SELECT DISTINCT col_id, l FROM cells)) SELECT new_row, new_col, {q('x')} AS x FROM cells JOIN rr USING (row_id) JOIN cc USING (col_id)")
def reordered_cells(spark, sf_dir):
    cells = e_cells(spark, sf_dir).select("row_id", "col_id", "x")
    return shown(labels.reordered(cells, _row_labels(spark, sf_dir), _col_labels(spark)), ["new_row", "new_col"], x=F.col("x"))


@query(f"WITH {E_SQL} SELECT k, worker_id, first_rows FROM (SELECT k, worker_id, min(row_id) AS first_rows, row_number() OVER (PARTITION BY k ORDER BY worker_id) AS place FROM rows_e GROUP BY 1, 2) WHERE place = 1")
def first_of_each(spark, sf_dir):
    """The first worker that holds a cluster, with its first row there: the head of a sorted list, per key."""
    parts = e_rows(spark, sf_dir).groupBy("k", "worker_id").agg(F.min("row_id").alias("first_rows"))
    return parts.groupBy("k").agg(F.min(F.struct("worker_id", "first_rows")).alias("h")).select("k", "h.worker_id", "h.first_rows")


@query(f"WITH {E_SQL} SELECT worker_id, k FROM rows_e WHERE worker_id % 2 = 0 UNION ALL SELECT worker_id, k FROM rows_e WHERE worker_id % 2 = 1")
def appended(spark, sf_dir):
    """The rows of workers with even numbers, and below them all others'."""
    rows = e_rows(spark, sf_dir).select("worker_id", "k")
    return rows.where("worker_id % 2 = 0").unionByName(rows.where("worker_id % 2 = 1"))


@query(f"WITH {E_SQL} SELECT DISTINCT worker_id, k FROM rows_e")
def distinct_labels(spark, sf_dir):
    return e_rows(spark, sf_dir).select("worker_id", "k").distinct()


@query(f"WITH {E_SQL} SELECT row_id, k, worker_id, row_number() OVER (ORDER BY worker_id DESC, k, row_id) - 1 AS place FROM rows_e WHERE worker_id = 2 AND k = 3")
def filtered_sorted(spark, sf_dir):
    """Rows of one cluster on one worker, numbered in a given order."""
    kept = e_rows(spark, sf_dir).where((F.col("worker_id") == 2) & (F.col("k") == 3))
    return kept.select("row_id", "k", "worker_id", (F.row_number().over(Window.orderBy(F.desc("worker_id"), "k", "row_id")) - 1).cast("long").alias("place"))


# ---------------------------------------------------------------- scores and generation

_ESTIMATE = "CAST((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS BIGINT)"
_TABLE_SQL = f"WITH two AS (SELECT CAST(label AS BIGINT) AS b, {_ESTIMATE} AS a FROM embeddings), t AS (SELECT a, b, count(*) AS n FROM two GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n_a FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS n_b FROM t GROUP BY 1)"


def _contingency(spark, sf_dir) -> DataFrame:
    shifted = (F.col("k") + F.when(F.col("row_id") % 7 == 0, 1).otherwise(0)) % 10
    return score.contingency(e_rows(spark, sf_dir).withColumn("e", shifted), "e", "k")


@query(_TABLE_SQL + " SELECT a, b, n FROM t")
def contingency(spark, sf_dir):
    return _contingency(spark, sf_dir)


_C2 = "sum({0} * ({0} - 1) / 2.0)"


@query(_TABLE_SQL + f", p AS (SELECT (SELECT {_C2.format('n')} FROM t) AS i, (SELECT {_C2.format('n_a')} FROM ra) AS x, (SELECT {_C2.format('n_b')} FROM rb) AS y, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM t) AS e) SELECT {q('(i - x * y / e) / ((x + y) / 2 - x * y / e)')} AS ari FROM p")
def ari(spark, sf_dir):
    return score.adjusted_rand(_contingency(spark, sf_dir)).select(r(F.col("ari")).alias("ari"))


@query(_TABLE_SQL + f", w AS (SELECT sum(n) AS total FROM t), mi AS (SELECT sum(n / total * ln(n * total / (n_a * n_b))) AS i FROM t JOIN ra USING (a) JOIN rb USING (b), w), ha AS (SELECT -sum(n_a / total * ln(n_a / total)) AS h FROM ra, w), hb AS (SELECT -sum(n_b / total * ln(n_b / total)) AS h FROM rb, w) SELECT {q('2 * mi.i / (ha.h + hb.h)')} AS nmi FROM mi, ha, hb")
def nmi(spark, sf_dir):
    return score.normalized_mutual_information(_contingency(spark, sf_dir)).select(r(F.col("nmi")).alias("nmi"))


@query(f"WITH {_BLOCK_SQL} SELECT count(DISTINCT block_id) AS n_clusters FROM numbered")
def n_blocks(spark, sf_dir):
    return score.n_blocks(_row_labels(spark, sf_dir), _col_labels(spark))


@query("SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('17|' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS new_row FROM embeddings")
def shuffle_perm(spark, sf_dir):
    return datagen.permutation(e_rows(spark, sf_dir).select("row_id"), "row_id", SEED, "new_row")


@query(f"WITH {E_SQL}, place AS (SELECT row_id, k, row_number() OVER (PARTITION BY k ORDER BY row_id) - 1 AS i FROM rows_e), sizes AS (SELECT k, count(*) AS n FROM rows_e GROUP BY 1), starts AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM sizes) SELECT CAST(begins + i AS BIGINT) AS row_id, CASE l WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 48 END + col_id // 4 AS col_id, {q('x')} AS x FROM cells JOIN place USING (row_id, k) JOIN starts USING (k)")
def assembled_blocks(spark, sf_dir):
    """Separate blocks put beside and below each other."""
    own = _row_labels(spark, sf_dir)
    sizes = {r.k: r.n for r in labels.counts(own, "k").collect()}
    rows = own.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("row_id")) - 1)
    cells = e_cells(spark, sf_dir).select("row_id", "col_id", "l", "x").join(rows, "row_id").withColumn("j", F.floor(F.col("col_id") / COLUMN_CLUSTERS))
    return shown(datagen.assembled(cells, [sizes.get(k, 0) for k in range(max(sizes) + 1)], (DIMENSIONS // COLUMN_CLUSTERS,) * COLUMN_CLUSTERS), ["row_id", "col_id"], x=F.col("x"))


def _normal_sql(*parts: str) -> str:
    return f"(sqrt(-2 * ln(greatest({uniform_sql(*parts, chr(39) + 'r' + chr(39))}, 1e-12))) * cos(2 * pi() * {uniform_sql(*parts, chr(39) + 'a' + chr(39))}))"


def _axis_sql(name: str, label: str, sizes) -> str:
    """Indices of an axis with their cluster, clusters taking consecutive runs."""
    ends = np.cumsum(sizes).tolist()
    cases = " ".join(f"WHEN {name} < {e} THEN {k}" for k, e in enumerate(ends))
    return f"(SELECT {name}, CAST(CASE {cases} END AS BIGINT) AS {label} FROM (SELECT unnest(range({ends[-1]})) AS {name}))"


def _table_sql(values) -> str:
    """A number by (l, k)."""
    return "CASE l * 1000 + k " + " ".join(f"WHEN {l * 1000 + k} THEN {v}" for l, row in enumerate(values) for k, v in enumerate(row)) + " END"  # noqa: E741


def _lbm_sql(rows, cols, means, variances) -> str:
    x = f"{_table_sql(means)} + sqrt({_table_sql(variances)}) * {_normal_sql(str(SEED), 'row_id', 'col_id')}"
    return f"WITH cells AS (SELECT l, k, {x} AS x FROM {_axis_sql('row_id', 'k', rows)}, {_axis_sql('col_id', 'l', cols)}) SELECT l, k, count(*) AS n, {q('avg(x)')} AS mean, {q('var_pop(x) * count(*)')} AS s FROM cells GROUP BY 1, 2"


@query(_lbm_sql(datagen.ROW_SIZES_100, datagen.COL_SIZES_100, datagen.MEANS_100, datagen.VARIANCES_100))
def lbm_generate(spark, sf_dir):
    """Moments of the blocks of the generated 100x100 matrix."""
    return _moments(stats.grouped(datagen.fixture_100(spark, SEED), "l", "k"), ["l", "k"])


@query(_lbm_sql(datagen.ROW_SIZES_20000, datagen.COL_SIZES_20000, datagen.MEANS_20000, datagen.VARIANCES_20000))
def lbm_generate_20000(spark, sf_dir):
    """Moments of the blocks of the generated 20000x20 matrix."""
    return _moments(stats.grouped(datagen.fixture_20000(spark, SEED), "l", "k"), ["l", "k"])


_VECTOR_MEANS = [[[0.0, 0.0], [3.0, 1.0]], [[-2.0, 2.0], [1.0, -3.0]]]
_Z = [_normal_sql(str(SEED), str(i), "row_id", "col_id") for i in range(2)]


@query(f"WITH z AS (SELECT l, k, {_Z[0]} AS z0, {_Z[1]} AS z1 FROM {_axis_sql('row_id', 'k', (30, 20))}, {_axis_sql('col_id', 'l', (10, 15))}) SELECT l, k, count(*) AS n, {q('avg(' + _table_sql([[m[0] for m in r] for r in _VECTOR_MEANS]) + ' + z0)')} AS m0, {q('avg(' + _table_sql([[m[1] for m in r] for r in _VECTOR_MEANS]) + ' + 0.3 * z0 + sqrt(0.91) * z1)')} AS m1 FROM z GROUP BY 1, 2")
def lbm_generate_vectors(spark, sf_dir):
    cov = [[1.0, 0.3], [0.3, 1.0]]
    cells = datagen.vector_blocks(spark, (30, 20), (10, 15), _VECTOR_MEANS, [[cov, cov], [cov, cov]], SEED)
    held = cells.groupBy("l", "k").agg(*stats.vector_moments("x", 2))
    return shown(held, ["l", "k", "n"], m0=F.col("mean")[0], m1=F.col("mean")[1])


@query()
def niw_sample(spark, sf_dir):
    """A mean and a variance drawn from every block's posterior."""
    held = posterior.posterior_sample(e_cells(spark, sf_dir), niw.Niw.make(MU, KAPPA, PSI, NU), ["l", "k"], SEED)
    return held.select("l", "k", F.col("mean")[0].alias("mean"), F.col("covariance")[0].alias("variance"))


@query()
def posterior_clusters(spark, sf_dir):
    """A mean vector and a covariance matrix drawn from every row cluster's posterior; the mean and the diagonal, by component."""
    held = posterior.posterior_sample(e_rows(spark, sf_dir).withColumnRenamed("v", "x"), niw.Niw.identity(DIMENSIONS), ["k"], SEED)
    parts = held.select("k", "n", "covariance", F.posexplode("mean").alias("i", "mean"))
    return parts.select("k", "n", F.col("i").cast("long").alias("i"), "mean", F.element_at("covariance", F.col("i") * (DIMENSIONS + 1) + 1).alias("variance"))


def _fitted(spark, sf_dir):
    from ..operators.model import BlockMixture

    return BlockMixture(prior="covariance", seed=1, workers=4).fit(e_cells(spark, sf_dir).select("row_id", "col_id", "x"), max_iter=4)


@query()
def fit(spark, sf_dir):
    """Row and column labels of the embedding matrix after four sweeps by four workers."""
    done = _fitted(spark, sf_dir)
    rows = done.row_labels.select(F.lit("row").alias("axis"), F.col("row_id").cast("long").alias("id"), F.col("k").cast("long").alias("label"))
    return rows.unionByName(done.col_labels.select(F.lit("column").alias("axis"), F.col("col_id").cast("long").alias("id"), F.col("l").cast("long").alias("label")))


def _scored(spark, cells, done) -> DataFrame:
    found = score.block_scores(done.row_labels, done.col_labels, cells.select("row_id", "k").distinct(), cells.select("col_id", "l").distinct())
    return found.select(r(F.col("ari")).alias("ari"), r(F.col("nmi")).alias("nmi"), F.col("n_clusters").cast("long").alias("n_clusters"))


@query()
def fit_scores(spark, sf_dir):
    """Scores of the embedding matrix's fit against its own labels."""
    return _scored(spark, e_cells(spark, sf_dir), _fitted(spark, sf_dir))


@query("SELECT 1.0::DOUBLE AS ari, 1.0::DOUBLE AS nmi, 9::BIGINT AS n_clusters")
def fit_fixture(spark, sf_dir):
    """Scores after 99 sweeps of the generated 100x100 matrix by one worker, as the published run: all blocks are found."""
    from ..operators.model import BlockMixture

    cells = datagen.fixture_100(spark, SEED)
    done = BlockMixture(alpha=5.0, beta=2.0, seed=1, workers=1).fit(cells.select("row_id", "col_id", "x"), max_iter=99)
    return _scored(spark, cells, done)


@query()
def fit_cluster_recipe(spark, sf_dir):
    """Scores of the generated 20000x20 matrix after four sweeps by 32 workers, as the published cluster recipe deals it."""
    from ..operators.model import BlockMixture

    cells = datagen.fixture_20000(spark, SEED)
    done = BlockMixture(alpha=5.0, beta=2.0, seed=1, workers=32).fit(cells.select("row_id", "col_id", "x"), max_iter=4)
    return _scored(spark, cells, done)
