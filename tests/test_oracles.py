"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = sql.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (t[cols].sort_values(cols).reset_index(drop=True) for t in (got, want))
    assert len(got) == len(want) > 0
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
