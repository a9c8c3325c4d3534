import pytest
from conftest import SMALL, compare

import __spark_entry__ as entry
from tributary.plans import catalogue, problems, streams

CORE = {**catalogue.QUERIES, **streams.QUERIES, **problems.QUERIES}
SQL = {**catalogue.ORACLE, **streams.ORACLE, **problems.ORACLE}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, oracle, name):
    compare(spark, oracle, CORE[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    assert CORE[name](spark, SMALL).columns


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_dgim_is_within_half(spark):
    row = catalogue.dgim_accuracy(spark, SMALL).first()
    assert row.n > 0 and row.worst_error <= 0.5


def test_wide_bands_meet_nearly_all_pairs(oracle):
    """Of the pairs whose signatures agree in 0.85, by SQL over a larger table without bands."""
    sql = catalogue.ORACLE["lsh_similar_pairs"].replace("bronze_reviews", "read_parquet('/root/testdata/sf0.01/bronze_reviews.parquet')")
    every = sql.replace("bands x join bands y using (b, hash)", "sig x join sig y on true")
    assert every != sql
    found, whole = (oracle.execute(f"select count(*) from ({q})").fetchone()[0] for q in (sql, every))
    assert 0 < whole and found >= 0.98 * whole
