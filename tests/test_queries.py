"""Every query of the catalogue against its SQL, and the entry point."""

import pytest

import __spark_entry__ as entry
from helpers import SF, oracle_rows, rows
from strandflow.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SF)) == oracle_rows(catalogue.ORACLE[name])


def test_queries_without_sql(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"q09_candidates"}
    exact = {tuple(r) for r in catalogue.q08(spark, SF).collect()}
    assert exact <= {tuple(r) for r in catalogue.q09_candidates(spark, SF).select("read_id", "part").collect()}


def test_bloom_candidates_equal_their_sql(spark):
    assert rows(catalogue.q09_candidates(spark, SF)) == oracle_rows(f"with {catalogue.CANDIDATES}")


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
