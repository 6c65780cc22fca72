"""Every registered query beside its SQL statement on the smallest tables; ``tests.oracle_check`` runs larger ones."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Dates have at most ten names here, fewer than these need (and windows fewer rows than the 158 factors of the second); they run on
# the next larger tables.
THIN = {"model_boosted_classifier", "model_walk_forward_planted"}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE and n not in THIN])
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(THIN))
def test_query_equals_sql_on_larger_tables(spark, name):
    assert compare(QUERIES[name](spark, LARGER), connect(LARGER), ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
