"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import DATA
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

# These need more rows than the smallest tables give them.
EMPTY_AT_SMALLEST: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    problem, _, _ = compare(spark, duck, name, queries()[name], oracle_sql().get(name), DATA)
    assert problem is None or (problem == "no rows" and name in EMPTY_AT_SMALLEST), problem


def test_answers_are_normalised_once(spark):
    plan = queries()["answer_em_f1"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 6  # three for each of two texts
