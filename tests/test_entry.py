"""The entry points, and every named query against its SQL equivalent on the small tables."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "total_amount"] and df.count() > 0
    plan = df._jdf.queryExecution().toString()
    assert not [c for c in ("email", "phone", "national_id", "customer") if c in plan]


def test_every_query_of_the_library_has_sql():
    assert set(entry.plans.QUERIES) == set(entry.plans.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    problem = compare.difference(spark, duck, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
