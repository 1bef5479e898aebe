"""Every named query against its DuckDB statement."""
import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = os.environ.get("PRISMTAB_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_statement(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert compare.difference(duck, entry.oracle_sql()[name], frame) is None


def test_entry_returns_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["period", "revenue"] and frame.count() > 0


def test_statements_belong_to_queries():
    from prismtab.plans.oracle import ORACLE

    assert set(ORACLE) <= set(entry.queries())
