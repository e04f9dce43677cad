"""Every registered query against its DuckDB text on the smallest tables."""

import __spark_entry__ as entry
import oracle
import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", [q for q in entry.queries() if q in entry.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, SF_DIR).toArrow()
    theirs = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert oracle.differences(ours, theirs) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
