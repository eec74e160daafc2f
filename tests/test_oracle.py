"""Every query that SQL can express gives what the other engine gives; the others run and have rows of a stable schema."""

import pytest
from tests.compare import rows
from tests.conftest import DATA

from loomline.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == QUERIES[name](spark, DATA).columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "token_savings" in e.queries()
