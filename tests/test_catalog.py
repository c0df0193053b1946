"""Every registered query against its SQL."""

import pytest
from conftest import same

from factloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    rows = same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)
    assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
