"""Every query of the catalogue against its SQL in DuckDB."""

from pathlib import Path

import pytest
from harness import compare, connect

from weftspark.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF_DIR) == ""


def test_entry_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
