"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

from pathlib import Path

import pytest
from oracle import connect, differences

from lumenfold import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry.queries()
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    made = QUERIES[name]
    if made.sql:
        assert differences(made(spark, SF_DIR), db, made.sql) == []
    else:
        assert made(spark, SF_DIR).count() >= 0
