"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest

from tests.compare import connection, differences
from watchline.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY.queries))
def test_query(spark, con, name):
    run, sql = catalog.REGISTRY.queries[name], catalog.REGISTRY.sql.get(name)
    if sql is not None:
        assert not differences(spark, con, run, sql, SMALL)
    else:
        assert run(spark, SMALL).columns
