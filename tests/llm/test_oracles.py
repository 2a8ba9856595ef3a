import pytest

from tests.compare import connection, differences
from watchline.llm.registry import REGISTRY

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_gives_what_its_sql_gives(spark, name):
    assert differences(spark, connection(D), REGISTRY.queries[name], REGISTRY.sql[name], D) == ""
