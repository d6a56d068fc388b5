import pytest
from conftest import DATA
from oracle import compare

from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], f"{DATA}/sf0.001")
