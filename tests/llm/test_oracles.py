import pytest
from oracle import same

from claimspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)
