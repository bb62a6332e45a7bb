import pytest
from oracle import same

from claimspark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        same(df, catalogue.ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
