import pytest

from finquery import catalog
from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_has_a_twin_or_its_own_test():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"document_lifecycle", "native_amounts_whole"}  # the second: test_sources.py
