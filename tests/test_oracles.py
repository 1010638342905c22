import pytest

from maskline.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Queries that have no rows on the smallest tables, where nothing meets their condition.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_oracle(spark, name):
    assert compare(spark, SF, name, QUERIES[name], ORACLES[name]) == ("no rows" if name in EMPTY else None)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
