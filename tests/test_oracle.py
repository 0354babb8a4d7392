import pytest

from tests.oracle import same
from textloom.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        same(df, ORACLE[name], DATA)
    else:
        assert df.count() > 0
