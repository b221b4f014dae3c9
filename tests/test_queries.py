import pytest
from compare import compare

from turfline.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001") > 0
