import pytest

from evidentia.llm.queries import R
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", list(R.queries))
def test_query(spark, folder, name):
    df = R.queries[name](spark, folder)
    if name in R.sql:
        compare(df, connect(folder), R.sql[name])
    else:
        assert df.count() > 0
