"""Every registered query that has SQL, against it; the others must run and give rows."""

import pytest

from evidentia.plans import registry
from tests.oracle import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        compare(df, connect(folder), SQL[name])
    else:
        assert df.count() > 0


def test_names_are_lower_case_and_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and all(n == n.lower() for n in QUERIES)
