"""The operators' queries that SQL can state give the rows SQL gives."""

import pytest

from compare import compare, database
from tidewatch import llm

QUERIES, SQL = llm.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, name):
    assert compare(spark, database(folder), name, QUERIES[name], SQL[name], folder) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
