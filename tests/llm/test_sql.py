"""Every query with SQL gives DuckDB's rows."""

import pytest
from compare import differences, duck

from turnwise.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), duck(folder), SQL[name]) is None


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
