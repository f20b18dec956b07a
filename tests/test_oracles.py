"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import os

import pytest
from compare import differences, duck

from turnwise.plans.catalog import RUNS, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PYTHON = {"json_objects", "typed_", "reply_failures", "claims", "lesson_candidates"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(RUNS[name](spark, FOLDER), con, SQL[name]) is None


def test_only_the_rounds_have_no_sql():
    assert set(RUNS) - set(SQL) == {"acquisition_trace", "round_finds"}


@pytest.mark.parametrize("name", sorted(set(RUNS) - {"acquisition_trace", "round_finds"}))
def test_python_runs_only_where_intended(spark, name):
    """Balanced JSON spans are the only Python in any plan."""
    if any(name.startswith(p) for p in PYTHON):
        return
    plan = RUNS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan


def test_no_query_is_empty():
    """A query that compares nothing with nothing tests nothing; counted on the driver's own size."""
    con = duck("/root/testdata/sf0.01")
    empty = [n for n, sql in SQL.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]]
    assert empty == []
