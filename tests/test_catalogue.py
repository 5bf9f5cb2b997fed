"""Each query of the catalogue against DuckDB on the same tables."""

import os

import duckdb
import pytest

from palimpsest.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


def test_nothing_is_compared_with_nothing(spark):
    """Each query has rows, so its SQL is held against something."""
    for name in ("range_counts", "point_get_deleted", "txn_readonly_ok", "txn_commit_path", "run_file_lookup"):
        assert QUERIES[name](spark, SF).count() > 4, name
    kinds = QUERIES["txn_readonly_ok"](spark, SF).groupBy("writes", "ok").count().count()
    assert kinds >= 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_plans_have_no_python_and_push_filters(spark):
    for name in sorted(ORACLE):
        if name not in ("store_round_trip", "txn_commit_path", "log_replay", "run_files", "run_file_lookup"):
            plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "CartesianProduct" not in plan, name
    assert "EqualTo(user_id,2)" in QUERIES["point_get"](spark, SF)._jdf.queryExecution().executedPlan().toString()
