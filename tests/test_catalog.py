"""All registered queries with a SQL twin at the smallest scale, and plan checks."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from catalog.views import BASE_TABLES
from check_queries import ordered

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
HOT = ["fn12_cells", "fn20_dominant_class", "fn36_forward_depth", "ag1_site_day_median", "cp6_final_frame", "jn1_daily_values", "wn4_trailing_rain"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_twin(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    want = ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_sites_moved_beyond_the_date_line(spark, tmp_path):
    """A name at two places is a conflict, also if the moved one lies beyond 180 degrees."""
    user = next(u for u in range(1500) if u * 91 % 3600 >= 3590 and f"site_{u}" < "site_2")
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT * EXCLUDE (k) REPLACE (k AS event_id, {user} AS user_id) FROM (SELECT * FROM '{FOLDER}/events.parquet' LIMIT 1), (SELECT unnest([1000, 1002, 1003]) AS k))
            TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = QUERIES["ag7_site_conflicts"](spark, str(tmp_path)).collect()
    assert {r.site_coord_conflict for r in found} == {1}
    assert sorted(tuple(r) for r in found) == sorted(con.execute(SQL["ag7_site_conflicts"]).fetchall())


@pytest.mark.parametrize("name", HOT)
def test_no_python_workers(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    assert entry_points.entry(spark).columns[:3] == ["date", "row", "col"]


def test_entry_points_work_without_the_training_data_operators():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['fieldmosaic.llm'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert 'cp1_clean_grid_day' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)\n"
        "assert set(e.oracle_sql()) <= names"
    )
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True, timeout=120)
