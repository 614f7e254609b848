"""Each core query against its oracle SQL in DuckDB, on the smallest of the driver's folders."""

import datetime as dt
import math
from pathlib import Path

import pytest

from tapeline.plans.oracle import oracle_sql
from tapeline.plans.queries import queries

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, dt.datetime):
            return x.date().isoformat()
        if isinstance(x, dt.date):
            return x.isoformat()
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = queries()[name](spark, str(FOLDER))
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_plans_have_no_products_and_no_python(spark):
    for name in ("apply_adjustment_daily", "gap_measure", "jump_candidates", "scan_jumps", "claims_vs_witness", "stale_runs", "date_shifts", "reconcile", "rekey", "bad_print_guard"):
        plan = queries()[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInArrow")), name
