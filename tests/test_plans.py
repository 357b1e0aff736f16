"""Plan-shape guards: built-in expressions only, no cross joins, scans pruned."""

import pytest

import __spark_entry__ as entry
from support import SF_SMALL

ORACLE_QUERIES = sorted(k for k in entry.oracle_sql() if not k.startswith("op"))
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ORACLE_QUERIES)
def test_plan_has_no_python_udf_or_cross_join(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_scans_read_only_needed_columns(spark):
    df = entry.queries()["leakage_lineitem"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "l_shipdate" not in plan
