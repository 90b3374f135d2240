"""Physical-plan checks: no Python in any query, filters reach the scan,
every window is partitioned, the KPI block scans the ledger once."""

import pytest

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


QUERIES = {n: q for n, q in E.queries().items() if n in E.SCENARIOS}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_partitioned_windows(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in p
    # a window without PARTITION BY runs in a single task
    for line in p.splitlines():
        if "Window [" in line:
            assert "], [], [" not in line, line


def test_period_filter_pushed_to_scan(spark):
    df = QUERIES["liquidity_metrics_45d" if "liquidity_metrics_45d" in QUERIES
                 else "liquidity_status_45d"](spark, SF_SMALL)
    p = formatted(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,2001-06-17T00:00)" in p
    assert "LessThan(o_orderdate,2001-08-02T00:00)" in p


def test_fund_filter_pushed_to_scan(spark):
    p = formatted(QUERIES["kpis_one_fund"](spark, SF_SMALL))
    assert "EqualTo(n_name,NATION_1)" in p or "In(n_name, [NATION_1])" in p


@pytest.mark.parametrize("name", ["kpis_events", "concentration_events"])
def test_branches_share_the_grouped_aggregate(spark, name):
    """The scalar subquery reads the same exchange, so the ledger is read once."""
    df = QUERIES[name](spark, SF_MID)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rule_metrics_events", "pack_metrics_events"])
def test_one_branch_reads_once(spark, name):
    assert plan(QUERIES[name](spark, SF_SMALL)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["alerts_events", "warning_alerts_45d", "has_issues", "analysis_summary"])
def test_composites_read_the_ledger_once(spark, name):
    """All branches start from one exchange: the lines are read by one scan, and nothing is written."""
    df = QUERIES[name](spark, SF_MID)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    p = p[p.index("Final Plan"):p.index("Initial Plan")] if "Initial Plan" in p else p
    table = "events.parquet" if "events" in name else "orders.parquet"
    assert p.count(table) == 1 and "ReusedExchange" in p and "daily-cube" not in p


def test_no_line_is_expanded(spark):
    p = plan(QUERIES["kpis"](spark, SF_SMALL))
    for part in p.split("Expand [")[1:]:  # below the sets stands the (date, fund) aggregate
        assert "HashAggregate" in part.split("FileScan")[0]


def test_concentration_grand_total_is_a_scalar_subquery(spark):
    p = plan(QUERIES["concentration"](spark, SF_SMALL))
    assert "Subquery" in p
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
