"""The one-scan dashboard refresh gives exactly the direct operators' results."""

import datetime as dt

import pytest

import __spark_entry__ as E
from conftest import MICRO_AS_OF, MICRO_PARAMS, SF_MID
from fundflow.functions.money import to_output
from fundflow.operators import alerts as L, evolution, filters, flows, kpis as K, status
from fundflow.plans import dashboard as D, rules


def direct(lf, p, as_of):
    a1, a3 = flows.liquidity_metrics(lf), flows.concentration(lf)
    evo = evolution.balance_pct_change(lf)
    k = K.kpis(lf, p, as_of)
    alerts = L.combine(
        L.liquidity_alerts(status.liquidity_status_by_fund(status.liquidity_status(a1)), as_of),
        L.concentration_alerts(status.concentration_metrics(a3), as_of),
        L.evolution_alerts(evolution.evolution_metrics(evo), as_of))
    return {
        "kpi_alerts": L.kpi_alerts(k),
        "alerts": alerts.drop("metadata"),
        "kpis": K.kpis(lf, p, as_of), "liquidity_metrics": a1,
        "daily_metrics": flows.daily_metrics(lf), "concentration": a3,
        "balance_pct_change": evo, "evolution_metrics": evolution.evolution_metrics(evo),
        "liquidity_status_by_fund": status.liquidity_status_by_fund(status.liquidity_status(a1)),
        "concentration_metrics": status.concentration_metrics(a3),
        "concentration_overall": status.concentration_overall(a3),
        "fund_daily_stats": rules.fund_daily_stats(lf),
    }


def same(a, b):
    if "metadata" in a.columns:  # maps cannot be compared by exceptAll
        a = a.drop("metadata")
    a, b = to_output(a), to_output(b)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_micro_ledger(spark, micro, micro_lf):
    dash = D.refresh(spark, micro, MICRO_PARAMS, MICRO_AS_OF)
    for name, want in direct(micro_lf, MICRO_PARAMS, MICRO_AS_OF).items():
        assert same(dash[name], want), name


@pytest.mark.parametrize("adapter,days", [("orders", None), ("orders", 45), ("events", None)])
def test_test_tables(spark, adapter, days):
    led = E.ledger_for(spark, SF_MID, adapter)
    p = E.full(adapter) if days is None else E.days_back(adapter, days)
    as_of = E.AS_OF[adapter]
    dash = D.refresh(spark, led, p, as_of)
    for name, want in direct(filters.apply_filters(led, p), p, as_of).items():
        assert same(dash[name], want), name


def test_derived_frames_do_not_read_the_ledger(spark):
    led = E.ledger_for(spark, SF_MID, "orders")
    dash = D.refresh(spark, led, E.full("orders"), E.AS_OF["orders"])
    for name, df in dash.frames.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "orders.parquet" not in plan and "daily-cube" in plan, name


def test_future_lines_counted_from_the_cube(spark, micro):
    p = MICRO_PARAMS
    for as_of in (dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)):
        got = D.kpis(D.daily_cube(filters.apply_filters(micro, p)), p, as_of).collect()[0]
        want = K.kpis(filters.apply_filters(micro, p), p, as_of).collect()[0]
        assert got.data_quality_score == want.data_quality_score
