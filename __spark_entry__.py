"""

``entry(spark)`` runs the flagship query (the KPI block) on sf0.001;
``queries()`` maps every registered query to ``(spark, sf_dir) ->
DataFrame``; ``oracle_sql()`` gives the equivalent DuckDB SQL for each.

Queries run on adapter A (orders x customer x nation, see FIXTURES.md)
over its full date range unless the name says otherwise: ``_events`` uses
adapter B, ``_45d`` the 45 days up to ``as_of`` and the other suffixes the
branch-reaching filters of FIXTURES.md section 4.  Every query reads the
whole test tables; filters are the feature's own parameters.
"""

from __future__ import annotations

import datetime as dt
import importlib
import os
import sys
from collections.abc import Callable

_ROOT = os.path.dirname(os.path.abspath(__file__))
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import fundflow_oracle as O  # noqa: E402
from fundflow.functions.money import to_output  # noqa: E402
from fundflow.operators import (  # noqa: E402
    alerts as L, breakdowns, evolution, extract as X, filters, flows, kpis as K, lag, status,
)
from fundflow.params import (  # noqa: E402
    EVOLUTION_HORIZONS, MAX_RECORDS_DISPLAY, FilterParams, period_filter,
)
from fundflow.functions.formatting import date_label  # noqa: E402
from fundflow.plans import bundles, dashboard as D, rules  # noqa: E402
from fundflow.plans.presentation import page  # noqa: E402
from fundflow.sources import contract, readers, sinks  # noqa: E402
from fundflow.sources.publish import publish, published  # noqa: E402
from fundflow.sources.adapters import ADAPTERS  # noqa: E402
from fundflow.session import configure, scratch_path  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
START = {"orders": dt.date(1995, 1, 1), "events": dt.date(2024, 1, 1), "export": dt.date(2024, 1, 1)}
AS_OF = {"orders": dt.date(2001, 8, 1), "events": dt.date(2024, 1, 31), "export": dt.date(2024, 1, 31)}
PAGE_ROWS = 50
ALERT_OUT = ("type", "severity", "fund", "value", "timestamp")


def full(adapter: str, **kw) -> FilterParams:
    return FilterParams(START[adapter], AS_OF[adapter], **kw)


def days_back(adapter: str, n: int, **kw) -> FilterParams:
    """the "last n days" preset ending at the adapter's as_of."""
    return period_filter(AS_OF[adapter], n, **kw)


def since(adapter: str, start: dt.date, **kw) -> FilterParams:
    return FilterParams(start, AS_OF[adapter], **kw)


class Scenario:
    """A registered query: adapter, parameters, Spark builder and oracle SQL builder.

    (A plain class: this file may be loaded without being registered in
    ``sys.modules``, which dataclasses with string annotations require.)
    """

    __slots__ = ("adapter", "params", "build", "sql", "as_of")

    def __init__(self, adapter: str, params: FilterParams, build: Callable,
                 sql: Callable | None, as_of: dt.date | None = None):
        self.adapter = adapter
        self.params = params
        self.build = build  # (spark, ledger, lf, params, as_of) -> DataFrame
        self.sql = sql  # (adapter, params, as_of) -> str
        self.as_of = as_of


# ----------------------------------------------------------------------------- builders
def _a1(lf):
    return flows.liquidity_metrics(lf)


def _by_fund(lf):
    return status.liquidity_status_by_fund(status.liquidity_status(_a1(lf)))


def _conc_metrics(lf):
    return status.concentration_metrics(flows.concentration(lf))


def _evo_metrics(lf):
    return evolution.evolution_metrics(evolution.balance_pct_change(lf))


def _cube(lf):
    """The daily cube as one exchange that all branches of a composite read."""
    return D.shared(D.daily_cube(lf))


def _all_alerts(lf, as_of):
    return D.alerts(_cube(lf), as_of)


def _kpis(lf, p, as_of):
    return K.kpis(lf, p, as_of)


#: A pack of a user's own, as its YAML file reads: a fourth metric and a query in MySQL's form.
PACK = {
    "metrics": rules.DEFAULT_METRICS | {
        "average_ticket": {"name": "Average ticket", "calculation": "SUM(daily_volume) / operation_count"}},
    "queries": {"withdrawals": """
SELECT nmfundo, COUNT(*) AS withdrawals FROM ledger_view  -- 100%s of the ledger_view
WHERE DATE(dt_lancamento) BETWEEN %s AND %s AND LOWER(lancamento) LIKE '%saque%'
GROUP BY nmfundo"""},
}


def _pack(spark, ledger, p, name, queries=rules.DEFAULT_PACK["queries"]):
    res = rules.run_custom_analysis(spark, ledger, queries, p)
    if name in res.errors:
        raise RuntimeError(res.errors[name])
    return res.frames[name]


#: Formulas that nest, divide by what can be zero, and add to such a quotient.
FORMULAS = {
    "spread": {"calculation": "(MAX(daily_volume) - MIN(daily_volume)) / AVG(daily_volume)"},
    "exit_swing": {"calculation": "MAX(daily_exits) / MIN(daily_exits) + 1"},
    "no_value": {"calculation": "total_entries / (active_days - active_days) + 1"},
    "day_ratio": {"calculation": "AVG(daily_entries / daily_exits)"},
    "net_share": {"calculation": "ABS(net_flow) / (total_entries + total_exits) * 100"},
    "busy": {"calculation": "COALESCE(operation_count / NULLIF(active_days, 0), 0)"},
}

#: A pack of which one query cannot be analysed and one fails while it runs.
MIXED_QUERIES = {
    "by_custodian": """SELECT fonte, COUNT(*) AS n, CAST(SUM(COALESCE(entrada, 0)) AS DOUBLE) AS entries FROM {ledger}
WHERE to_date(dt_lancamento) BETWEEN ? AND ? {fund_filter} {custodian_filter} GROUP BY fonte""",
    "bad_cast": """SELECT nmfundo, SUM(CAST(lancamento AS INT)) AS x FROM {ledger}
WHERE to_date(dt_lancamento) BETWEEN ? AND ? GROUP BY nmfundo""",
    "no_column": "SELECT no_such_column FROM {ledger} WHERE to_date(dt_lancamento) BETWEEN ? AND ?",
    "by_day": """SELECT to_date(dt_lancamento) AS date, COUNT(*) AS n FROM {ledger}
WHERE to_date(dt_lancamento) BETWEEN ? AND ? GROUP BY to_date(dt_lancamento)""",
}


def _rescued(ledger):
    """How many raw values of each column the contract could not keep, and two of them."""
    return (contract.rescued_values(ledger).groupBy("column")
            .agg(F.count("*").alias("n"), F.min("raw").alias("first_raw"), F.max("raw").alias("last_raw")))


def _sink_daily(spark, lf):
    """The daily metrics written as a month-partitioned parquet table and read back."""
    path = scratch_path(spark, "daily-metrics")
    daily = flows.daily_metrics(lf)
    sinks.write_result(daily.withColumn("month", F.date_format("date", "yyyy-MM")), path,
                       partition_by=("month",))
    return to_output(spark.read.parquet(path).select(
        "date", "nmfundo", "fonte", "daily_entries", "daily_exits", "daily_net_flow",
        "daily_operations", "avg_balance", "max_balance", "min_balance"))


_STORES: dict[tuple, tuple[SparkSession, str]] = {}


def _stored(spark, ledger):
    """The ledger written for fast reading, by month; once per session and ledger."""
    hit = _STORES.get((id(spark), id(ledger)))
    if hit is None or hit[0] is not spark:
        hit = (spark, sinks.write_ledger(ledger, scratch_path(spark, "stored-ledger")), ledger)
        _STORES[(id(spark), id(ledger))] = hit
    return hit[1]


def _stored_part(spark, ledger, p):
    """A fund's and period's part of the stored ledger."""
    part = readers.read_ledger(spark, _stored(spark, ledger), period=(p.start_date, p.end_date))
    return filters.apply_filters(part, p)


def _stored_newest(spark, ledger, p):
    newest = readers.read_newest(spark, _stored(spark, ledger), p)
    return X.extract(filters.apply_filters(newest, p), p.limit)


def _published_daily(spark, lf):
    """Two refreshes published one after the other; the reader gets the last whole set."""
    root = scratch_path(spark, "published")
    for frame in (lf.limit(0), lf):
        publish(spark, {"daily_metrics": flows.daily_metrics(frame),
                        "concentration": flows.concentration(frame)}, root)
    return published(spark, root).read("daily_metrics")


B = {
    "extract": lambda s, led, lf, p, a: to_output(X.extract(lf)),
    "extract_limited": lambda s, led, lf, p, a: to_output(X.extract(lf, p.limit)),
    "extract_enriched": lambda s, led, lf, p, a: to_output(X.enriched_extract(lf, p.limit)),
    "available_funds": lambda s, led, lf, p, a: filters.available_funds(led),
    "available_custodians": lambda s, led, lf, p, a: filters.available_custodians(led),
    "fund_search": lambda s, led, lf, p, a: filters.fund_search(filters.available_funds(led), "ion_1"),
    "liquidity_metrics": lambda s, led, lf, p, a: to_output(_a1(lf)),
    "liquidity_status": lambda s, led, lf, p, a: to_output(status.liquidity_status(_a1(lf))),
    "liquidity_status_by_fund": lambda s, led, lf, p, a: to_output(_by_fund(lf)),
    "liquidity_chart": lambda s, led, lf, p, a: to_output(status.liquidity_chart(_a1(lf))),
    "liquidity_stats": lambda s, led, lf, p, a: status.liquidity_stats(_a1(lf)),
    "liquidity_alerts": lambda s, led, lf, p, a: L.liquidity_alerts(_by_fund(lf), a).select(*ALERT_OUT),
    "daily_metrics": lambda s, led, lf, p, a: to_output(flows.daily_metrics(lf)),
    "concentration": lambda s, led, lf, p, a: to_output(flows.concentration(lf)),
    "concentration_top10": lambda s, led, lf, p, a: to_output(
        breakdowns.concentration_top10(flows.concentration(lf))),
    "concentration_overall": lambda s, led, lf, p, a: status.concentration_overall(
        flows.concentration(lf)),
    "concentration_metrics": lambda s, led, lf, p, a: to_output(_conc_metrics(lf)),
    "concentration_alerts": lambda s, led, lf, p, a: L.concentration_alerts(
        _conc_metrics(lf), a).select(*ALERT_OUT),
    "operation_summary": lambda s, led, lf, p, a: to_output(flows.operation_summary(lf)),
    "balance_evolution": lambda s, led, lf, p, a: to_output(lag.balance_evolution(lf)).drop(
        "dt_lancamento", "id_origem"),
    "balance_evolution_lines": lambda s, led, lf, p, a: to_output(lag.balance_evolution(lf)),
    "balance_pct_change": lambda s, led, lf, p, a: to_output(evolution.balance_pct_change(lf)),
    "evolution_metrics": lambda s, led, lf, p, a: _evo_metrics(lf),
    "evolution_alerts": lambda s, led, lf, p, a: L.evolution_alerts(_evo_metrics(lf), a).select(*ALERT_OUT),
    "evolution_stats": lambda s, led, lf, p, a: evolution.evolution_stats(evolution.balance_pct_change(lf)),
    "evolution_by_horizon": lambda s, led, lf, p, a: evolution.evolution_by_horizon(
        led, p, a, EVOLUTION_HORIZONS),
    "kpis": lambda s, led, lf, p, a: _kpis(lf, p, a),
    "kpi_totals": lambda s, led, lf, p, a: K.kpi_part(_kpis(lf, p, a), K.TOTALS),
    "kpi_liquidity": lambda s, led, lf, p, a: K.kpi_part(_kpis(lf, p, a), K.LIQUIDITY),
    "kpi_concentration": lambda s, led, lf, p, a: K.kpi_part(_kpis(lf, p, a), K.CONCENTRATION),
    "kpi_performance": lambda s, led, lf, p, a: K.kpi_part(_kpis(lf, p, a), K.PERFORMANCE),
    "kpi_data_quality": lambda s, led, lf, p, a: K.kpi_part(_kpis(lf, p, a), K.QUALITY),
    "kpi_alerts": lambda s, led, lf, p, a: L.kpi_alerts(_kpis(lf, p, a)),
    "extract_metrics": lambda s, led, lf, p, a: to_output(
        breakdowns.extract_metrics(X.enriched_extract(lf))),
    "extract_metrics_display": lambda s, led, lf, p, a: breakdowns.extract_metrics_display(
        breakdowns.extract_metrics(X.enriched_extract(lf))),
    "category_breakdown": lambda s, led, lf, p, a: to_output(
        breakdowns.category_breakdown(X.enriched_extract(lf))),
    "custodian_comparison": lambda s, led, lf, p, a: to_output(
        breakdowns.custodian_comparison(X.enriched_extract(lf))),
    "concentration_display": lambda s, led, lf, p, a: breakdowns.concentration_display(
        flows.concentration(lf)),
    "rule_fund_liquidity": lambda s, led, lf, p, a: _pack(s, led, p, "fund_liquidity_metrics"),
    "rule_daily_metrics": lambda s, led, lf, p, a: _pack(s, led, p, "daily_metrics"),
    "rule_volume_concentration": lambda s, led, lf, p, a: flows.volume_concentration(lf),
    "rule_balance_volatility": lambda s, led, lf, p, a: flows.balance_volatility(lf),
    "rule_metrics": lambda s, led, lf, p, a: rules.rule_metrics(lf),
    "rule_alerts": lambda s, led, lf, p, a: rules.rule_alerts(
        rules.rule_metrics(lf), rules.DEFAULT_ALERT_RULES, a).drop("message"),
    "pack_metrics": lambda s, led, lf, p, a: rules.pack_metrics(lf, PACK["metrics"]),
    "pack_query": lambda s, led, lf, p, a: _pack(s, led, p, "withdrawals",
                                                 rules.adapt_pack(PACK, "ledger_view")["queries"]),
    "alerts": lambda s, led, lf, p, a: _all_alerts(lf, a).select(*ALERT_OUT),
    "critical_alerts": lambda s, led, lf, p, a: L.critical_only(_all_alerts(lf, a)).select(*ALERT_OUT),
    "warning_alerts": lambda s, led, lf, p, a: L.warning_only(_all_alerts(lf, a)).select(*ALERT_OUT),
    "has_issues": lambda s, led, lf, p, a: L.has_issues(_all_alerts(lf, a)),
    "analysis_summary": lambda s, led, lf, p, a: bundles.analysis_summary(
        _cube(lf), a, ops=D).drop("message", "summary"),
    "pack_formulas": lambda s, led, lf, p, a: rules.pack_metrics(lf, FORMULAS),
    "custom_analysis_status": lambda s, led, lf, p, a: rules.execute_custom_analysis(
        s, led, MIXED_QUERIES, p).status.select("name", "status", "n_rows", "condition"),
    "custom_analysis_result": lambda s, led, lf, p, a: rules.execute_custom_analysis(
        s, led, MIXED_QUERIES, p).frames["by_custodian"],
    "date_labels": lambda s, led, lf, p, a: lf.groupBy(
        date_label(F.to_date("dt_lancamento")).alias("label")).agg(F.count("*").alias("n_lines")),
    "page_extract": lambda s, led, lf, p, a: to_output(page("extract", X.extract(lf), PAGE_ROWS, 2)),
    "page_liquidity_metrics": lambda s, led, lf, p, a: to_output(page("liquidity_metrics", _a1(lf), PAGE_ROWS)),
    "page_daily_metrics": lambda s, led, lf, p, a: to_output(page("daily_metrics", flows.daily_metrics(lf), PAGE_ROWS)),
    "page_daily_trends": lambda s, led, lf, p, a: to_output(page("daily_trends", flows.daily_metrics(lf), PAGE_ROWS)),
    "page_concentration": lambda s, led, lf, p, a: to_output(
        page("concentration", flows.concentration(lf), PAGE_ROWS, 2)),
    "page_operation_summary": lambda s, led, lf, p, a: to_output(
        page("operation_summary", flows.operation_summary(lf), 2)),
    "page_balance_evolution": lambda s, led, lf, p, a: to_output(
        page("balance_evolution", lag.balance_evolution(lf), PAGE_ROWS, 3)),
    "page_balance_pct_change": lambda s, led, lf, p, a: to_output(
        page("balance_pct_change", evolution.balance_pct_change(lf), PAGE_ROWS)),
    "stored_funds": lambda s, led, lf, p, a: filters.available_funds(readers.read_summary(s, _stored(s, led))),
    "stored_custodians": lambda s, led, lf, p, a: filters.available_custodians(
        readers.read_summary(s, _stored(s, led))),
    "stored_fund_search": lambda s, led, lf, p, a: filters.fund_search(
        filters.available_funds(readers.read_summary(s, _stored(s, led))), "ion_1"),
    "stored_liquidity_metrics": lambda s, led, lf, p, a: to_output(_a1(_stored_part(s, led, p))),
    "stored_extract_limited": lambda s, led, lf, p, a: to_output(_stored_newest(s, led, p)),
    "published_daily_metrics": lambda s, led, lf, p, a: to_output(_published_daily(s, lf)),
    "rescued_values": lambda s, led, lf, p, a: _rescued(led),
    "rescued_daily_metrics": lambda s, led, lf, p, a: to_output(flows.daily_metrics(lf)),
    "sink_daily_metrics": lambda s, led, lf, p, a: _sink_daily(s, lf),
    # the same analyses derived from the one-scan daily cube (plans.dashboard)
    "dashboard_kpis": lambda s, led, lf, p, a: D.kpis(D.daily_cube(lf), p, a),
    "dashboard_liquidity_metrics": lambda s, led, lf, p, a: to_output(
        D.liquidity_metrics(D.daily_cube(lf))),
    "dashboard_concentration": lambda s, led, lf, p, a: to_output(D.concentration(D.daily_cube(lf))),
    "dashboard_evolution_metrics": lambda s, led, lf, p, a: evolution.evolution_metrics(
        evolution.with_pct_change(D.daily_metrics(D.daily_cube(lf)))),
    "dashboard_rule_stats": lambda s, led, lf, p, a: D.fund_daily_stats(D.daily_cube(lf)),
}

Q = {
    "extract": O.extract,
    "extract_limited": lambda ad, p, a: O.extract(ad, p, a, limit=p.limit),
    "extract_enriched": O.extract_enriched,
    "available_funds": O.available_funds,
    "available_custodians": O.available_custodians,
    "fund_search": O.fund_search("ion_1"),
    "liquidity_metrics": O.liquidity_metrics,
    "liquidity_status": O.liquidity_status,
    "liquidity_status_by_fund": O.liquidity_status_by_fund,
    "liquidity_chart": O.liquidity_chart,
    "liquidity_stats": O.liquidity_stats,
    "liquidity_alerts": O.liquidity_alerts,
    "daily_metrics": O.daily_metrics,
    "concentration": O.concentration,
    "concentration_top10": O.concentration_top10,
    "concentration_overall": O.concentration_overall,
    "concentration_metrics": O.concentration_metrics,
    "concentration_alerts": O.concentration_alerts,
    "operation_summary": O.operation_summary,
    "balance_evolution": O.balance_evolution,
    "balance_evolution_lines": O.balance_evolution_lines,
    "balance_pct_change": O.balance_pct_change,
    "evolution_metrics": O.evolution_metrics,
    "evolution_alerts": O.evolution_alerts,
    "evolution_stats": O.evolution_stats,
    "evolution_by_horizon": O.evolution_by_horizon(EVOLUTION_HORIZONS),
    "kpis": O.kpis,
    "kpi_totals": O.kpi_part(K.TOTALS),
    "kpi_liquidity": O.kpi_part(K.LIQUIDITY),
    "kpi_concentration": O.kpi_part(K.CONCENTRATION),
    "kpi_performance": O.kpi_part(K.PERFORMANCE),
    "kpi_data_quality": O.kpi_part(K.QUALITY),
    "kpi_alerts": O.kpi_alerts,
    "extract_metrics": O.extract_metrics,
    "extract_metrics_display": O.extract_metrics_display,
    "category_breakdown": O.category_breakdown,
    "custodian_comparison": O.custodian_comparison,
    "concentration_display": O.concentration_display,
    "rule_fund_liquidity": O.rule_fund_liquidity,
    "rule_daily_metrics": O.rule_daily_metrics,
    "rule_volume_concentration": O.rule_volume_concentration,
    "rule_balance_volatility": O.rule_balance_volatility,
    "rule_metrics": O.rule_metrics,
    "rule_alerts": O.rule_alerts(rules.DEFAULT_ALERT_RULES),
    "pack_metrics": O.pack_metrics,
    "pack_query": O.pack_query,
    "alerts": O.alerts,
    "critical_alerts": O.critical_alerts,
    "warning_alerts": O.warning_alerts,
    "has_issues": O.has_issues,
    "analysis_summary": O.analysis_summary,
    "pack_formulas": O.pack_formulas,
    "custom_analysis_status": O.custom_analysis_status,
    "custom_analysis_result": O.custom_analysis_result,
    "date_labels": O.date_labels,
    "page_extract": O.page(O.extract, "dt_lancamento DESC, nmfundo ASC NULLS FIRST, id_origem", PAGE_ROWS, 2),
    "page_liquidity_metrics": O.page(
        O.liquidity_metrics, "total_entries + total_exits DESC, nmfundo ASC NULLS FIRST, fonte ASC NULLS FIRST", PAGE_ROWS),
    "page_daily_metrics": O.page(
        O.daily_metrics, "date DESC, nmfundo ASC NULLS FIRST, fonte ASC NULLS FIRST", PAGE_ROWS),
    "page_daily_trends": O.page(
        O.daily_metrics, "date, nmfundo ASC NULLS FIRST, fonte ASC NULLS FIRST", PAGE_ROWS),
    "page_concentration": O.page(
        O.concentration, "concentration_pct DESC, nmfundo ASC NULLS FIRST, fonte ASC NULLS FIRST", PAGE_ROWS, 2),
    "page_operation_summary": O.page(O.operation_summary, "abs(net_amount) DESC, categoria", 2),
    "page_balance_evolution": O.page(
        O.balance_evolution_lines, "dt_lancamento, nmfundo ASC NULLS FIRST, id_origem", PAGE_ROWS, 3),
    "page_balance_pct_change": O.page(
        O.balance_pct_change, "nmfundo ASC NULLS FIRST, date, fonte ASC NULLS FIRST", PAGE_ROWS),
    "stored_funds": O.available_funds,
    "stored_custodians": O.available_custodians,
    "stored_fund_search": O.fund_search("ion_1"),
    "stored_liquidity_metrics": O.liquidity_metrics,
    "stored_extract_limited": lambda ad, p, a: O.extract(ad, p, a, limit=p.limit),
    "published_daily_metrics": O.daily_metrics,
    "rescued_values": O.rescued_values,
    "rescued_daily_metrics": O.daily_metrics,
    "sink_daily_metrics": O.sink_daily_metrics,
    "dashboard_kpis": O.kpis,
    "dashboard_liquidity_metrics": O.liquidity_metrics,
    "dashboard_concentration": O.concentration,
    "dashboard_evolution_metrics": O.evolution_metrics,
    "dashboard_rule_stats": O.rule_volatility_and_concentration,
}


def _sc(op: str, adapter: str = "orders", params: FilterParams | None = None,
        as_of: dt.date | None = None) -> Scenario:
    return Scenario(adapter, params or full(adapter), B[op], Q[op], as_of)


NATIONS_01 = ("NATION_0", "NATION_1")
TWO_SEGMENTS = ("BUILDING", "MACHINERY")
THREE_NATIONS = ("NATION_1", "NATION_10", "NATION_2")

SCENARIOS: dict[str, Scenario] = {op: _sc(op) for op in B}
SCENARIOS["extract_limited"] = _sc("extract_limited", params=full("orders", limit=MAX_RECORDS_DISPLAY))
for op in ("extract_enriched", "available_funds", "liquidity_metrics", "liquidity_status",
           "daily_metrics", "concentration", "operation_summary", "balance_evolution",
           "balance_pct_change", "evolution_metrics", "evolution_stats", "kpis", "kpi_alerts",
           "category_breakdown", "custodian_comparison", "extract_metrics", "rule_metrics",
           "alerts", "analysis_summary", "balance_evolution_lines", "pack_formulas", "date_labels",
           "custom_analysis_status", "page_balance_evolution"):
    SCENARIOS[f"{op}_events"] = _sc(op, "events")
SCENARIOS["stored_extract_limited"] = _sc("stored_extract_limited", params=full("orders", limit=MAX_RECORDS_DISPLAY))
SCENARIOS["stored_extract_limited_events"] = _sc("stored_extract_limited", "events", params=full("events", limit=500))
SCENARIOS["stored_liquidity_metrics"] = _sc("stored_liquidity_metrics", params=days_back(
    "orders", 400, funds=("NATION_1", "NATION_7"), custodians=("BUILDING", "MACHINERY")))
for op in ("stored_funds", "stored_custodians"):
    SCENARIOS[f"{op}_events"] = _sc(op, "events")
for op in ("rescued_values", "rescued_daily_metrics"):
    SCENARIOS[op] = _sc(op, "export")
for op in ("liquidity_status", "liquidity_status_by_fund", "liquidity_alerts", "evolution_metrics",
           "evolution_alerts", "kpis", "kpi_alerts", "rule_metrics", "rule_alerts", "alerts",
           "critical_alerts", "warning_alerts", "analysis_summary"):
    SCENARIOS[f"{op}_45d"] = _sc(op, params=days_back("orders", 45))
SCENARIOS["liquidity_status_2001"] = _sc("liquidity_status", params=since("orders", dt.date(2001, 1, 1)))
branch = full("orders", funds=NATIONS_01, custodians=TWO_SEGMENTS)
for op in ("concentration", "concentration_metrics", "concentration_alerts", "concentration_overall"):
    SCENARIOS[f"{op}_branch"] = _sc(op, params=branch)
alto = full("orders", funds=("NATION_0", "NATION_1", "NATION_2"), custodians=("BUILDING",))
for op in ("concentration_metrics", "concentration_alerts", "concentration_overall"):
    SCENARIOS[f"{op}_alto"] = _sc(op, params=alto)
SCENARIOS["kpis_one_fund"] = _sc("kpis", params=full("orders", funds=("NATION_1",)))
SCENARIOS["kpis_three_funds"] = _sc("kpis", params=full("orders", funds=THREE_NATIONS))
SCENARIOS["kpis_nation5_recent"] = _sc("kpis", params=since("orders", dt.date(2001, 7, 30),
                                                            funds=("NATION_5",)))
SCENARIOS["kpis_two_days"] = _sc("kpis", params=since("orders", dt.date(2001, 7, 31)))
SCENARIOS["kpis_four_funds_recent"] = _sc("kpis", params=since(
    "orders", dt.date(2001, 7, 25), funds=THREE_NATIONS + ("NATION_3",)))
SCENARIOS["kpi_alerts_four_funds_recent"] = _sc("kpi_alerts", params=since(
    "orders", dt.date(2001, 7, 25), funds=THREE_NATIONS + ("NATION_3",)))
# a page size belongs to listings; totals are always over all lines
SCENARIOS["extract_enriched_limited"] = _sc("extract_enriched",
                                            params=full("orders", limit=MAX_RECORDS_DISPLAY))
SCENARIOS["pack_metrics_events"] = _sc("pack_metrics", "events")
SCENARIOS["pack_query_events"] = _sc("pack_query", "events")
del SCENARIOS["pack_query"]  # adapter A has no such lines
SCENARIOS["kpis_future_events"] = _sc("kpis", "events", as_of=dt.date(2024, 1, 15))
SCENARIOS["kpis_empty"] = _sc("kpis", params=FilterParams(dt.date(1990, 1, 1), dt.date(1990, 1, 31)))
SCENARIOS["kpi_alerts_empty"] = _sc("kpi_alerts", params=FilterParams(dt.date(1990, 1, 1),
                                                                      dt.date(1990, 1, 31)))
SCENARIOS["evolution_by_horizon_events"] = _sc("evolution_by_horizon", "events")
for op in ("dashboard_kpis", "dashboard_liquidity_metrics", "dashboard_concentration",
           "dashboard_evolution_metrics", "dashboard_rule_stats"):
    SCENARIOS[f"{op}_events"] = _sc(op, "events")
    SCENARIOS[f"{op}_45d"] = _sc(op, params=days_back("orders", 45))


_LEDGERS: dict[tuple, tuple[SparkSession, DataFrame]] = {}


def ledger_for(spark: SparkSession, sf_dir: str, adapter: str) -> DataFrame:
    """The adapter's ledger DataFrame, built once per session and folder.

    A DataFrame is an immutable plan (nothing is cached), so queries can
    share it; this saves re-reading parquet footers and re-analysing the
    adapter for every query.
    """
    key = (id(spark), sf_dir, adapter)
    hit = _LEDGERS.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, ADAPTERS[adapter](spark, sf_dir))
        _LEDGERS[key] = hit
    return hit[1]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = SCENARIOS[name]
    configure(spark)
    ledger = ledger_for(spark, sf_dir, sc.adapter)
    lf = filters.apply_filters(ledger, sc.params)
    return sc.build(spark, ledger, lf, sc.params, sc.as_of or AS_OF[sc.adapter])


def sql_for(name: str) -> str | None:
    sc = SCENARIOS[name]
    if sc.sql is None:
        return None
    return sc.sql(sc.adapter, sc.params, sc.as_of or AS_OF[sc.adapter])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the KPI block over the whole sf0.001 ledger (adapter A)."""
    return run("kpis", spark, SMOKE_DIR)


def _importable(query: Callable) -> Callable:
    """The query, run so that Python workers find this repository's modules too."""
    def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
        return query(spark, sf_dir)
    return run_query


def _present(module: str):
    """The module, or None where its file or folder is not there; its own errors are errors."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name and f"{module}.".startswith(f"{missing.name}."):
            return None
        raise


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage and the pipeline, where they are present."""
    llm = _present("fundflow.llm.queries")
    if llm is None:  # the pipeline is made of its operators
        return {}, {}
    found, sql = dict(llm.QUERIES), dict(llm.ORACLE_SQL)
    pipeline = _present("corpus_pipeline")
    if pipeline is not None:
        found["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = pipeline.ORACLE_SQL
    return {name: _importable(query) for name, query in found.items()}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ledger = {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in SCENARIOS}
    return ledger | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in SCENARIOS:
        sql = sql_for(name)
        if sql is not None:
            out[name] = sql
    return out | _training_data()[1]
