"""Analysis bundles (X4) with their stats (A19, A20, A22) and summaries.

A bundle is a set of lazy DataFrames -- nothing runs until the caller
acts on one of them.  ``summary`` is a one-row frame: success flag, the
"no data" message, the summary sentence and the counts behind it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from fundflow.functions import classify as C
from fundflow.functions.formatting import py_number
from fundflow.operators import alerts as L, breakdowns, evolution, flows, status
from fundflow.params import Thresholds

# Fixed values that must equal the reference's summary texts:
#   no data:       "Sem dados para análise"
#   liquidity:     "Análise de {total} fundos: {critical} críticos, {warning} com alertas"
#   concentration: "Concentração máxima: {max:.1f}% - {alerts} alertas gerados"
#   evolution:     "Evolução de {metrics} fundos analisada - {alerts} alertas de variação"
NO_DATA = "Sem dados para análise"

SUMMARY_COLUMNS = ("analysis_type", "success", "message", "summary", "metric_count",
                   "critical_count", "warning_count", "alert_count", "max_value")


@dataclass
class Analysis:
    analysis_type: str
    metrics: DataFrame
    alerts: DataFrame
    stats: DataFrame
    summary: DataFrame
    data: dict[str, DataFrame] = field(default_factory=dict)

    def critical_alerts(self) -> DataFrame:
        return L.critical_only(self.alerts)

    def warning_alerts(self) -> DataFrame:
        return L.warning_only(self.alerts)

    def has_issues(self) -> DataFrame:
        return L.has_issues(self.alerts)


def _summary(kind: str, counts: DataFrame, text) -> DataFrame:
    ok = F.col("success")
    return counts.select(
        F.lit(kind).alias("analysis_type"), ok,
        F.when(~ok, F.lit(NO_DATA)).alias("message"),
        F.when(ok, text).alias("summary"),
        "metric_count", "critical_count", "warning_count", "alert_count",
        F.col("max_value").cast("double").alias("max_value"))


# Each analysis takes filtered ledger lines, or with ``ops=plans.dashboard`` a
# stored daily cube, from which any number of analyses need no further read.
def analyze_liquidity(lf: DataFrame, as_of: dt.date, t: Thresholds = Thresholds(),
                      ops=flows) -> Analysis:
    a1 = ops.liquidity_metrics(lf)
    by_fund = status.liquidity_status_by_fund(status.liquidity_status(a1, t))
    alerts = L.liquidity_alerts(by_fund, as_of)
    sev = F.col("severity")
    counts = by_fund.agg(
        (F.count(F.lit(1)) > 0).alias("success"),
        F.count(F.lit(1)).alias("metric_count"),
        F.count_if(sev == C.CRITICAL).alias("critical_count"),
        F.count_if(sev == C.WARNING).alias("warning_count"),
        F.count_if(sev.isin(C.WARNING, C.CRITICAL)).alias("alert_count"),
        F.lit(None).cast("double").alias("max_value"))
    text = F.format_string("Análise de %d fundos: %d críticos, %d com alertas",
                           F.col("metric_count"), F.col("critical_count"), F.col("warning_count"))
    return Analysis("liquidity", by_fund, alerts, status.liquidity_stats(a1),
                    _summary("liquidity", counts, text),
                    {"liquidity_metrics": a1, "daily_trends": ops.daily_metrics(lf),
                     "liquidity_chart": status.liquidity_chart(a1)})


def analyze_concentration(lf: DataFrame, as_of: dt.date, t: Thresholds = Thresholds(),
                          ops=flows) -> Analysis:
    a3 = ops.concentration(lf)
    overall = status.concentration_overall(a3, t)
    per_fund = status.concentration_metrics(a3, t)
    alerts = L.concentration_alerts(per_fund, as_of)
    sev = F.col("severity")
    fund_counts = per_fund.select(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sev == C.CRITICAL).alias("crit"),
        F.count_if(sev == C.WARNING).alias("warn")))
    ok = F.col("total_funds") > 0
    counts = overall.withColumn("_fc", fund_counts.scalar()).select("*", "_fc.*").select(
        ok.alias("success"),
        (F.col("n") + F.when(ok, 1).otherwise(0)).alias("metric_count"),
        F.col("crit").alias("critical_count"),
        (F.col("warn") + F.when(F.col("severity") == C.WARNING, 1).otherwise(0)).alias("warning_count"),
        F.col("n").alias("alert_count"),
        F.col("max_concentration").alias("max_value"))
    text = F.concat(F.lit("Concentração máxima: "), py_number(F.col("max_value"), ".1f"),
                    F.lit("% - "), F.col("alert_count").cast("string"), F.lit(" alertas gerados"))
    return Analysis("concentration", per_fund, alerts, overall,
                    _summary("concentration", counts, text),
                    {"concentration_data": a3, "top10": breakdowns.concentration_top10(a3)})


def analyze_balance_evolution(lf: DataFrame, as_of: dt.date,
                              t: Thresholds = Thresholds(), ops=flows) -> Analysis:
    evo = evolution.with_pct_change(ops.daily_metrics(lf))
    metrics = evolution.evolution_metrics(evo, t)
    alerts = L.evolution_alerts(metrics, as_of)
    has_rows = evo.select(F.count(F.lit(1)) > 0)
    warn = F.col("severity") == C.WARNING
    m = metrics.agg(F.count(F.lit(1)).alias("metric_count"),
                    F.count_if(warn).alias("alert_count"))
    counts = m.withColumn("success", has_rows.scalar()).select(
        "success", "metric_count", F.lit(0).cast("long").alias("critical_count"),
        F.col("alert_count").alias("warning_count"), "alert_count",
        F.lit(None).cast("double").alias("max_value"))
    text = F.format_string("Evolução de %d fundos analisada - %d alertas de variação",
                           F.col("metric_count"), F.col("alert_count"))
    return Analysis("balance_evolution", metrics, alerts, evolution.evolution_stats(evo),
                    _summary("balance_evolution", counts, text), {"evolution_data": evo})


def analysis_summary(lf: DataFrame, as_of: dt.date, t: Thresholds = Thresholds(),
                     ops=flows) -> DataFrame:
    """A23 for the three analyses, one row each."""
    out = None
    for build in (analyze_liquidity, analyze_concentration, analyze_balance_evolution):
        s = build(lf, as_of, t, ops).summary.select(*SUMMARY_COLUMNS)
        out = s if out is None else out.unionByName(s)
    return out
