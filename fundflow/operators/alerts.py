"""Alert operators L1-L4 and L6.

An alert is a row ``(type, severity, fund, message, value, timestamp,
metadata)``; ``timestamp`` is the caller's ``as_of`` (the reference stamps
``now()``), ``metadata`` a ``map<string,double>``.  Alert frames of
different analyses combine with ``unionByName``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fundflow.functions import classify as C
from fundflow.functions.formatting import render_template

# Fixed values that must equal the reference's (alert types, messages, the quality floor);
# KPI alerts in order.
LIQUIDITY_MSG = "Fundo {fund} com liquidez {status}: {value:.2f}"
CONCENTRATION_MSG = "Alta concentração no fundo {fund}: {value:.1f}%"
EVOLUTION_MSG = "Grande variação no saldo do fundo {fund}: {value:.1f}%"
KPI_ALERTS = (
    ("liquidity_risk", "🚨 **Risco de Liquidez Alto** - Saldos críticos detectados"),
    ("concentration_risk", "⚠️ **Alta Concentração** - Risco concentrado em poucos fundos"),
    ("data_quality", "📋 **Qualidade de Dados Baixa** - Verificar inconsistências"),
    ("operational_health", "⚡ **Baixa Atividade Operacional** - Poucas operações no período"),
)
QUALITY_FLOOR = 70

ALERT_COLUMNS = ("type", "severity", "fund", "message", "value", "timestamp", "metadata")


def stamp(as_of: dt.date) -> Column:
    return F.lit(as_of).cast(T.TimestampNTZType())  # zone-free midnight


def _meta(**cols: Column) -> Column:
    args = []
    for k, c in cols.items():
        args += [F.lit(k), c.cast("double")]
    return F.create_map(*args)


def _alert(df: DataFrame, kind: str, template: str, value: Column, as_of: dt.date,
           meta: Column, status: Column | None = None) -> DataFrame:
    fills = {"fund": F.col("nmfundo"), "value": value}
    if status is not None:
        fills["status"] = status
    return df.select(
        F.lit(kind).alias("type"), F.col("severity"), F.col("nmfundo").alias("fund"),
        render_template(template, fills).alias("message"),
        value.cast("double").alias("value"), stamp(as_of).alias("timestamp"),
        meta.alias("metadata"))


def liquidity_alerts(by_fund: DataFrame, as_of: dt.date) -> DataFrame:
    """L1: funds (W4 rows of C5) whose severity is warning or critical."""
    hit = by_fund.filter(F.col("severity").isin(C.WARNING, C.CRITICAL))
    return _alert(hit, "liquidity", LIQUIDITY_MSG, F.col("liquidity_ratio"), as_of,
                  _meta(total_entries=F.col("total_entries"), total_exits=F.col("total_exits"),
                        net_flow=F.col("net_flow"), operation_count=F.col("operation_count"),
                        volatility=F.col("flow_volatility")),
                  status=F.lower(F.col("status")))


def concentration_alerts(conc_metrics: DataFrame, as_of: dt.date) -> DataFrame:
    """L2: every per-fund concentration metric (C5c after W4)."""
    hit = conc_metrics.filter(F.col("severity").isin(C.WARNING, C.CRITICAL))
    return _alert(hit, "concentration", CONCENTRATION_MSG, F.col("concentration_pct"), as_of,
                  _meta(total_volume=F.col("total_volume"),
                        operation_count=F.col("operation_count")))


def evolution_alerts(evo_metrics: DataFrame, as_of: dt.date) -> DataFrame:
    """L3: funds whose total variation, unrounded, exceeds A21's threshold."""
    hit = evo_metrics.filter(F.col("severity") == C.WARNING)
    return _alert(hit, "evolution", EVOLUTION_MSG, F.col("total_variation"), as_of,
                  _meta(volatility=F.col("volatility"), periods=F.col("periods")))


def kpi_alerts(k: DataFrame) -> DataFrame:
    """L4: the four KPI-row rules, one output row per rule that fires."""
    fire = {
        "liquidity_risk": F.col("liquidity_risk_level") == C.HIGH,
        "concentration_risk": F.col("concentration_risk_level") == C.HIGH,
        "data_quality": F.col("data_quality_score") < QUALITY_FLOOR,
        "operational_health": F.col("operational_health") == C.POOR,
    }
    items = [F.when(F.coalesce(fire[code], F.lit(False)),
                    F.struct(F.lit(i).alias("rule_order"), F.lit(code).alias("alert"),
                             F.lit(msg).alias("message")))
             for i, (code, msg) in enumerate(KPI_ALERTS)]
    return (k.select(F.explode(F.array_compact(F.array(*items))).alias("a"))
            .select("a.rule_order", "a.alert", "a.message"))


def combine(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        f = f.select(*ALERT_COLUMNS)
        out = f if out is None else out.unionByName(f)
    return out


def critical_only(alerts: DataFrame) -> DataFrame:
    """Critical alerts."""
    return alerts.filter(F.col("severity") == C.CRITICAL)


def warning_only(alerts: DataFrame) -> DataFrame:
    """Warning alerts."""
    return alerts.filter(F.col("severity") == C.WARNING)


def has_issues(alerts: DataFrame) -> DataFrame:
    """One row -- is there any warning or critical alert?"""
    hit = alerts.filter(F.col("severity").isin(C.WARNING, C.CRITICAL)).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("has_issues"))
