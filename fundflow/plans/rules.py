"""Rule packs (X2), custom SQL analyses (X1) and rule-driven alerts.

A rule pack is a mapping with ``metrics``, ``thresholds``, ``alert_rules``
and ``queries``; packs load from ``*.yaml`` files keyed by file stem.
Queries are Spark SQL templates run with ``spark.sql`` over the ledger:

* ``{ledger}`` is the ledger DataFrame (passed as a ``spark.sql`` keyword,
  so no view is registered and no data leaves the cluster);
* ``?`` markers bind the period start and end, in that order, then the
  fund and custodian lists when ``{fund_filter}`` / ``{custodian_filter}``
  are present (they expand to ``AND nmfundo IN (?, ...)`` or nothing).

Templates are Spark SQL: MySQL's ``STDDEV`` (population) must be written
``stddev_pop``.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from fundflow.functions.formatting import render_template
from fundflow.functions.money import dbl, rnd
from fundflow.operators.alerts import stamp
from fundflow.operators.flows import STD_DIGITS, fund_daily, fund_stats
from fundflow.params import FilterParams
from fundflow.plans.formulas import metric
from fundflow.session import scratch_path

# Fixed values that must equal the reference's default rule pack
# ("Análise de Liquidez"): metric formulas, thresholds and the five alert
# rules (name, condition, severity, message), in order.
DEFAULT_ALERT_RULES = (
    {"name": "Liquidez Crítica Baixa", "condition": "liquidity_ratio < 0.5",
     "severity": "critical",
     "message": "Fundo {fund_name} com liquidez crítica: {liquidity_ratio:.2f}"},
    {"name": "Liquidez Baixa", "condition": "liquidity_ratio >= 0.5 AND liquidity_ratio < 0.8",
     "severity": "warning",
     "message": "Fundo {fund_name} com baixa liquidez: {liquidity_ratio:.2f}"},
    {"name": "Liquidez Excessiva", "condition": "liquidity_ratio > 2.0",
     "severity": "warning",
     "message": "Fundo {fund_name} com liquidez excessiva: {liquidity_ratio:.2f}"},
    {"name": "Alta Concentração", "condition": "volume_concentration > 5.0",
     "severity": "critical",
     "message": "Fundo {fund_name} com alta concentração de volume: {volume_concentration:.2f}"},
    {"name": "Alta Volatilidade", "condition": "balance_volatility > 500000",
     "severity": "warning",
     "message": "Fundo {fund_name} com alta volatilidade: R$ {balance_volatility:,.2f}"},
)
DEFAULT_METRICS = {
    "liquidity_ratio": {"name": "Razão de Liquidez", "calculation": "total_entries / ABS(total_exits)",
                        "format": "ratio"},
    "volume_concentration": {"name": "Concentração de Volume",
                             "calculation": "MAX(daily_volume) / AVG(daily_volume)", "format": "ratio"},
    "balance_volatility": {"name": "Volatilidade do Saldo",
                           "calculation": "STDDEV(daily_balance_change)", "format": "currency"},
}
DEFAULT_THRESHOLDS = {
    "liquidity_ratio": {"critical_low": 0.5, "warning_low": 0.0, "optimal_min": 0.9,
                        "optimal_max": 1.1, "warning_high": 1.5, "critical_high": 2.0},
    "volume_concentration": {"warning": 3.0, "critical": 5.0},
    "balance_volatility": {"warning": 100000, "critical": 500000},
}

# Fixed values of the default pack, restated in Spark SQL: its two queries
# (A6 per-fund liquidity, A7 daily flows) with the same output columns.
FUND_LIQUIDITY_SQL = f"""
SELECT nmfundo,
  CAST(SUM(COALESCE(entrada, 0)) AS DOUBLE) AS total_entries,
  CAST(SUM(COALESCE(saida, 0)) AS DOUBLE) AS total_exits,
  COUNT(*) AS operation_count,
  CAST(SUM(COALESCE(entrada, 0) - COALESCE(saida, 0)) AS DOUBLE) / COUNT(*) AS avg_net_flow,
  round(stddev_pop(COALESCE(entrada, 0) - COALESCE(saida, 0)) * {10 ** STD_DIGITS})
    / {10 ** STD_DIGITS} AS flow_volatility
FROM {{ledger}}
WHERE dt_lancamento >= CAST(? AS TIMESTAMP_NTZ)
  AND dt_lancamento < CAST(date_add(?, 1) AS TIMESTAMP_NTZ)
{{fund_filter}}
{{custodian_filter}}
GROUP BY nmfundo
"""
DAILY_METRICS_SQL = """
SELECT to_date(dt_lancamento) AS date, nmfundo,
  CAST(SUM(COALESCE(entrada, 0)) AS DOUBLE) AS daily_entries,
  CAST(SUM(COALESCE(saida, 0)) AS DOUBLE) AS daily_exits,
  CAST(SUM(COALESCE(entrada, 0) - COALESCE(saida, 0)) AS DOUBLE) AS daily_net_flow
FROM {ledger}
WHERE dt_lancamento >= CAST(? AS TIMESTAMP_NTZ)
  AND dt_lancamento < CAST(date_add(?, 1) AS TIMESTAMP_NTZ)
{fund_filter}
{custodian_filter}
GROUP BY to_date(dt_lancamento), nmfundo
"""

DEFAULT_PACK = {
    "name": "Análise de Liquidez",
    "description": "Regras para detectar problemas de liquidez nos fundos",
    "metrics": DEFAULT_METRICS,
    "thresholds": DEFAULT_THRESHOLDS,
    "alert_rules": list(DEFAULT_ALERT_RULES),
    "queries": {"fund_liquidity_metrics": FUND_LIQUIDITY_SQL, "daily_metrics": DAILY_METRICS_SQL},
}


def load_rule_packs(folder: str) -> dict[str, dict]:
    """Every ``*.yaml`` / ``*.yml`` in ``folder``, keyed by file stem."""
    import yaml  # optional dependency, only needed for file-based packs

    packs = {}
    for name in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(name)
        if ext in (".yaml", ".yml"):
            with open(os.path.join(folder, name), encoding="utf-8") as fh:
                packs[stem] = yaml.safe_load(fh) or {}
    return packs


def bind_template(template: str, p: FilterParams) -> tuple[str, list]:
    """Expand the filter placeholders and collect the positional arguments."""
    args: list = [p.start_date, p.end_date]
    fund_filter = custodian_filter = ""
    if p.funds:
        fund_filter = "AND nmfundo IN (" + ", ".join("?" * len(p.funds)) + ")"
        args.extend(p.funds)
    if p.custodians:
        custodian_filter = "AND fonte IN (" + ", ".join("?" * len(p.custodians)) + ")"
        args.extend(p.custodians)
    sql = template.replace("{fund_filter}", fund_filter).replace("{custodian_filter}", custodian_filter)
    return sql, args


#: String literals, quoted names and comments of a MySQL-style query.
_QUOTED = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/)""", re.DOTALL)


def adapt_template(sql: str, source: str, population_stddev: bool = True) -> str:
    """Turn a MySQL-style pack query into this module's template form.

    ``%s`` markers become ``?``, the statement view named ``source`` becomes
    the ``{ledger}`` DataFrame, and -- MySQL's ``STDDEV`` being the
    population deviation -- ``STDDEV(`` becomes ``stddev_pop(``.  Text within
    quotes and comments stays as it is (``LIKE '%saque%'``), and ``source``
    counts as a whole name only.  Nothing else is rewritten; the text must
    otherwise be valid Spark SQL (``DATE(x)``, ``COALESCE``, ``BETWEEN`` ... are).
    """
    def code(text: str) -> str:
        text = re.sub(rf"(?<![\w.`]){re.escape(source)}(?![\w`])", "{ledger}", text, flags=re.IGNORECASE)
        text = re.sub(r"%s(?!\w)", "?", text)
        if population_stddev:
            text = re.sub(r"\bSTDDEV\s*\(", "stddev_pop(", text, flags=re.IGNORECASE)
        return text

    parts = re.split(_QUOTED, sql)
    # a quoted source name is still the source
    return "".join(code(x) if k % 2 == 0 else "{ledger}" if x.strip("`").lower() == source.lower()
                   and x.startswith("`") else x for k, x in enumerate(parts))


def adapt_pack(pack: dict, source: str) -> dict:
    """A rule pack whose queries went through ``adapt_template``."""
    out = dict(pack)
    out["queries"] = {k: adapt_template(v, source) for k, v in (pack.get("queries") or {}).items()}
    return out


@dataclass
class CustomAnalysis:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, Exception] = field(default_factory=dict)

    @property
    def errors(self) -> dict[str, str]:
        return {name: f"{type(exc).__name__}: {exc}" for name, exc in self.failures.items()}


def run_custom_analysis(spark: SparkSession, ledger: DataFrame, queries: dict[str, str],
                        p: FilterParams) -> CustomAnalysis:
    """X1, lazily: bind each named template over the ledger; one that Spark cannot
    analyse is recorded in ``errors`` and does not stop the others.  A query can
    still fail when its frame is run: ``execute_custom_analysis`` runs them."""
    out = CustomAnalysis()
    for name, template in queries.items():
        try:
            sql, args = bind_template(template, p)
            out.frames[name] = spark.sql(sql, args=args, ledger=ledger)
        except Exception as exc:  # analysis / parse errors are per query
            out.failures[name] = exc
    return out


#: Queries of a pack that run side by side.
AT_ONCE = 4
STATUS = "name string, status string, n_rows long, condition string, error string, path string"


@dataclass
class ExecutedAnalysis:
    """Written results: a frame for each query that ran, and a status row for every query."""

    frames: dict[str, DataFrame]
    status: DataFrame

    @property
    def errors(self) -> dict[str, str]:
        return {r["name"]: r["error"] for r in self.status.filter("status = 'failed'").collect()}


def execute_custom_analysis(spark: SparkSession, ledger: DataFrame, queries: dict[str, str], p: FilterParams,
                            folder: str | None = None, at_once: int = AT_ONCE) -> ExecutedAnalysis:
    """X1, isolated at run time: each query is run and written on its own.

    A query that fails while it runs (a bad cast, an overflow) leaves its
    error in its status row and nothing else; the results of the others are
    written to ``folder/<name>`` (a fresh shared folder by default).  The
    queries are independent jobs and run ``at_once`` at a time.  Status rows
    hold name, status (``ok`` or ``failed``), n_rows, the error's condition and
    text, and the path.
    """
    bound = run_custom_analysis(spark, ledger, queries, p)
    root = folder or scratch_path(spark, "custom-analysis")

    def failed(name: str, exc: Exception) -> tuple:
        condition = exc.getCondition() if isinstance(exc, PySparkException) else None
        return name, "failed", None, condition or type(exc).__name__, str(exc), None

    def write(k: int, name: str) -> tuple:
        path = os.path.join(root, f"{k:03d}-{re.sub('[^A-Za-z0-9_.-]', '_', name)}")
        try:
            counted = Observation()
            bound.frames[name].observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
            return name, "ok", counted.get["n"], None, None, path
        except Exception as exc:  # whatever stops one query stops no other
            return failed(name, exc)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(write), range(len(bound.frames)), bound.frames))
    rows = {row[0]: row for row in done} | {name: failed(name, exc) for name, exc in bound.failures.items()}
    frames = {name: spark.read.schema(bound.frames[name].schema).parquet(row[5])
              for name, row in rows.items() if row[1] == "ok"}
    return ExecutedAnalysis(frames, spark.createDataFrame([rows[name] for name in queries], STATUS))


def fund_daily_stats(lf: DataFrame) -> DataFrame:
    """A8 + A9 from one per-(fund, date) aggregation."""
    return fund_stats(fund_daily(lf))


def rule_metrics(lf: DataFrame) -> DataFrame:
    """L5 inputs: per fund liquidity_ratio (A6), volume_concentration (A8) and
    balance_volatility (A9), all from one (fund, date) aggregate of the lines."""
    ratio = F.try_divide(dbl(F.sum("daily_entries")), F.abs(dbl(F.sum("daily_exits"))))
    return fund_stats(fund_daily(lf), ratio.alias("liquidity_ratio")).select(
        "nmfundo", "liquidity_ratio", "volume_concentration", "balance_volatility")


def pack_metrics(lf: DataFrame, metrics: dict[str, dict]) -> DataFrame:
    """A pack's own metrics per fund, from their ``calculation`` formulas (``plans.formulas``).

    One (fund, date) aggregate of the lines feeds them all.  A division by zero
    has no value, as in MySQL.  Deviations are rounded as A9's.
    """
    out = []
    for name, entry in metrics.items():
        value, unstable = metric(entry["calculation"])
        value = dbl(value)
        out.append((rnd(value, STD_DIGITS) if unstable else value).alias(name))
    return fund_daily(lf).groupBy("nmfundo").agg(*out)


def rule_alerts(metrics: DataFrame, rules, as_of: dt.date) -> DataFrame:
    """One alert row per (rule, fund) whose SQL condition holds.

    All rules are evaluated in one pass over the metrics: each fund row
    carries an array with the rules that fire, which is exploded.  (One
    filter per rule unioned together would recompute the metrics -- and
    rescan the ledger -- once per rule.)
    """
    values = [c for c in metrics.columns if c != "nmfundo"]
    cols = {c: F.col(c) for c in values} | {"fund_name": F.col("nmfundo")}
    fired = [F.when(F.coalesce(F.expr(r["condition"]), F.lit(False)), F.struct(
        F.lit(i).alias("rule_order"), F.lit(r["name"]).alias("rule"),
        F.lit(r["severity"]).alias("severity"),
        render_template(r["message"], cols).alias("message")))
        for i, r in enumerate(rules)]
    return (metrics.withColumn("_r", F.explode(F.array_compact(F.array(*fired))))
            .select("_r.rule_order", "_r.rule", "_r.severity", F.col("nmfundo").alias("fund"),
                    *values, "_r.message", stamp(as_of).alias("timestamp")))
