"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each builder returns one SQL string over the driver's pre-registered test
tables: ``WITH extrato AS (<adapter>), lf AS (<filtered ledger>) ...``.
The SQL is written independently of the Spark code; only the scenario
parameters (dates, lists, thresholds) are shared.  Every output column is
aliased and typed like the Spark result (double / bigint / string / date).
"""

from __future__ import annotations

import datetime as dt

from fundflow.params import FilterParams

ADAPTER_SQL = {
    "orders": """
SELECT o_orderkey AS id_origem, c_mktsegment AS fonte, o_custkey AS id_carteira,
       n_name AS nmfundo,
       CASE WHEN c_custkey % 10 = 0 THEN NULL
            ELSE lpad(CAST(c_custkey AS VARCHAR), 14, '0') END AS cnpj,
       CAST(o_orderdate AS TIMESTAMP) AS dt_lancamento,
       CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0)
            THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS entrada,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS saida,
       CAST(c_acctbal AS DECIMAL(18,2)) AS saldo,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'TAXA de administração'
            WHEN '2-HIGH' THEN 'Aporte inicial' WHEN '3-MEDIUM' THEN 'Resgate parcial'
            WHEN '4-NOT SPECIFIED' THEN 'Transferência entre contas' END AS lancamento
FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey""",
    "events": """
SELECT event_id AS id_origem, concat('C', CAST(event_id % 5 AS VARCHAR)) AS fonte,
       user_id AS id_carteira,
       CASE WHEN user_id = 7 THEN NULL WHEN user_id = 13 THEN ''
            ELSE concat('FUNDO_', CAST(user_id % 10 AS VARCHAR)) END AS nmfundo,
       CASE WHEN user_id % 10 = 0 THEN NULL
            ELSE lpad(CAST(user_id AS VARCHAR), 14, '0') END AS cnpj,
       CAST(ts AS TIMESTAMP) AS dt_lancamento,
       CASE WHEN event_type IN ('purchase', 'signup')
            THEN CAST(value AS DECIMAL(18,2)) END AS entrada,
       CASE WHEN event_type IN ('click', 'view')
            THEN CAST(value AS DECIMAL(18,2)) END AS saida,
       CAST(value AS DECIMAL(18,2)) - CAST(20 AS DECIMAL(18,2)) AS saldo,
       CASE event_type WHEN 'purchase' THEN 'COMPRA de ativo'
            WHEN 'signup' THEN 'Aporte inicial' WHEN 'click' THEN 'Tarifa bancária'
            WHEN 'view' THEN 'Resgate / saque' END AS lancamento
FROM events""",
    "export": """
SELECT TRY_CAST(raw_id AS BIGINT) AS id_origem, fonte, nmfundo, lancamento,
       TRY_CAST(raw_dt AS TIMESTAMP) AS dt_lancamento, TRY_CAST(raw_entrada AS DECIMAL(18,2)) AS entrada,
       TRY_CAST(raw_saida AS DECIMAL(18,2)) AS saida, saldo, raw_id, raw_dt, raw_entrada, raw_saida
FROM (SELECT CASE WHEN event_id % 211 = 0 THEN concat('x', event_id) ELSE CAST(event_id AS VARCHAR) END AS raw_id,
        concat('C', event_id % 5) AS fonte, concat('FUNDO_', user_id % 10) AS nmfundo, event_type AS lancamento,
        CASE WHEN event_id % 199 = 0 THEN 'sometime' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw_dt,
        CASE WHEN event_type IN ('purchase', 'signup') THEN amount END AS raw_entrada,
        CASE WHEN event_type IN ('click', 'view') THEN amount END AS raw_saida, CAST(value AS DECIMAL(18,2)) AS saldo
      FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 101 = 0 THEN '1e18'
              WHEN event_id % 103 = 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '9'
              ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS amount FROM events) e) x""",
}

E = "COALESCE(entrada, 0)"
S = "COALESCE(saida, 0)"
B = "COALESCE(saldo, 0)"
DAY = "CAST(dt_lancamento AS DATE)"
INF = "CAST('infinity' AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(round(CAST({expr} AS DOUBLE) * {scale}) / {scale})"


def _lit_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def where(p: FilterParams) -> str:
    parts = [f"{DAY} BETWEEN DATE '{p.start_date}' AND DATE '{p.end_date}'"]
    if p.funds:
        parts.append(f"nmfundo IN ({_lit_list(p.funds)})")
    if p.custodians:
        parts.append(f"fonte IN ({_lit_list(p.custodians)})")
    return " AND ".join(parts)


def base(adapter: str, p: FilterParams, *more: str) -> str:
    ctes = [f"extrato AS ({ADAPTER_SQL[adapter]})", f"lf AS (SELECT * FROM extrato WHERE {where(p)})"]
    ctes.extend(more)
    return "WITH " + ",\n".join(ctes) + "\n"


def ts_lit(d: dt.date) -> str:
    return f"TIMESTAMP '{d} 00:00:00'"


# --------------------------------------------------------------------------- extract

EXTRACT_COLS = f"""id_origem, fonte, id_carteira, nmfundo, cnpj, dt_lancamento,
  {E} AS entrada, {S} AS saida, {B} AS saldo, lancamento"""


def extract(adapter, p, as_of, limit=None):
    order = ""
    if limit:
        order = f" ORDER BY dt_lancamento DESC, nmfundo ASC NULLS FIRST, id_origem ASC LIMIT {limit}"
    inner = f"SELECT {EXTRACT_COLS} FROM lf{order}"
    return base(adapter, p, f"ex AS ({inner})") + """
SELECT id_origem, fonte, id_carteira, nmfundo, cnpj, dt_lancamento,
  CAST(entrada AS DOUBLE) AS entrada, CAST(saida AS DOUBLE) AS saida,
  CAST(saldo AS DOUBLE) AS saldo, lancamento FROM ex"""


CATEGORY_SQL = """CASE
    WHEN contains(lower(lancamento), 'taxa') OR contains(lower(lancamento), 'fee')
      OR contains(lower(lancamento), 'tarifa') THEN 'Taxa'
    WHEN contains(lower(lancamento), 'aplic') OR contains(lower(lancamento), 'aplicação')
      OR contains(lower(lancamento), 'aporte') THEN 'Aplicação'
    WHEN contains(lower(lancamento), 'resgate') OR contains(lower(lancamento), 'saque')
      OR contains(lower(lancamento), 'redenção') THEN 'Resgate'
    WHEN contains(lower(lancamento), 'rendimento') OR contains(lower(lancamento), 'juros')
      OR contains(lower(lancamento), 'yield') THEN 'Rendimento'
    WHEN contains(lower(lancamento), 'transfer') OR contains(lower(lancamento), 'moviment')
      THEN 'Transferência'
    WHEN contains(lower(lancamento), 'compra') OR contains(lower(lancamento), 'purchase')
      THEN 'Compra'
    WHEN contains(lower(lancamento), 'venda') OR contains(lower(lancamento), 'sale') THEN 'Venda'
    ELSE 'Outros' END"""

SUMMARY_CATEGORY_SQL = """CASE
    WHEN contains(lower(lancamento), 'taxa') OR contains(lower(lancamento), 'fee') THEN 'Taxa'
    WHEN contains(lower(lancamento), 'aplic') OR contains(lower(lancamento), 'aporte')
      THEN 'Aplicação'
    WHEN contains(lower(lancamento), 'resgate') OR contains(lower(lancamento), 'saque')
      THEN 'Resgate'
    WHEN contains(lower(lancamento), 'rendimento') OR contains(lower(lancamento), 'juros')
      THEN 'Rendimento'
    WHEN contains(lower(lancamento), 'compra') THEN 'Compra'
    WHEN contains(lower(lancamento), 'venda') THEN 'Venda'
    ELSE 'Outros' END"""


def enriched_cte(limit=None):
    order = ""
    if limit:
        order = f" ORDER BY dt_lancamento DESC, nmfundo ASC NULLS FIRST, id_origem ASC LIMIT {limit}"
    return f"""en AS (
  SELECT *, entrada - saida AS valor,
    CASE WHEN entrada > 0 THEN 'Crédito' WHEN saida > 0 THEN 'Débito' ELSE 'Neutro' END
      AS tipo_lancamento,
    {CATEGORY_SQL} AS categoria,
    CAST(dt_lancamento AS DATE) AS data,
    strftime(dt_lancamento, '%Y-%m') AS mes_ano,
    CAST(year(dt_lancamento) AS INTEGER) AS ano,
    CAST(month(dt_lancamento) AS INTEGER) AS mes
  FROM (SELECT {EXTRACT_COLS} FROM lf{order}) x)"""


def extract_enriched(adapter, p, as_of):
    return base(adapter, p, enriched_cte(p.limit)) + """
SELECT id_origem, fonte, id_carteira, nmfundo, cnpj, dt_lancamento,
  CAST(entrada AS DOUBLE) AS entrada, CAST(saida AS DOUBLE) AS saida,
  CAST(saldo AS DOUBLE) AS saldo, lancamento, CAST(valor AS DOUBLE) AS valor,
  tipo_lancamento, categoria, data, mes_ano, ano, mes FROM en"""


# --------------------------------------------------------------------------- lookups

def available_funds(adapter, p, as_of):
    return f"""WITH extrato AS ({ADAPTER_SQL[adapter]})
SELECT DISTINCT nmfundo FROM extrato WHERE nmfundo IS NOT NULL AND nmfundo <> ''
ORDER BY nmfundo"""


def available_custodians(adapter, p, as_of):
    return f"""WITH extrato AS ({ADAPTER_SQL[adapter]})
SELECT DISTINCT fonte FROM extrato WHERE fonte IS NOT NULL AND fonte <> '' ORDER BY fonte"""


def fund_search(term):
    def build(adapter, p, as_of):
        return f"""WITH extrato AS ({ADAPTER_SQL[adapter]}),
funds AS (SELECT DISTINCT nmfundo FROM extrato WHERE nmfundo IS NOT NULL AND nmfundo <> ''
          ORDER BY nmfundo)
SELECT nmfundo FROM funds WHERE contains(lower(nmfundo), lower('{term}'))"""
    return build


# --------------------------------------------------------------------------- flows

A1_CTE = f"""a1 AS (
  SELECT nmfundo, fonte,
    CAST(SUM({E}) AS DOUBLE) AS total_entries,
    CAST(SUM({S}) AS DOUBLE) AS total_exits,
    CAST(SUM({E} - {S}) AS DOUBLE) AS net_flow,
    COUNT(*) AS operation_count,
    COUNT(DISTINCT {DAY}) AS active_days,
    CAST(SUM({E} - {S}) AS DOUBLE) / COUNT(*) AS avg_daily_flow,
    {rnd(f"stddev_pop({E} - {S})", 4)} AS flow_volatility,
    CAST(MAX(ABS({E} - {S})) AS DOUBLE) AS max_daily_flow,
    CAST(MIN({B}) AS DOUBLE) AS min_balance,
    CAST(MAX({B}) AS DOUBLE) AS max_balance,
    SUM({E}) AS te_d, SUM({S}) AS tx_d
  FROM lf GROUP BY nmfundo, fonte
  HAVING SUM(ABS({E}) + ABS({S})) > 0)"""

A1_COLS = """nmfundo, fonte, total_entries, total_exits, net_flow, operation_count, active_days,
  avg_daily_flow, flow_volatility, max_daily_flow, min_balance, max_balance"""


def liquidity_metrics(adapter, p, as_of):
    return base(adapter, p, A1_CTE) + f"SELECT {A1_COLS} FROM a1"


STATUS_CTE = f"""st AS (
  SELECT *,
    CASE WHEN ABS(total_exits) = 0 THEN {INF} ELSE total_entries / ABS(total_exits) END
      AS liquidity_ratio
  FROM a1),
st2 AS (
  SELECT *,
    CASE WHEN liquidity_ratio < 0.8 THEN 'Baixa' WHEN liquidity_ratio > 1.5 THEN 'Alta'
         ELSE 'Normal' END AS status,
    CASE WHEN liquidity_ratio < 0.8 THEN
           CASE WHEN liquidity_ratio < 0.5 THEN 'critical' ELSE 'warning' END
         WHEN liquidity_ratio > 1.5 THEN 'warning' ELSE 'info' END AS severity
  FROM st)"""

BY_FUND_CTE = """byfund AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY nmfundo
        ORDER BY total_entries + total_exits ASC, fonte DESC NULLS LAST) AS rn
    FROM st2) WHERE rn = 1)"""

STATUS_COLS = A1_COLS + ", liquidity_ratio, status, severity"


def liquidity_status(adapter, p, as_of):
    return base(adapter, p, A1_CTE, STATUS_CTE) + f"SELECT {STATUS_COLS} FROM st2"


def liquidity_status_by_fund(adapter, p, as_of):
    return base(adapter, p, A1_CTE, STATUS_CTE, BY_FUND_CTE) + f"SELECT {STATUS_COLS} FROM byfund"


def liquidity_chart(adapter, p, as_of):
    return base(adapter, p, A1_CTE) + """
SELECT nmfundo, fonte, operation_count, total_entries, total_exits,
  CASE WHEN ABS(total_exits) = 0 THEN CASE WHEN total_entries = 0 THEN NULL ELSE 0.0 END
       ELSE total_entries / ABS(total_exits) END AS liquidity_ratio
FROM a1"""


def liquidity_stats(adapter, p, as_of):
    return base(adapter, p, A1_CTE) + """
SELECT COUNT(*) AS total_funds,
  COALESCE(CASE WHEN ABS(SUM(tx_d)) <> 0
                THEN CAST(SUM(te_d) AS DOUBLE) / CAST(ABS(SUM(tx_d)) AS DOUBLE) END, 0.0)
    AS avg_liquidity_ratio
FROM a1"""


def liquidity_alerts(adapter, p, as_of):
    return base(adapter, p, A1_CTE, STATUS_CTE, BY_FUND_CTE) + f"""
SELECT 'liquidity' AS type, severity, nmfundo AS fund, liquidity_ratio AS value,
  {ts_lit(as_of)} AS timestamp
FROM byfund WHERE severity IN ('warning', 'critical')"""


def daily_metrics(adapter, p, as_of):
    return base(adapter, p) + f"""
SELECT {DAY} AS date, nmfundo, fonte,
  CAST(SUM({E}) AS DOUBLE) AS daily_entries,
  CAST(SUM({S}) AS DOUBLE) AS daily_exits,
  CAST(SUM({E} - {S}) AS DOUBLE) AS daily_net_flow,
  COUNT(*) AS daily_operations,
  CAST(SUM({B}) AS DOUBLE) / COUNT(*) AS avg_balance,
  CAST(MAX({B}) AS DOUBLE) AS max_balance,
  CAST(MIN({B}) AS DOUBLE) AS min_balance
FROM lf GROUP BY {DAY}, nmfundo, fonte"""


A3_CTE = f"""ft AS (
  SELECT nmfundo, fonte, SUM(ABS({E}) + ABS({S})) AS total_volume, COUNT(*) AS operation_count
  FROM lf GROUP BY nmfundo, fonte),
gt AS (SELECT SUM(total_volume) AS grand_total FROM ft),
a3 AS (
  SELECT nmfundo, fonte, CAST(total_volume AS DOUBLE) AS total_volume, operation_count,
    {rnd("CAST(total_volume AS DOUBLE) / NULLIF(CAST(grand_total AS DOUBLE), 0) * 100", 2)}
      AS concentration_pct,
    CASE WHEN CAST(total_volume AS DOUBLE) / NULLIF(CAST(grand_total AS DOUBLE), 0) * 100 > 30
           THEN 'Alto'
         WHEN CAST(total_volume AS DOUBLE) / NULLIF(CAST(grand_total AS DOUBLE), 0) * 100 > 20
           THEN 'Médio'
         ELSE 'Baixo' END AS concentration_level
  FROM ft CROSS JOIN gt WHERE total_volume > 0)"""

A3_COLS = "nmfundo, fonte, total_volume, operation_count, concentration_pct, concentration_level"


def concentration(adapter, p, as_of):
    return base(adapter, p, A3_CTE) + f"SELECT {A3_COLS} FROM a3"


def concentration_top10(adapter, p, as_of):
    return base(adapter, p, A3_CTE) + f"""SELECT {A3_COLS} FROM a3
ORDER BY concentration_pct DESC, nmfundo ASC NULLS FIRST, fonte ASC NULLS FIRST LIMIT 10"""


def concentration_overall(adapter, p, as_of):
    return base(adapter, p, A3_CTE) + """
SELECT COALESCE(MAX(concentration_pct), 0.0) AS max_concentration,
  COUNT(*) FILTER (WHERE concentration_pct > 30.0) AS funds_above_threshold,
  COUNT(*) AS total_funds,
  CASE WHEN MAX(concentration_pct) > 30.0 THEN 'Alto' ELSE 'Normal' END AS status,
  CASE WHEN MAX(concentration_pct) > 30.0 THEN 'warning' ELSE 'info' END AS severity
FROM a3"""


CONC_METRIC_CTE = """cm AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, concentration_level AS status,
      CASE WHEN concentration_pct > 30.0 THEN 'critical' ELSE 'warning' END AS severity,
      row_number() OVER (PARTITION BY nmfundo
                         ORDER BY concentration_pct ASC, fonte DESC NULLS LAST) AS rn
    FROM a3 WHERE concentration_pct > 20.0) WHERE rn = 1)"""


def concentration_metrics(adapter, p, as_of):
    return base(adapter, p, A3_CTE, CONC_METRIC_CTE) + f"SELECT {A3_COLS}, status, severity FROM cm"


def concentration_alerts(adapter, p, as_of):
    return base(adapter, p, A3_CTE, CONC_METRIC_CTE) + f"""
SELECT 'concentration' AS type, severity, nmfundo AS fund, concentration_pct AS value,
  {ts_lit(as_of)} AS timestamp FROM cm"""


def operation_summary(adapter, p, as_of):
    return base(adapter, p) + f"""
SELECT {SUMMARY_CATEGORY_SQL} AS categoria,
  COUNT(*) AS total_operations,
  CAST(SUM({E}) AS DOUBLE) AS total_entries,
  CAST(SUM({S}) AS DOUBLE) AS total_exits,
  CAST(SUM({E} - {S}) AS DOUBLE) AS net_amount,
  COUNT(DISTINCT nmfundo) AS affected_funds,
  CAST(SUM(ABS({E} - {S})) AS DOUBLE) / COUNT(*) AS avg_operation_size
FROM lf GROUP BY 1"""


def balance_evolution(adapter, p, as_of):
    return base(adapter, p) + f"""
SELECT {DAY} AS date, nmfundo, fonte,
  CAST({E} - {S} AS DOUBLE) AS daily_change,
  CAST({B} AS DOUBLE) AS balance,
  CAST(LAG({B}) OVER (PARTITION BY nmfundo ORDER BY dt_lancamento, id_origem) AS DOUBLE)
    AS previous_balance
FROM lf"""


def balance_evolution_lines(adapter, p, as_of):
    return balance_evolution(adapter, p, as_of).replace("\nFROM lf", ", dt_lancamento, id_origem\nFROM lf")


def page(build, order, size, number=1):
    """One page of a result in its display order."""
    return lambda adapter, p, as_of: (f"SELECT * FROM ({build(adapter, p, as_of)}) ORDER BY {order} "
                                      f"LIMIT {size} OFFSET {(number - 1) * size}")


def date_labels(adapter, p, as_of):
    return base(adapter, p) + """
SELECT strftime(dt_lancamento, '%d/%m/%Y') AS label, COUNT(*) AS n_lines FROM lf GROUP BY 1"""


def rescued_values(adapter, p, as_of):
    def money(column):
        cents, whole = f"TRY_CAST(raw_{column} AS DECIMAL(18,2))", f"TRY_CAST(raw_{column} AS DECIMAL(38,10))"
        return (f"SELECT '{column}' AS \"column\", raw_{column} AS raw FROM extrato "
                f"WHERE raw_{column} IS NOT NULL AND ({cents} IS NULL OR {cents} <> {whole})")
    parts = ["SELECT 'id_origem' AS \"column\", raw_id AS raw FROM extrato WHERE id_origem IS NULL",
             "SELECT 'dt_lancamento', raw_dt FROM extrato WHERE dt_lancamento IS NULL", money("entrada"), money("saida")]
    return f"""WITH extrato AS ({ADAPTER_SQL[adapter]}), raws AS ({' UNION ALL '.join(parts)})
SELECT "column", COUNT(*) AS n, MIN(raw) AS first_raw, MAX(raw) AS last_raw FROM raws GROUP BY 1"""


# --------------------------------------------------------------------------- evolution

def _evo_ctes(horizon_keys: str = "") -> list[str]:
    part = f"{horizon_keys}, nmfundo" if horizon_keys else "nmfundo"
    return [
        f"""evo1 AS (
  SELECT *, CASE WHEN nmfundo IS NOT NULL THEN
      SUM(daily_net_flow_d) OVER (PARTITION BY {part} ORDER BY date, fonte ASC NULLS FIRST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum_d
  FROM daily)""",
        f"""evo AS (
  SELECT *, CAST(cum_d AS DOUBLE) AS cumulative_flow,
    CASE WHEN nmfundo IS NULL THEN 0.0 ELSE COALESCE(
      (CAST(cum_d AS DOUBLE) / NULLIF(CAST(LAG(cum_d) OVER (PARTITION BY {part}
         ORDER BY date, fonte ASC NULLS FIRST) AS DOUBLE), 0) - 1) * 100, 0.0) END AS pct_change
  FROM evo1)""",
    ]


DAILY_CTE = f"""daily AS (
  SELECT {DAY} AS date, nmfundo, fonte,
    SUM({E}) AS daily_entries_d, SUM({S}) AS daily_exits_d,
    SUM({E} - {S}) AS daily_net_flow_d, COUNT(*) AS daily_operations,
    CAST(SUM({B}) AS DOUBLE) / COUNT(*) AS avg_balance,
    MAX({B}) AS max_balance_d, MIN({B}) AS min_balance_d
  FROM lf GROUP BY {DAY}, nmfundo, fonte)"""

EVO_COLS = """date, nmfundo, fonte, CAST(daily_entries_d AS DOUBLE) AS daily_entries,
  CAST(daily_exits_d AS DOUBLE) AS daily_exits, CAST(daily_net_flow_d AS DOUBLE) AS daily_net_flow,
  daily_operations, avg_balance, CAST(max_balance_d AS DOUBLE) AS max_balance,
  CAST(min_balance_d AS DOUBLE) AS min_balance, cumulative_flow, pct_change"""


def balance_pct_change(adapter, p, as_of):
    return base(adapter, p, DAILY_CTE, *_evo_ctes()) + f"SELECT {EVO_COLS} FROM evo"


def _a21(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""a21 AS (
  SELECT {k}nmfundo, SUM(pct_change) AS total, stddev_samp(pct_change) AS sd, COUNT(*) AS periods
  FROM evo WHERE nmfundo IS NOT NULL GROUP BY {k}nmfundo HAVING COUNT(*) > 1)"""


A21_COLS = f"""nmfundo, {rnd("total", 6)} AS total_variation, {rnd("sd", 6)} AS volatility, periods,
  CASE WHEN total > 0 THEN 'Positiva' ELSE 'Negativa' END AS trend,
  CASE WHEN ABS(total) > 20.0 THEN 'warning' ELSE 'info' END AS severity"""


def evolution_metrics(adapter, p, as_of):
    return base(adapter, p, DAILY_CTE, *_evo_ctes(), _a21()) + f"SELECT {A21_COLS} FROM a21"


def evolution_alerts(adapter, p, as_of):
    return base(adapter, p, DAILY_CTE, *_evo_ctes(), _a21()) + f"""
SELECT 'evolution' AS type, 'warning' AS severity, nmfundo AS fund,
  {rnd("total", 6)} AS value, {ts_lit(as_of)} AS timestamp
FROM a21 WHERE ABS(total) > 20.0"""


def evolution_stats(adapter, p, as_of):
    return base(adapter, p, DAILY_CTE) + """
SELECT COUNT(DISTINCT date) AS total_periods,
  COUNT(DISTINCT nmfundo) + COALESCE(MAX(CASE WHEN nmfundo IS NULL THEN 1 ELSE 0 END), 0) AS funds_analyzed
FROM daily"""


def evolution_by_horizon(horizons: dict[str, int]):
    def build(adapter, p, as_of):
        widest = max(horizons.values())
        wide = p.with_range(as_of - dt.timedelta(days=widest), as_of)
        tags = " UNION ALL ".join(
            f"SELECT '{name}' AS horizon, {n} AS horizon_days, DATE '{as_of - dt.timedelta(days=n)}' AS since"
            for name, n in horizons.items())
        tagged = f"""daily AS (
  SELECT h.horizon, h.horizon_days, d.* FROM daily0 d JOIN ({tags}) h ON d.date >= h.since)"""
        d0 = DAILY_CTE.replace("daily AS (", "daily0 AS (", 1)
        return base(adapter, wide, d0, tagged, *_evo_ctes("horizon, horizon_days"),
                    _a21("horizon, horizon_days")) + f"SELECT horizon, horizon_days, {A21_COLS} FROM a21"
    return build


# --------------------------------------------------------------------------- KPIs

def kpis_sql(adapter, p: FilterParams, as_of, columns: str | None = None):
    days_div = max(p.period_days, 1)
    now = ts_lit(as_of)
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in
                       ("id_origem", "fonte", "id_carteira", "nmfundo", "cnpj", "lancamento"))
    ctes = [
        f"ex AS (SELECT {EXTRACT_COLS} FROM lf)",
        f"""tot AS (
  SELECT COUNT(*) AS n, SUM(entrada) AS te, SUM(saida) AS ts,
    SUM({nulls}) AS nulls,
    COUNT(*) FILTER (WHERE saldo < 0) AS neg,
    COUNT(*) FILTER (WHERE dt_lancamento > {now}) AS future
  FROM ex)""",
        """dd AS (SELECT CAST(dt_lancamento AS DATE) AS d, SUM(entrada) - SUM(saida) AS net
  FROM ex GROUP BY 1)""",
        "dstat AS (SELECT COUNT(*) AS ndays, stddev_samp(net) AS day_std FROM dd)",
        """fd AS (
  SELECT nmfundo, MIN(saldo) AS bmin, CAST(SUM(saldo) AS DOUBLE) / COUNT(*) AS bmean,
    ABS(SUM(entrada)) + ABS(SUM(saida)) AS v
  FROM ex WHERE nmfundo IS NOT NULL GROUP BY nmfundo)""",
        """fs AS (
  SELECT COUNT(*) AS nfunds, SUM(bmin) AS sum_min, SUM(bmean) AS sum_mean, MIN(bmin) AS min_min,
    AVG(bmean) AS mean_mean,
    COUNT(*) FILTER (WHERE CAST(bmin AS DOUBLE) < bmean * 0.1) AS critical,
    SUM(v) AS vtotal, MAX(v) AS vmax, SUM(pow(CAST(v AS DOUBLE), 2)) AS vsq
  FROM fd)""",
        "t3 AS (SELECT SUM(v) AS v3 FROM (SELECT v FROM fd ORDER BY v DESC LIMIT 3))",
        f"""r AS (
  SELECT *,
    CASE WHEN sum_mean > 0 THEN CAST(sum_min AS DOUBLE) / sum_mean ELSE 0.0 END AS liq,
    CAST(vmax AS DOUBLE) / NULLIF(CAST(vtotal AS DOUBLE), 0) * 100 AS top1,
    CAST(n AS DOUBLE) / {days_div} AS opd,
    CASE WHEN ts <> 0 THEN ABS(CAST(te AS DOUBLE) / CAST(ts AS DOUBLE)) ELSE 0.0 END AS eff,
    CAST(nulls AS DOUBLE) / CAST(n * 17 AS DOUBLE) * 100 AS null_pct
  FROM tot, dstat, fs, t3)""",
        f"""q AS (
  SELECT *, greatest(0.0, least(100.0,
    100.0 - CASE WHEN nulls > 0 THEN null_pct * 2 ELSE 0.0 END
          - CASE WHEN neg > n * 0.1 THEN 10 ELSE 0 END
          - CASE WHEN future > 0 THEN 20 ELSE 0 END)) AS score
  FROM r)""",
    ]
    hv = "COALESCE(vtotal, 0) <> 0"
    body = f"""
SELECT
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(ABS(te) + ABS(ts) AS DOUBLE) END AS total_volume,
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(te - ts AS DOUBLE) END AS net_flow,
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(te AS DOUBLE) END AS total_entries,
  CASE WHEN n = 0 THEN 0.0 ELSE CAST(ts AS DOUBLE) END AS total_exits,
  n AS operation_count,
  CASE WHEN n = 0 THEN 0 ELSE nfunds END AS active_funds,
  CASE WHEN n = 0 THEN 0.0 ELSE {rnd("liq", 4)} END AS liquidity_ratio,
  CASE WHEN n = 0 THEN NULL ELSE CAST(min_min AS DOUBLE) END AS min_balance,
  CASE WHEN n = 0 THEN NULL ELSE {rnd("mean_mean", 6)} END AS avg_balance,
  CASE WHEN n = 0 THEN NULL ELSE critical END AS critical_funds_count,
  CASE WHEN n = 0 THEN 'Desconhecido' WHEN liq < 0.5 THEN 'Alto' WHEN liq < 0.8 THEN 'Médio'
       ELSE 'Baixo' END AS liquidity_risk_level,
  CASE WHEN n = 0 THEN 0.0 WHEN {hv} THEN {rnd("vsq / pow(CAST(vtotal AS DOUBLE), 2) * 100", 2)}
       ELSE 0.0 END AS concentration_index,
  CASE WHEN n = 0 THEN NULL WHEN {hv} THEN {rnd("top1", 2)} ELSE 0.0 END AS top_fund_percentage,
  CASE WHEN n = 0 THEN NULL WHEN {hv}
       THEN {rnd("CAST(v3 AS DOUBLE) / NULLIF(CAST(vtotal AS DOUBLE), 0) * 100", 2)} END
    AS top_3_funds_percentage,
  CASE WHEN n = 0 THEN 'Desconhecido' WHEN NOT ({hv}) THEN NULL
       WHEN top1 > 50 THEN 'Alto' WHEN top1 > 30 THEN 'Médio' ELSE 'Baixo' END
    AS concentration_risk_level,
  CASE WHEN n = 0 THEN 0.0 ELSE {rnd("opd", 2)} END AS daily_avg_operations,
  CASE WHEN n = 0 THEN NULL ELSE {rnd("eff", 4)} END AS operational_efficiency,
  CASE WHEN n = 0 THEN NULL ELSE {rnd("CASE WHEN ndays > 1 THEN day_std ELSE 0.0 END", 2)} END
    AS flow_volatility,
  CASE WHEN n = 0 THEN 'Desconhecida' WHEN opd > 10 AND eff > 0.8 THEN 'Boa'
       WHEN opd > 5 THEN 'Regular' ELSE 'Baixa' END AS operational_health,
  {now} AS last_update,
  CASE WHEN n = 0 THEN NULL ELSE CAST({p.period_days} AS BIGINT) END AS period_days,
  CASE WHEN n = 0 THEN 0.0 ELSE score END AS data_quality_score
FROM q"""
    sql = base(adapter, p, *ctes) + body
    if columns:
        sql = f"SELECT {columns} FROM ({sql}) k"
    return sql


def kpis(adapter, p, as_of):
    return kpis_sql(adapter, p, as_of)


def kpi_part(columns):
    def build(adapter, p, as_of):
        return kpis_sql(adapter, p, as_of, ", ".join(columns))
    return build


def kpi_alerts(adapter, p, as_of):
    return f"""SELECT * FROM (
  SELECT 0 AS rule_order, 'liquidity_risk' AS alert,
    '🚨 **Risco de Liquidez Alto** - Saldos críticos detectados' AS message
  FROM ({kpis_sql(adapter, p, as_of)}) k WHERE liquidity_risk_level = 'Alto'
  UNION ALL
  SELECT 1, 'concentration_risk', '⚠️ **Alta Concentração** - Risco concentrado em poucos fundos'
  FROM ({kpis_sql(adapter, p, as_of)}) k WHERE concentration_risk_level = 'Alto'
  UNION ALL
  SELECT 2, 'data_quality', '📋 **Qualidade de Dados Baixa** - Verificar inconsistências'
  FROM ({kpis_sql(adapter, p, as_of)}) k WHERE data_quality_score < 70
  UNION ALL
  SELECT 3, 'operational_health', '⚡ **Baixa Atividade Operacional** - Poucas operações no período'
  FROM ({kpis_sql(adapter, p, as_of)}) k WHERE operational_health = 'Baixa') a"""


# --------------------------------------------------------------------------- breakdowns

def extract_metrics(adapter, p, as_of):
    return base(adapter, p, enriched_cte()) + """
SELECT CAST(COALESCE(SUM(valor) FILTER (WHERE tipo_lancamento = 'Crédito'), 0) AS DOUBLE) AS creditos,
  CAST(ABS(COALESCE(SUM(valor) FILTER (WHERE tipo_lancamento = 'Débito'), 0)) AS DOUBLE) AS debitos,
  CAST(COALESCE(SUM(valor), 0) AS DOUBLE) AS saldo_final,
  COUNT(*) FILTER (WHERE tipo_lancamento = 'Crédito') AS n_creditos,
  COUNT(*) FILTER (WHERE tipo_lancamento = 'Débito') AS n_debitos,
  COUNT(*) AS n_total
FROM en"""


def _brl(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL THEN 'R$ 0,00' ELSE "
            f"'R$ ' || translate(format('{{:,.2f}}', CAST({expr} AS DOUBLE)), ',.', '.,') END")


def extract_metrics_display(adapter, p, as_of):
    return f"""SELECT {_brl("creditos")} AS creditos, {_brl("debitos")} AS debitos,
  {_brl("saldo_final")} AS saldo_final, n_creditos, n_debitos, n_total
FROM ({extract_metrics(adapter, p, as_of)}) m"""


def _pct_br(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR isnan({expr}) THEN '0,00%' ELSE "
            f"replace(printf('%.2f', {expr}), '.', ',') || '%' END")


def concentration_display(adapter, p, as_of):
    return base(adapter, p, A3_CTE) + f"""
SELECT nmfundo, fonte, {_brl("total_volume")} AS total_volume,
  {_pct_br("concentration_pct")} AS concentration_pct, concentration_level FROM a3"""


def category_breakdown(adapter, p, as_of):
    return base(adapter, p, enriched_cte()) + """
SELECT categoria, CAST(SUM(valor) AS DOUBLE) AS valor_sum, COUNT(valor) AS valor_count,
  CAST(ABS(SUM(valor)) AS DOUBLE) AS valor_abs
FROM en GROUP BY categoria"""


def custodian_comparison(adapter, p, as_of):
    return base(adapter, p, enriched_cte()) + """
SELECT fonte, CAST(SUM(valor) AS DOUBLE) AS valor, CAST(ABS(SUM(valor)) AS DOUBLE) AS valor_abs,
  COUNT(DISTINCT nmfundo) AS n_funds
FROM en WHERE fonte IS NOT NULL GROUP BY fonte"""


# --------------------------------------------------------------------------- rule pack

A6_CTE = f"""a6 AS (
  SELECT nmfundo, CAST(SUM({E}) AS DOUBLE) AS total_entries, CAST(SUM({S}) AS DOUBLE) AS total_exits,
    COUNT(*) AS operation_count, CAST(SUM({E} - {S}) AS DOUBLE) / COUNT(*) AS avg_net_flow,
    {rnd(f"stddev_pop({E} - {S})", 4)} AS flow_volatility
  FROM lf GROUP BY nmfundo)"""

FUND_DAILY_CTE = f"""fdaily AS (
  SELECT nmfundo, {DAY} AS date, SUM(ABS({E}) + ABS({S})) AS daily_volume,
    SUM({E} - {S}) AS daily_balance_change
  FROM lf GROUP BY nmfundo, {DAY})"""

A8_CTE = """a8 AS (
  SELECT nmfundo, CAST(MAX(daily_volume) AS DOUBLE)
      / NULLIF(CAST(SUM(daily_volume) AS DOUBLE) / COUNT(*), 0) AS volume_concentration
  FROM fdaily GROUP BY nmfundo)"""

A9_CTE = f"""a9 AS (
  SELECT nmfundo, {rnd("stddev_pop(daily_balance_change)", 4)} AS balance_volatility
  FROM fdaily GROUP BY nmfundo)"""


def rule_fund_liquidity(adapter, p, as_of):
    return base(adapter, p, A6_CTE) + """SELECT nmfundo, total_entries, total_exits, operation_count,
  avg_net_flow, flow_volatility FROM a6"""


def rule_daily_metrics(adapter, p, as_of):
    return base(adapter, p) + f"""
SELECT {DAY} AS date, nmfundo, CAST(SUM({E}) AS DOUBLE) AS daily_entries,
  CAST(SUM({S}) AS DOUBLE) AS daily_exits, CAST(SUM({E} - {S}) AS DOUBLE) AS daily_net_flow
FROM lf GROUP BY {DAY}, nmfundo"""


def rule_volume_concentration(adapter, p, as_of):
    return base(adapter, p, FUND_DAILY_CTE, A8_CTE) + "SELECT nmfundo, volume_concentration FROM a8"


def rule_balance_volatility(adapter, p, as_of):
    return base(adapter, p, FUND_DAILY_CTE, A9_CTE) + "SELECT nmfundo, balance_volatility FROM a9"


RULE_METRICS_CTE = """rm AS (
  SELECT a6.nmfundo,
    total_entries / NULLIF(ABS(total_exits), 0) AS liquidity_ratio,
    volume_concentration, balance_volatility
  FROM a6 JOIN a8 ON a6.nmfundo IS NOT DISTINCT FROM a8.nmfundo
          JOIN a9 ON a6.nmfundo IS NOT DISTINCT FROM a9.nmfundo)"""


def rule_volatility_and_concentration(adapter, p, as_of):
    return base(adapter, p, FUND_DAILY_CTE, A8_CTE, A9_CTE) + """
SELECT a8.nmfundo, volume_concentration, balance_volatility
FROM a8 JOIN a9 ON a8.nmfundo IS NOT DISTINCT FROM a9.nmfundo"""


def rule_metrics(adapter, p, as_of):
    return base(adapter, p, A6_CTE, FUND_DAILY_CTE, A8_CTE, A9_CTE, RULE_METRICS_CTE) + """
SELECT nmfundo, liquidity_ratio, volume_concentration, balance_volatility FROM rm"""


def pack_metrics(adapter, p, as_of):
    return base(adapter, p, A6_CTE, FUND_DAILY_CTE, A8_CTE, A9_CTE, RULE_METRICS_CTE,
                f"""ticket AS (SELECT nmfundo, CAST(SUM(ABS({E}) + ABS({S})) AS DOUBLE) / COUNT(*) AS average_ticket
  FROM lf GROUP BY nmfundo)""") + """
SELECT rm.nmfundo, liquidity_ratio, volume_concentration, balance_volatility, average_ticket
FROM rm JOIN ticket ON rm.nmfundo IS NOT DISTINCT FROM ticket.nmfundo"""


def pack_formulas(adapter, p, as_of):
    return base(adapter, p, FUND_DAILY_CTE, f"""d AS (
  SELECT nmfundo, CAST(dt_lancamento AS DATE) AS date, SUM(ABS({E}) + ABS({S})) AS v, SUM({E}) AS e, SUM({S}) AS s,
    COUNT(*) AS n FROM lf GROUP BY 1, 2),
t AS (SELECT nmfundo, CAST(SUM(e) AS DOUBLE) AS te, CAST(SUM(s) AS DOUBLE) AS ts, CAST(SUM(e - s) AS DOUBLE) AS net,
    SUM(n) AS ops, COUNT(*) AS days, CAST(MAX(v) AS DOUBLE) AS vmax, CAST(MIN(v) AS DOUBLE) AS vmin,
    CAST(SUM(v) AS DOUBLE) / COUNT(*) AS vavg, CAST(MAX(s) AS DOUBLE) AS smax, CAST(MIN(s) AS DOUBLE) AS smin,
    AVG(CASE WHEN s <> 0 THEN CAST(e AS DOUBLE) / CAST(s AS DOUBLE) END) AS ratio
  FROM d GROUP BY nmfundo)""") + """
SELECT nmfundo, CASE WHEN vavg <> 0 THEN (vmax - vmin) / vavg END AS spread,
  CASE WHEN smin <> 0 THEN smax / smin + 1 END AS exit_swing, CAST(NULL AS DOUBLE) AS no_value, round(ratio * 10000) / 10000 AS day_ratio,
  CASE WHEN te + ts <> 0 THEN abs(net) / (te + ts) * 100 END AS net_share, CAST(ops AS DOUBLE) / days AS busy FROM t"""


def custom_analysis_status(adapter, p, as_of):
    return base(adapter, p) + f"""
SELECT 'by_custodian' AS name, 'ok' AS status, COUNT(DISTINCT COALESCE(fonte, '\x00')) AS n_rows,
  CAST(NULL AS VARCHAR) AS condition FROM lf
UNION ALL SELECT 'by_day', 'ok', COUNT(DISTINCT {DAY}), NULL FROM lf
UNION ALL SELECT 'bad_cast', 'failed', NULL, 'CAST_INVALID_INPUT'
UNION ALL SELECT 'no_column', 'failed', NULL, 'UNRESOLVED_COLUMN.WITH_SUGGESTION'"""


def custom_analysis_result(adapter, p, as_of):
    return base(adapter, p) + f"SELECT fonte, COUNT(*) AS n, CAST(SUM({E}) AS DOUBLE) AS entries FROM lf GROUP BY fonte"


def pack_query(adapter, p, as_of):
    return base(adapter, p) + """
SELECT nmfundo, COUNT(*) AS withdrawals FROM lf WHERE contains(lower(lancamento), 'saque') GROUP BY nmfundo"""


def rule_alerts(rules):
    def build(adapter, p, as_of):
        parts = [f"""SELECT {i} AS rule_order, '{r["name"]}' AS rule, '{r["severity"]}' AS severity,
  nmfundo AS fund, liquidity_ratio, volume_concentration, balance_volatility,
  {ts_lit(as_of)} AS timestamp
FROM rm WHERE {r["condition"]}""" for i, r in enumerate(rules)]
        return base(adapter, p, A6_CTE, FUND_DAILY_CTE, A8_CTE, A9_CTE, RULE_METRICS_CTE) + \
            "\nUNION ALL\n".join(parts)
    return build


# --------------------------------------------------------------------------- combined alerts

def _alerts_union(adapter, p, as_of):
    return base(adapter, p, A1_CTE, STATUS_CTE, BY_FUND_CTE, A3_CTE, CONC_METRIC_CTE,
                DAILY_CTE, *_evo_ctes(), _a21(), f"""alerts AS (
  SELECT 'liquidity' AS type, severity, nmfundo AS fund, liquidity_ratio AS value,
    {ts_lit(as_of)} AS timestamp FROM byfund WHERE severity IN ('warning', 'critical')
  UNION ALL
  SELECT 'concentration', severity, nmfundo, concentration_pct, {ts_lit(as_of)} FROM cm
  UNION ALL
  SELECT 'evolution', 'warning', nmfundo, {rnd("total", 6)}, {ts_lit(as_of)} FROM a21
  WHERE ABS(total) > 20.0)""")


def alerts(adapter, p, as_of):
    return _alerts_union(adapter, p, as_of) + "SELECT type, severity, fund, value, timestamp FROM alerts"


def critical_alerts(adapter, p, as_of):
    return _alerts_union(adapter, p, as_of) + \
        "SELECT type, severity, fund, value, timestamp FROM alerts WHERE severity = 'critical'"


def warning_alerts(adapter, p, as_of):
    return _alerts_union(adapter, p, as_of) + \
        "SELECT type, severity, fund, value, timestamp FROM alerts WHERE severity = 'warning'"


def has_issues(adapter, p, as_of):
    return _alerts_union(adapter, p, as_of) + \
        "SELECT COUNT(*) FILTER (WHERE severity IN ('warning', 'critical')) > 0 AS has_issues FROM alerts"


def analysis_summary(adapter, p, as_of):
    return base(adapter, p, A1_CTE, STATUS_CTE, BY_FUND_CTE, A3_CTE, CONC_METRIC_CTE,
                DAILY_CTE, *_evo_ctes(), _a21()) + """
SELECT 'liquidity' AS analysis_type, COUNT(*) > 0 AS success, COUNT(*) AS metric_count,
  COUNT(*) FILTER (WHERE severity = 'critical') AS critical_count,
  COUNT(*) FILTER (WHERE severity = 'warning') AS warning_count,
  COUNT(*) FILTER (WHERE severity IN ('warning', 'critical')) AS alert_count,
  CAST(NULL AS DOUBLE) AS max_value
FROM byfund
UNION ALL
SELECT 'concentration', (SELECT COUNT(*) FROM a3) > 0,
  COUNT(*) + CASE WHEN (SELECT COUNT(*) FROM a3) > 0 THEN 1 ELSE 0 END,
  COUNT(*) FILTER (WHERE severity = 'critical')
    + CASE WHEN (SELECT COUNT(*) FROM a3) > 0 THEN 0 ELSE 0 END,
  COUNT(*) FILTER (WHERE severity = 'warning')
    + CASE WHEN (SELECT MAX(concentration_pct) FROM a3) > 30.0 THEN 1 ELSE 0 END,
  COUNT(*),
  (SELECT COALESCE(MAX(concentration_pct), 0.0) FROM a3)
FROM cm
UNION ALL
SELECT 'balance_evolution', (SELECT COUNT(*) FROM daily) > 0, COUNT(*),
  0, COUNT(*) FILTER (WHERE ABS(total) > 20.0), COUNT(*) FILTER (WHERE ABS(total) > 20.0),
  CAST(NULL AS DOUBLE)
FROM a21"""


def sink_daily_metrics(adapter, p, as_of):
    return daily_metrics(adapter, p, as_of)
