"""Classification expressions (CASE logic) -- all native, no Python UDF.

Each function returns a Column; lists are turned into one ``CASE WHEN``
chain, evaluated in order (first hit wins).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fundflow.params import Thresholds

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, keyword lists, order).
# Operation type (C1): entrada > 0 -> "Crédito"; else saida > 0 -> "Débito";
#   else "Neutro".
# Extract category (C2), lower-cased substring match, first hit wins:
#   Taxa: taxa, fee, tarifa
#   Aplicação: aplic, aplicação, aporte
#   Resgate: resgate, saque, redenção
#   Rendimento: rendimento, juros, yield
#   Transferência: transfer, moviment
#   Compra: compra, purchase
#   Venda: venda, sale
#   otherwise (and NULL): Outros
# Summary category (C3, the SQL summary's shorter list):
#   Taxa: taxa, fee
#   Aplicação: aplic, aporte
#   Resgate: resgate, saque
#   Rendimento: rendimento, juros
#   Compra: compra
#   Venda: venda
#   otherwise (and NULL): Outros
# Levels: concentration Alto > 30, Médio > 20, else Baixo;
#   liquidity Baixa / Normal / Alta; KPI risk Alto / Médio / Baixo;
#   health Boa / Regular / Baixa; trend Positiva / Negativa;
#   unknown labels Desconhecido / Desconhecida.
# ---------------------------------------------------------------------------
CREDIT, DEBIT, NEUTRAL = "Crédito", "Débito", "Neutro"
OTHER = "Outros"
EXTRACT_CATEGORIES = (
    ("Taxa", ("taxa", "fee", "tarifa")),
    ("Aplicação", ("aplic", "aplicação", "aporte")),
    ("Resgate", ("resgate", "saque", "redenção")),
    ("Rendimento", ("rendimento", "juros", "yield")),
    ("Transferência", ("transfer", "moviment")),
    ("Compra", ("compra", "purchase")),
    ("Venda", ("venda", "sale")),
)
SUMMARY_CATEGORIES = (
    ("Taxa", ("taxa", "fee")),
    ("Aplicação", ("aplic", "aporte")),
    ("Resgate", ("resgate", "saque")),
    ("Rendimento", ("rendimento", "juros")),
    ("Compra", ("compra",)),
    ("Venda", ("venda",)),
)
HIGH, MEDIUM, LOW = "Alto", "Médio", "Baixo"
LIQ_LOW, LIQ_NORMAL, LIQ_HIGH = "Baixa", "Normal", "Alta"
GOOD, REGULAR, POOR = "Boa", "Regular", "Baixa"
POSITIVE, NEGATIVE = "Positiva", "Negativa"
UNKNOWN_M, UNKNOWN_F = "Desconhecido", "Desconhecida"
INFO, WARNING, CRITICAL = "info", "warning", "critical"


def operation_type(entrada: Column, saida: Column) -> Column:
    """Inflow wins even when there is also an outflow."""
    return (F.when(entrada > 0, CREDIT).when(saida > 0, DEBIT).otherwise(NEUTRAL))


def _keyword_case(text: Column, table) -> Column:
    low = F.lower(text)
    expr = None
    for label, words in table:
        hit = None
        for w in words:
            cond = low.contains(w)
            hit = cond if hit is None else (hit | cond)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    # NULL text: every contains() is NULL -> falls through to Outros
    return expr.otherwise(OTHER)


def extract_category(text: Column) -> Column:
    """Category of the enriched extract."""
    return _keyword_case(text, EXTRACT_CATEGORIES)


def summary_category(text: Column) -> Column:
    """Category of the operation summary (shorter list, no Transferência)."""
    return _keyword_case(text, SUMMARY_CATEGORIES)


def concentration_level(pct_unrounded: Column) -> Column:
    """C4 on the unrounded percentage."""
    return F.when(pct_unrounded > 30, HIGH).when(pct_unrounded > 20, MEDIUM).otherwise(LOW)


def liquidity_status(ratio: Column, t: Thresholds) -> Column:
    """C5 status: Baixa below the minimum, Alta above the maximum, else Normal."""
    return (F.when(ratio < t.liquidity_ratio_min, LIQ_LOW)
            .when(ratio > t.liquidity_ratio_max, LIQ_HIGH)
            .otherwise(LIQ_NORMAL))


def liquidity_severity(ratio: Column, t: Thresholds) -> Column:
    """C5 severity: critical below the hard 0.5 floor, warning outside the band."""
    return (F.when(ratio < t.liquidity_ratio_min,
                   F.when(ratio < t.liquidity_critical, CRITICAL).otherwise(WARNING))
            .when(ratio > t.liquidity_ratio_max, WARNING)
            .otherwise(INFO))


def liquidity_risk(ratio: Column) -> Column:
    """C6 (KPI liquidity): < 0.5 Alto, < 0.8 Médio, else Baixo (unrounded ratio)."""
    return F.when(ratio < 0.5, HIGH).when(ratio < 0.8, MEDIUM).otherwise(LOW)


def concentration_risk(top_pct: Column) -> Column:
    """C6 (KPI concentration): top fund > 50 Alto, > 30 Médio, else Baixo."""
    return F.when(top_pct > 50, HIGH).when(top_pct > 30, MEDIUM).otherwise(LOW)


def operational_health(ops_per_day: Column, efficiency: Column) -> Column:
    """C7 on unrounded values."""
    return (F.when((ops_per_day > 10) & (efficiency > 0.8), GOOD)
            .when(ops_per_day > 5, REGULAR).otherwise(POOR))


def trend(total_variation: Column) -> Column:
    """Zero counts as Negativa."""
    return F.when(total_variation > 0, POSITIVE).otherwise(NEGATIVE)
