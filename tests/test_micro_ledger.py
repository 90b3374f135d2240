"""Hand-checked expected values on the eight-line micro-ledger (FIXTURES.md section 3)."""

import math

import pytest

from conftest import MICRO_AS_OF, MICRO_PARAMS
from fundflow.functions.money import to_output
from fundflow.operators import alerts as L, breakdowns, evolution, lag, extract as X, flows, kpis as K
from fundflow.operators import status
from fundflow.plans import bundles


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def by_key(df, key_cols, val_cols):
    return {tuple(r[c] for c in key_cols): tuple(r[c] for c in val_cols) for r in df.collect()}


def test_period_filter_is_inclusive_and_drops_february(micro_lf):
    ids = sorted(r.id_origem for r in micro_lf.select("id_origem").collect())
    assert ids == [1, 2, 3, 4, 5, 6, 7]


def test_a1_liquidity_metrics(micro_lf):
    got = by_key(to_output(flows.liquidity_metrics(micro_lf)), ("nmfundo", "fonte"),
                 ("total_entries", "total_exits", "net_flow", "operation_count", "active_days",
                  "avg_daily_flow", "flow_volatility", "max_daily_flow", "min_balance",
                  "max_balance"))
    assert got == {
        ("Beta", "btg"): (400, 100, 300, 2, 2, 150, 150, 300, 300, 300),
        ("Alfa", "btg"): (100, 250, -150, 2, 2, -75, 175, 250, -150, 100),
        ("Alfa", "daycoval"): (50, 0, 50, 1, 1, 50, 0, 50, -100, -100),
        (None, "btg"): (40, 0, 40, 1, 1, 40, 0, 40, 40, 40),
    }  # Beta/master has zero volume and is dropped (F8)


def test_c5_status_and_w4(micro_lf):
    st = status.liquidity_status(flows.liquidity_metrics(micro_lf))
    got = by_key(st, ("nmfundo", "fonte"), ("liquidity_ratio", "status", "severity"))
    assert got[("Alfa", "btg")] == (0.4, "Baixa", "critical")
    assert got[("Alfa", "daycoval")] == (math.inf, "Alta", "warning")
    assert got[("Beta", "btg")] == (4.0, "Alta", "warning")
    assert got[(None, "btg")] == (math.inf, "Alta", "warning")
    w4 = by_key(status.liquidity_status_by_fund(st), ("nmfundo",), ("fonte",))
    assert w4[("Alfa",)] == ("daycoval",)


def test_a3_concentration(micro_lf):
    got = by_key(flows.concentration(micro_lf), ("nmfundo", "fonte"),
                 ("concentration_pct", "concentration_level"))
    assert got == {("Beta", "btg"): (53.19, "Alto"), ("Alfa", "btg"): (37.23, "Alto"),
                   ("Alfa", "daycoval"): (5.32, "Baixo"), (None, "btg"): (4.26, "Baixo")}


def test_w1_previous_balance(micro_lf):
    got = sorted(rows(to_output(lag.balance_evolution(micro_lf)),
                      "nmfundo", "fonte", "date", "balance", "previous_balance"),
                 key=lambda r: (str(r[0]), r[2], r[1]))
    prev = {(r[0], r[1], str(r[2])): r[4] for r in got}
    assert prev[("Alfa", "btg", "2024-01-01")] is None
    assert prev[("Alfa", "btg", "2024-01-02")] == 100
    assert prev[("Alfa", "daycoval", "2024-01-02")] == -150
    assert prev[("Beta", "btg", "2024-01-01")] is None
    assert prev[("Beta", "btg", "2024-01-03")] == 300
    assert prev[("Beta", "master", "2024-01-05")] == 300
    assert prev[(None, "btg", "2024-01-04")] is None


@pytest.mark.parametrize("partitions", [2, 3, 8, 40])
def test_w1_same_answer_for_any_number_of_ranges(micro_lf, partitions):
    ref = sorted(rows(lag.balance_evolution(micro_lf, 1),
                      "date", "fonte", "balance", "previous_balance"), key=str)
    got = sorted(rows(lag.balance_evolution(micro_lf, partitions),
                      "date", "fonte", "balance", "previous_balance"), key=str)
    assert got == ref


def test_a5_operation_summary(micro_lf):
    got = by_key(to_output(flows.operation_summary(micro_lf)), ("categoria",),
                 ("total_operations", "total_entries", "total_exits", "net_amount",
                  "affected_funds", "avg_operation_size"))
    assert got == {("Rendimento",): (1, 300, 0, 300, 1, 300), ("Taxa",): (2, 50, 250, -200, 1, 150),
                   ("Aplicação",): (1, 100, 0, 100, 1, 100), ("Venda",): (1, 40, 0, 40, 0, 40),
                   ("Outros",): (2, 100, 100, 0, 1, 0)}


def test_w2_w3_running_flow_and_pct(micro_lf):
    evo = evolution.balance_pct_change(micro_lf)
    got = {(r.nmfundo, r.fonte, str(r.date)): (None if r.cumulative_flow is None
                                               else float(r.cumulative_flow), round(r.pct_change, 4))
           for r in evo.collect()}
    assert got[("Alfa", "btg", "2024-01-01")] == (100, 0)
    assert got[("Alfa", "btg", "2024-01-02")] == (-150, -250)
    assert got[("Alfa", "daycoval", "2024-01-02")] == (-100, -33.3333)
    assert got[("Beta", "btg", "2024-01-01")] == (300, 0)
    assert got[("Beta", "btg", "2024-01-03")] == (300, 0)
    assert got[("Beta", "master", "2024-01-05")] == (300, 0)
    assert got[(None, "btg", "2024-01-04")] == (None, 0)


def test_a21_evolution_metrics(micro_lf):
    got = by_key(evolution.evolution_metrics(evolution.balance_pct_change(micro_lf)),
                 ("nmfundo",), ("total_variation", "volatility", "periods", "trend", "severity"))
    alfa = got[("Alfa",)]
    assert round(alfa[0], 4) == -283.3333 and round(alfa[1], 5) == 135.74213
    assert alfa[2:] == (3, "Negativa", "warning")
    assert got[("Beta",)] == (0.0, 0.0, 3, "Negativa", "info")
    assert (None,) not in got


def test_kpis(micro_lf):
    k = K.kpis(micro_lf, MICRO_PARAMS, MICRO_AS_OF).collect()[0].asDict()
    assert (k["total_entries"], k["total_exits"], k["net_flow"], k["total_volume"]) == (590, 350, 240, 940)
    assert (k["operation_count"], k["active_funds"], k["period_days"]) == (7, 2, 30)
    assert (k["liquidity_ratio"], k["liquidity_risk_level"]) == (-1.0, "Alto")
    assert (k["min_balance"], k["avg_balance"], k["critical_funds_count"]) == (-150, 75, 2)
    assert (k["concentration_index"], k["top_fund_percentage"]) == (50.62, 55.56)
    assert (k["top_3_funds_percentage"], k["concentration_risk_level"]) == (100, "Alto")
    assert (k["daily_avg_operations"], k["operational_efficiency"]) == (0.23, 1.6857)
    assert (k["flow_volatility"], k["operational_health"]) == (217.99, "Baixa")
    assert round(k["data_quality_score"], 6) == 84.957983


def test_kpis_empty_defaults(micro):
    from fundflow.operators.filters import apply_filters
    from fundflow.params import FilterParams
    import datetime as dt
    p = FilterParams(dt.date(2020, 1, 1), dt.date(2020, 1, 31))
    k = K.kpis(apply_filters(micro, p), p, MICRO_AS_OF).collect()[0].asDict()
    assert k["operation_count"] == 0 and k["data_quality_score"] == 0
    assert k["liquidity_risk_level"] == "Desconhecido"
    assert k["concentration_risk_level"] == "Desconhecido"
    assert k["operational_health"] == "Desconhecida"
    assert k["period_days"] is None and k["min_balance"] is None
    alerts = [r.alert for r in L.kpi_alerts(K.kpis(apply_filters(micro, p), p, MICRO_AS_OF)).collect()]
    assert alerts == ["data_quality"]


def test_a14_future_penalty(micro_lf):
    import datetime as dt
    k = K.kpis(micro_lf, MICRO_PARAMS, dt.date(2024, 1, 3)).collect()[0]
    assert round(k.data_quality_score, 6) == round(84.957983 - 20, 6)


def test_kpi_alerts(micro_lf):
    k = K.kpis(micro_lf, MICRO_PARAMS, MICRO_AS_OF)
    got = [r.alert for r in L.kpi_alerts(k).orderBy("rule_order").collect()]
    assert got == ["liquidity_risk", "concentration_risk", "operational_health"]


def test_a16_extract_metrics(micro_lf):
    en = X.enriched_extract(micro_lf)
    m = to_output(breakdowns.extract_metrics(en)).collect()[0]
    assert (m.creditos, m.n_creditos, m.debitos, m.n_debitos, m.saldo_final, m.n_total) == \
        (490, 5, 250, 1, 240, 7)
    disp = breakdowns.extract_metrics_display(breakdowns.extract_metrics(en)).collect()[0]
    assert (disp.creditos, disp.debitos, disp.saldo_final) == ("R$ 490,00", "R$ 250,00", "R$ 240,00")


def test_s3_enrichment(micro_lf):
    got = by_key(X.enriched_extract(micro_lf), ("id_origem",),
                 ("tipo_lancamento", "categoria", "mes_ano", "ano", "mes"))
    cat = {k[0]: v[1] for k, v in got.items()}
    kind = {k[0]: v[0] for k, v in got.items()}
    assert cat == {1: "Aplicação", 2: "Taxa", 3: "Taxa", 4: "Rendimento", 5: "Transferência",
                   6: "Outros", 7: "Venda"}
    assert kind == {1: "Crédito", 2: "Débito", 3: "Crédito", 4: "Crédito", 5: "Crédito",
                    6: "Neutro", 7: "Crédito"}
    assert got[(1,)][2:] == ("2024-01", 2024, 1)


def test_alert_messages(micro_lf):
    st = status.liquidity_status_by_fund(status.liquidity_status(flows.liquidity_metrics(micro_lf)))
    msgs = {r.fund: r.message for r in L.liquidity_alerts(st, MICRO_AS_OF).collect()}
    assert msgs == {"Alfa": "Fundo Alfa com liquidez alta: inf",
                    "Beta": "Fundo Beta com liquidez alta: 4.00",
                    None: "Fundo None com liquidez alta: inf"}
    cm = status.concentration_metrics(flows.concentration(micro_lf))
    msgs = {r.fund: (r.severity, r.message) for r in L.concentration_alerts(cm, MICRO_AS_OF).collect()}
    assert msgs == {"Beta": ("critical", "Alta concentração no fundo Beta: 53.2%"),
                    "Alfa": ("critical", "Alta concentração no fundo Alfa: 37.2%")}
    ev = evolution.evolution_metrics(evolution.balance_pct_change(micro_lf))
    msgs = [r.message for r in L.evolution_alerts(ev, MICRO_AS_OF).collect()]
    assert msgs == ["Grande variação no saldo do fundo Alfa: -283.3%"]


def test_bundles_and_summary(micro_lf):
    liq = bundles.analyze_liquidity(micro_lf, MICRO_AS_OF)
    s = liq.summary.collect()[0]
    assert s.success and s.summary == "Análise de 3 fundos: 0 críticos, 3 com alertas"
    conc = bundles.analyze_concentration(micro_lf, MICRO_AS_OF).summary.collect()[0]
    assert conc.summary == "Concentração máxima: 53.2% - 2 alertas gerados"
    evo = bundles.analyze_balance_evolution(micro_lf, MICRO_AS_OF).summary.collect()[0]
    assert evo.summary == "Evolução de 2 fundos analisada - 1 alertas de variação"
    assert liq.has_issues().collect()[0].has_issues is True


def test_bundle_without_data(micro):
    import datetime as dt
    from fundflow.operators.filters import apply_filters
    from fundflow.params import FilterParams
    p = FilterParams(dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    s = bundles.analyze_liquidity(apply_filters(micro, p), MICRO_AS_OF).summary.collect()[0]
    assert (s.success, s.message, s.summary) == (False, "Sem dados para análise", None)
