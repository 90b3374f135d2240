"""Metric formulas, pack queries that fail while they run, raw values the contract cannot keep, display pages."""

import datetime as dt
import decimal
import os

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as E
from conftest import MICRO_PARAMS, SF_MID
from fundflow.functions.money import to_output
from fundflow.operators import extract as X, evolution, filters, flows, lag
from fundflow.plans import formulas, rules
from fundflow.plans.presentation import _orders, page
from fundflow.session import scratch_path
from fundflow.sources import contract


# ------------------------------------------------------------------ X2 formulas
def value_of(micro_lf, formula, fund="Alfa"):
    got = rules.pack_metrics(micro_lf, {"m": {"calculation": formula}})
    return got.filter(F.col("nmfundo").eqNullSafe(F.lit(fund))).first()["m"]


@pytest.mark.parametrize("formula, value", [
    ("total_entries / total_exits", 150 / 250),
    ("total_entries / (total_exits - 250) + 1", None),  # no value, wherever the division stands
    ("1 + 2 * (3 - 1) / 4", 2.0),
    ("-(total_entries - ABS(total_exits))", 100.0),
    ("ABS(total_entries / 0)", None),
    ("COALESCE(total_entries / 0, 7)", 7.0),
    ("MAX(daily_exits / daily_entries)", 5.0),
    ("MAX(daily_volume) / AVG(daily_volume)", 300 / 200),
    ("stddev(daily_balance_change)", 150.0),
    ("COUNT(*) + count(daily_volume)", 4.0),
    ("ROUND(total_entries / 7, 2)", 21.43),
    ("SQRT(0 - total_entries)", None),
    ("GREATEST(total_entries, total_exits, 3) - LEAST(1, 2)", 249.0),
    ("SUM(daily_entries - daily_exits)", -100.0),
    ("operation_count / NULLIF(active_days, 2)", None),
])
def test_formula_values(micro_lf, formula, value):
    got = value_of(micro_lf, formula)
    assert got == value if value is None else got == pytest.approx(value, abs=1e-12)


def test_formula_without_exits_is_null(micro_lf):
    assert value_of(micro_lf, "total_entries / total_exits + 1", fund=None) is None


@pytest.mark.parametrize("formula, words", [
    ("total_entires / 2", "unknown name total_entires"),
    ("MEDIAN(daily_volume)", "unknown function MEDIAN"),
    ("daily_volume + 1", "must stand inside an aggregate"),
    ("SUM(total_entries)", "cannot stand inside SUM()"),
    ("SUM(MAX(daily_volume))", "MAX() inside SUM()"),
    ("total_entries ** 2", "is not a number, a name"),
    ("total_entries /", "not an arithmetic expression"),
    ("'text'", "is not a number, a name"),
    ("ABS(1, 2)", "cannot take 2 arguments"),
    ("__import__('os')", "unknown function __import__"),
    ("SUM(daily_volume, 1)", "takes one argument"),
])
def test_formula_errors_name_the_fault(formula, words):
    with pytest.raises(formulas.FormulaError) as caught:
        formulas.metric(formula)
    assert words in str(caught.value) and formula in str(caught.value)


# ------------------------------------------------------------------ X1 isolation
def test_failing_queries_leave_the_others_written(spark, micro):
    queries = {
        "first": "SELECT COUNT(*) AS n FROM {ledger} WHERE to_date(dt_lancamento) BETWEEN ? AND ?",
        "cast": "SELECT CAST(lancamento AS INT) AS x FROM {ledger} WHERE to_date(dt_lancamento) BETWEEN ? AND ?",
        "divide": "SELECT 1 / (id_origem - id_origem) AS x FROM {ledger} WHERE to_date(dt_lancamento) BETWEEN ? AND ?",
        "parse": "SELEC nothing",
        "last one/of them": "SELECT nmfundo FROM {ledger} WHERE to_date(dt_lancamento) BETWEEN ? AND ?",
    }
    folder = scratch_path(spark, "isolated")
    done = rules.execute_custom_analysis(spark, micro, queries, MICRO_PARAMS, folder)
    status = {r["name"]: r for r in done.status.collect()}
    assert [r["name"] for r in done.status.collect()] == list(queries)
    assert {n: (r["status"], r["n_rows"]) for n, r in status.items()} == {
        "first": ("ok", 1), "cast": ("failed", None), "divide": ("failed", None), "parse": ("failed", None),
        "last one/of them": ("ok", 7)}
    assert status["cast"]["condition"] == "CAST_INVALID_INPUT" and "lancamento" in done.errors["cast"]
    assert status["divide"]["condition"] == "DIVIDE_BY_ZERO"
    assert set(done.frames) == {"first", "last one/of them"} and done.frames["first"].first()["n"] == 7
    assert all(os.path.dirname(status[n]["path"]) == folder for n in done.frames)
    again = rules.execute_custom_analysis(spark, micro, queries, MICRO_PARAMS, folder, at_once=1)
    assert again.frames["last one/of them"].count() == 7


# ------------------------------------------------------------------ S1 rescue
RAW = "id_origem string, fonte string, id_carteira string, nmfundo string, cnpj string, dt_lancamento string, " \
      "entrada {0}, saida {0}, saldo {0}, lancamento string"


@pytest.mark.parametrize("kind, big, fine", [("double", 1e18, 1.239), ("string", "1e18", "1.239"),
                                             ("decimal(30,6)", decimal.Decimal("1e18"), decimal.Decimal("1.239"))])
def test_bad_values_are_kept_and_counted(spark, kind, big, fine):
    """They never abort a read, stay as raw text, and are counted by the read itself."""
    rows = [("1", "c", "7", "F", "1", "2024-01-02 10:00:00", big, None, None, "a"),
            ("two", "c", "x", "F", "1", "2024-01-02 11:00:00", fine, None, fine, "b"),
            ("3", "c", "9", "F", "1", "yesterday", None, None, None, "c"),
            ("4", "c", "9", "F", "1", "2024-01-03 10:00:00", None, None, None, "d")]
    raw = spark.createDataFrame(rows, RAW.format(kind))
    ledger, seen = contract.normalise_observed(raw)
    got = {r["lancamento"]: r for r in ledger.collect()}
    assert got["a"]["entrada"] is None and float(got["a"]["_rescued"]["entrada"]) == 1e18
    assert got["b"]["entrada"] == decimal.Decimal("1.24") and float(got["b"]["_rescued"]["saldo"]) == 1.239
    assert got["b"]["id_origem"] is None and got["b"]["_rescued"]["id_origem"] == "two"
    assert got["c"]["_rescued"] == {"dt_lancamento": "yesterday"} and got["d"]["_rescued"] is None
    counts = seen.get
    assert counts["rows"] == 4 and {k: v for k, v in counts.items() if v and k != "rows"} == {
        "rescued_id_origem": 1, "rescued_id_carteira": 1, "rescued_dt_lancamento": 1, "rescued_entrada": 2,
        "rescued_saldo": 1}
    assert contract.rescued_values(ledger).count() == 6
    plain = contract.normalise(raw)
    assert plain.columns == list(contract.LEDGER_COLUMNS) and plain.count() == 4
    p = E.FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert to_output(flows.daily_metrics(filters.apply_filters(plain, p))).count() == 2


def test_nan_and_infinite_money(spark):
    raw = spark.createDataFrame([("1", "c", "7", "F", "1", "2024-01-02 10:00:00", float("nan"), float("inf"), 0.1, "a")],
                                RAW.format("double"))
    r = contract.normalise(raw, rescue=True).first()
    assert (r["entrada"], r["saida"], r["saldo"]) == (None, None, decimal.Decimal("0.10"))
    assert r["_rescued"] == {"entrada": "NaN", "saida": "Infinity"}


def test_clean_typed_sources_rescue_nothing(micro):
    assert contract.normalise(micro, rescue=True).filter("_rescued is not null").count() == 0


def test_source_zone(spark):
    """An instant is booked by the wall clock of its zone, whatever the session's."""
    raw = spark.sql("select 1L as id_origem, 'c' as fonte, 1L as id_carteira, 'F' as nmfundo, '' as cnpj, "
                    "timestamp'2024-03-01 01:30:00Z' as dt_lancamento, 1.0D as entrada, 0.0D as saida, 0.0D as saldo, "
                    "'' as lancamento")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            led = contract.normalise(raw, source_zone="America/Sao_Paulo")
            assert led.first()["dt_lancamento"] == dt.datetime(2024, 2, 29, 22, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ------------------------------------------------------------------ O2, O5 orders
def results(x):
    return {"extract": X.extract(x), "liquidity_metrics": flows.liquidity_metrics(x),
            "daily_metrics": flows.daily_metrics(x), "daily_trends": flows.daily_metrics(x),
            "concentration": flows.concentration(x), "operation_summary": flows.operation_summary(x),
            "balance_evolution": lag.balance_evolution(x), "balance_pct_change": evolution.balance_pct_change(x)}


@pytest.mark.parametrize("name", ["extract", "liquidity_metrics", "daily_metrics", "daily_trends", "concentration",
                                  "operation_summary", "balance_evolution", "balance_pct_change"])
def test_display_orders_are_total(spark, name):
    """No two rows of a result tie, so pages neither repeat nor lose rows."""
    x = filters.apply_filters(E.ledger_for(spark, SF_MID, "events"), E.full("events"))
    assert set(results(x)) == set(_orders())
    df = results(x)[name]
    keys = _orders()[name]
    tagged = df.withColumn("_k", F.rank().over(Window.orderBy(*keys)))
    assert tagged.count() == tagged.select("_k").distinct().count()
    size = 7
    pages = [tuple(map(str, page(name, df, size, k).collect())) for k in (1, 2)]
    assert not set(pages[0]) & set(pages[1])
