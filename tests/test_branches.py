"""Threshold branches reached on the sf0.01 test tables (FIXTURES.md section 4)
"""

import datetime as dt
import math

import pytest

import __spark_entry__ as E
from conftest import SF_MID
from fundflow.functions.money import to_output
from fundflow.operators import evolution, filters, flows, kpis as K, lag, status
from fundflow.params import FilterParams
from fundflow.plans import rules
from fundflow.sources.adapters import events_ledger, orders_ledger
from pyspark.sql import functions as F

LAST45 = FilterParams(dt.date(2001, 6, 17), dt.date(2001, 8, 1))
AS_OF = dt.date(2001, 8, 1)


@pytest.fixture(scope="module")
def orders(spark):
    return orders_ledger(spark, SF_MID)


@pytest.fixture(scope="module")
def events(spark):
    return events_ledger(spark, SF_MID)


def lf(ledger, p):
    return filters.apply_filters(ledger, p)


def c5_counts(df):
    out = {"critical": 0, "baixa_warning": 0, "normal": 0, "alta": 0, "inf": 0}
    for r in df.collect():
        if r.severity == "critical":
            out["critical"] += 1
        elif r.status == "Baixa":
            out["baixa_warning"] += 1
        elif r.status == "Normal":
            out["normal"] += 1
        elif math.isinf(r.liquidity_ratio):
            out["inf"] += 1
        else:
            out["alta"] += 1
    return out


def test_c5_branches_last_45_days(orders):
    got = c5_counts(status.liquidity_status(flows.liquidity_metrics(lf(orders, LAST45))))
    assert got == {"critical": 35, "baixa_warning": 5, "normal": 13, "alta": 12, "inf": 40}


def test_c5_branches_2001(orders):
    p = FilterParams(dt.date(2001, 1, 1), AS_OF)
    got = c5_counts(status.liquidity_status(flows.liquidity_metrics(lf(orders, p))))
    assert got == {"critical": 11, "baixa_warning": 20, "normal": 36, "alta": 53, "inf": 5}


def test_a3_medio_branch(orders):
    p = FilterParams(dt.date(1995, 1, 1), AS_OF, ("NATION_0", "NATION_1"), ("BUILDING", "MACHINERY"))
    got = sorted((r.concentration_pct, r.concentration_level)
                 for r in flows.concentration(lf(orders, p)).collect())
    assert got == [(16.47, "Baixo"), (26.52, "Médio"), (28.34, "Médio"), (28.67, "Médio")]


@pytest.mark.parametrize("funds,index,top1,risk", [
    (("NATION_1",), 100.0, 100.0, "Alto"),
    (("NATION_1", "NATION_10", "NATION_2"), 33.66, 35.84, "Médio"),
    (None, None, 4.91, "Baixo"),
])
def test_a12_branches(orders, funds, index, top1, risk):
    p = FilterParams(dt.date(1995, 1, 1), AS_OF, funds)
    k = K.kpis(lf(orders, p), p, AS_OF).collect()[0]
    if index is not None:
        assert k.concentration_index == index
    assert (k.top_fund_percentage, k.concentration_risk_level) == (top1, risk)


@pytest.mark.parametrize("p,ratio,risk", [
    (FilterParams(dt.date(2001, 7, 30), AS_OF, ("NATION_5",)), 0.5415, "Médio"),
    (FilterParams(dt.date(2001, 7, 31), AS_OF), 0.9171, "Baixo"),
    (LAST45, 0.108, "Alto"),
])
def test_a11_branches(orders, p, ratio, risk):
    k = K.kpis(lf(orders, p), p, AS_OF).collect()[0]
    assert (k.liquidity_ratio, k.liquidity_risk_level) == (ratio, risk)


def test_c7_branches(orders, events):
    k = K.kpis(lf(orders, LAST45), LAST45, AS_OF).collect()[0]
    assert (k.operation_count, k.operational_health) == (290, "Regular")
    p = FilterParams(dt.date(2001, 7, 25), AS_OF, ("NATION_1", "NATION_10", "NATION_2", "NATION_3"))
    k = K.kpis(lf(orders, p), p, AS_OF).collect()[0]
    assert (k.operation_count, k.operational_health) == (13, "Baixa")
    pe = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    k = K.kpis(lf(events, pe), pe, dt.date(2024, 1, 31)).collect()[0]
    assert k.operational_health == "Boa" and k.operational_efficiency == 1.0016


def test_a14_negative_balance_penalty(orders, events):
    pe = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    ke = K.kpis(lf(events, pe), pe, dt.date(2024, 1, 31)).collect()[0]
    pa = FilterParams(dt.date(1995, 1, 1), AS_OF)
    ka = K.kpis(lf(orders, pa), pa, AS_OF).collect()[0]
    # events: 32.6% negative balances -> -10; orders: 8.3% -> no penalty
    nulls_e = 100 - ke.data_quality_score - 10
    nulls_a = 100 - ka.data_quality_score
    assert 0 < nulls_e < 10 and 0 < nulls_a < 10


def test_a21_and_l3_branches(orders):
    m = evolution.evolution_metrics(evolution.balance_pct_change(lf(orders, LAST45))).collect()
    trends = sorted(r.trend for r in m)
    assert trends.count("Positiva") == 14 and trends.count("Negativa") == 11
    big = [r for r in m if abs(r.total_variation) > 20]
    assert len(big) == 23 and len(m) - len(big) == 2


def test_l5_branches(spark, orders):
    led = orders
    x = lf(led, LAST45)
    m = rules.rule_metrics(x).collect()
    r = [row.liquidity_ratio for row in m]
    assert sum(v < 0.5 for v in r) == 3 and sum(0.5 <= v < 0.8 for v in r) == 6
    assert sum(v > 2.0 for v in r) == 10
    assert round(max(row.volume_concentration for row in m), 1) == 3.6
    pa = FilterParams(dt.date(1995, 1, 1), AS_OF)
    full_m = rules.rule_metrics(lf(led, pa)).collect()
    vc = [row.volume_concentration for row in full_m]
    assert sum(v > 5 for v in vc) == 6 and round(max(vc), 1) == 6.4


# ------------------------------------------------------------------ invariants

def test_invariants(orders):
    p = FilterParams(dt.date(1995, 1, 1), AS_OF)
    x = lf(orders, p)
    a1 = flows.liquidity_metrics(x).agg(F.sum("net_flow")).collect()[0][0]
    a2 = flows.daily_metrics(x).agg(F.sum("daily_net_flow")).collect()[0][0]
    assert a1 == a2
    pct = flows.concentration(x).agg(F.sum("concentration_pct")).collect()[0][0]
    assert abs(pct - 100) < 0.05
    evo = evolution.balance_pct_change(x)
    last = evo.groupBy("nmfundo").agg(F.max_by("cumulative_flow", F.struct("date", "fonte")).alias("c"))
    net = flows.daily_metrics(x).groupBy("nmfundo").agg(F.sum("daily_net_flow").alias("n"))
    assert last.join(net, "nmfundo").filter(F.col("c") != F.col("n")).count() == 0
    k = K.kpis(x, p, AS_OF).collect()[0]
    assert 100 / k.active_funds <= k.concentration_index + 0.01 <= 100.01
    from fundflow.operators import breakdowns, extract as X
    m = to_output(breakdowns.extract_metrics(X.enriched_extract(x))).collect()[0]
    assert m.n_creditos + m.n_debitos <= m.n_total


def test_w1_matches_plain_window(orders):
    """W1 by ranges equals the single-window definition."""
    from pyspark.sql import Window
    x = lf(orders, FilterParams(dt.date(1995, 1, 1), AS_OF))
    bal = F.coalesce("saldo", F.lit(0).cast("decimal(18,2)"))
    plain = x.select("nmfundo", "fonte", F.to_date("dt_lancamento").alias("date"),
                     bal.alias("balance"),
                     F.lag(bal).over(Window.partitionBy("nmfundo")
                                     .orderBy("dt_lancamento", "id_origem")).alias("previous_balance"))
    ours = lag.balance_evolution(x).select("nmfundo", "fonte", "date", "balance", "previous_balance")
    assert plain.exceptAll(ours).count() == 0 and ours.exceptAll(plain).count() == 0


def test_registered_scenarios_cover_branches():
    names = set(E.queries())
    for n in ("liquidity_status_45d", "concentration_metrics_alto", "kpis_one_fund",
              "kpis_future_events", "kpis_empty", "rule_alerts_45d"):
        assert n in names


def test_w1_spreads_a_hot_fund(spark):
    """One fund holding a third of the lines is not sorted in a single task."""
    from pyspark.sql import Window
    led = events_ledger(spark, SF_MID)
    # derived from the events table: every third user books into one fund
    hot = led.withColumn("nmfundo", F.when(F.col("id_carteira") % 3 == 0, F.lit("HOT"))
                         .otherwise(F.col("nmfundo")))
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    x = lf(hot, p)
    share = x.filter(F.col("nmfundo") == "HOT").count() / x.count()
    assert 0.25 < share < 0.45
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ours = lag.balance_evolution(x)
        # ranges hold as many lines each, whosever they are
        per_task = (ours.withColumn("pid", F.spark_partition_id()).groupBy("pid").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("nmfundo") == "HOT").alias("hot")).collect())
        sizes = sorted(r.n for r in per_task)
        assert len(sizes) >= 6 and sizes[-1] < 0.35 * sum(sizes)  # of 8 shuffle partitions
        assert sum(r.hot > 0 for r in per_task) >= 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    bal = F.coalesce("saldo", F.lit(0).cast("decimal(18,2)"))
    plain = x.select("nmfundo", "fonte", F.to_date("dt_lancamento").alias("date"),
                     bal.alias("balance"),
                     F.lag(bal).over(Window.partitionBy("nmfundo")
                                     .orderBy("dt_lancamento", "id_origem")).alias("previous_balance"))
    ours = ours.select("nmfundo", "fonte", "date", "balance", "previous_balance")
    assert plain.exceptAll(ours).count() == 0 and ours.exceptAll(plain).count() == 0


def test_w1_spreads_one_posting_time(spark):
    """One fund, one (date-only) posting time, repeated and null ids among them: many tasks, same lags."""
    from pyspark.sql import Window
    led = spark.range(10_000).selectExpr(
        "case when id = 77 then null else id - 5000 end as id_origem", "'c' as fonte", "1L as id_carteira",
        "'F' as nmfundo", "'' as cnpj", "timestamp_ntz'2024-01-01 00:00:00' as dt_lancamento",
        "cast(1 as decimal(18,2)) as entrada", "cast(0 as decimal(18,2)) as saida",
        "cast(id as decimal(18,2)) as saldo", "'' as lancamento")
    ours = lag.balance_evolution(led)
    plain = led.select("saldo", F.lag("saldo").over(
        Window.partitionBy("nmfundo").orderBy("dt_lancamento", "id_origem")).alias("previous_balance"))
    got = ours.select("balance", "previous_balance")
    assert plain.exceptAll(got).count() == 0 and got.exceptAll(plain).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = (ours.filter("previous_balance >= 0").withColumn("pid", F.spark_partition_id())
                 .groupBy("pid").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in tasks) < 3000
    assert "SortAggregate" not in ours._jdf.queryExecution().executedPlan().toString()


def plain_lag(led):
    from pyspark.sql import Window
    order = Window.partitionBy("nmfundo").orderBy("dt_lancamento", "id_origem")
    return led.select("nmfundo", "dt_lancamento", "id_origem", F.col("saldo").alias("balance"),
                      F.lag("saldo").over(order).alias("previous_balance"))


@pytest.mark.parametrize("step", [1, 1 << 30])
def test_w1_spreads_sparse_ids(spark, step):
    """One midnight holds all lines of a fund, their ids dense or far apart: even ranges, the plain window's lags."""
    led = spark.range(20_000).selectExpr(
        f"id * {step} as id_origem", "'c' as fonte", "1L as id_carteira",
        "case when id % 3 = 0 then null when id < 15000 then 'F' else 'G' end as nmfundo", "'' as cnpj",
        "timestamp_ntz'2024-01-01 00:00:00' as dt_lancamento", "cast(1 as decimal(18,2)) as entrada",
        "cast(0 as decimal(18,2)) as saida", "cast(id as decimal(18,2)) as saldo", "'' as lancamento")
    ours = lag.balance_evolution(led, 16).select(plain_lag(led).columns)
    assert plain_lag(led).exceptAll(ours).count() == 0 and ours.exceptAll(plain_lag(led)).count() == 0
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4k")  # a task for each file the scan wrote
        sizes = [r["count"] for r in ours.select("*").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(name, before)
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_w1_is_stable_once_stored(spark, orders):
    """The same frame gives the same rows when it is read again, split differently."""
    ours = lag.balance_evolution(lf(orders, FilterParams(dt.date(1995, 1, 1), AS_OF)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    first = sorted(map(str, ours.collect()))
    try:
        spark.conf.set(name, "16k")
        assert sorted(map(str, ours.select("*").collect())) == first
    finally:
        spark.conf.set(name, before)


def test_w1_of_nothing(spark, orders):
    assert lag.balance_evolution(orders.filter("false")).collect() == []
