"""Sources, sinks, filters, formatting, rule packs, custom SQL and streaming."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import MICRO_AS_OF, MICRO_PARAMS
from fundflow.functions import formatting as fmt
from fundflow.functions.money import to_output
from fundflow.operators import alerts, evolution, filters, flows
from fundflow.params import FilterParams, preset_range
from fundflow.plans import rules
from fundflow.session import scratch_path
from fundflow.sources import contract, readers, sinks


# ------------------------------------------------------------------ sources / contract

def test_normalise_text_money_and_dates(spark):
    raw = spark.createDataFrame(
        [("1", "btg", "10", "Alfa", "11", "2024-01-02 10:00:00", "12.5", "abc", "NaN", "x"),
         ("2", None, None, None, None, "2024-01-03 00:00:00", None, "1e40", "-3", None)],
        "id string, fonte string, id_carteira string, nmfundo string, cnpj string, "
        "ts string, entrada string, saida string, saldo string, lancamento string")
    led = contract.normalise(raw, rename={"id": "id_origem", "ts": "dt_lancamento"})
    assert led.schema == contract.LEDGER_SCHEMA or \
        [f.dataType for f in led.schema] == [f.dataType for f in contract.LEDGER_SCHEMA]
    r = led.orderBy("id_origem").collect()
    assert r[0].entrada == 12.5 and r[0].saida is None  # junk text -> NULL (read as 0)
    assert r[1].saida is None and r[1].saldo == -3       # overflow -> NULL
    assert r[0].dt_lancamento == dt.datetime(2024, 1, 2, 10, 0)


def test_normalise_missing_column(spark):
    with pytest.raises(ValueError):
        contract.normalise(spark.createDataFrame([(1,)], "id_origem long"))


def test_contract_violations(micro):
    v = contract.contract_violations(micro).collect()[0]
    assert (v.rows, v.null_nmfundo, v.negative_saida, v.empty_nmfundo) == (8, 1, 0, 0)


def test_parquet_reader_and_sink_roundtrip(spark, micro):
    path = scratch_path(spark, "ledger")
    sinks.write_result(micro.withColumn("month", F.date_format("dt_lancamento", "yyyy-MM")), path,
                       partition_by=("month",))
    assert sorted(d for d in os.listdir(path) if d.startswith("month=")) == \
        ["month=2024-01", "month=2024-02"]
    back = readers.read_ledger(spark, path)
    assert back.count() == 8
    p = FilterParams(dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    lf = filters.apply_filters(back, p)
    assert [r.id_origem for r in lf.collect()] == [8]


def test_stored_ledger_prunes_partitions(spark, micro):
    path = scratch_path(spark, "ledger-store")
    sinks.write_ledger(micro, path, granularity="day", num_files=2)
    p = FilterParams(dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    led = readers.read_ledger(spark, path, period=(p.start_date, p.end_date))
    lf = filters.apply_filters(led, p)
    plan = spark._jvm.PythonSQLUtils.explainString(lf._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(dt_part" in plan
    assert sorted(r.id_origem for r in lf.collect()) == [2, 3, 5]
    assert sorted(r.id_origem for r in led.collect()) == [2, 3, 5]  # pruned to two days
    monthly = scratch_path(spark, "ledger-store-m")
    sinks.write_ledger(micro, monthly)
    led = readers.read_ledger(spark, monthly, period=(dt.date(2024, 2, 1), dt.date(2024, 2, 29)))
    assert [r.id_origem for r in led.collect()] == [8]


def test_materialise(spark, micro_lf):
    m = sinks.materialise(spark, flows.daily_metrics(micro_lf), "daily")
    assert m.count() == flows.daily_metrics(micro_lf).count()


# ------------------------------------------------------------------ filters

def test_long_fund_list_is_a_filter(micro):
    lf = filters.funds(micro, tuple(f"F{i}" for i in range(1005)) + ("Beta",))
    plan = lf._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert sorted(r.id_origem for r in lf.collect()) == [4, 5, 6]


def test_empty_list_means_no_filter(micro):
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31), funds=[], custodians=[])
    assert p.funds is None and filters.apply_filters(micro, p).count() == 7


def test_available_lists_and_search(spark, micro):
    extra = spark.createDataFrame([(9, "btg", 1, "", None, dt.datetime(2024, 1, 1), None, None,
                                    None, None), (10, "", 1, "Al%fa", None, dt.datetime(2024, 1, 1),
                                                  None, None, None, None)], micro.schema)
    led = micro.unionByName(extra)
    funds = [r.nmfundo for r in filters.available_funds(led).collect()]
    assert funds == ["Al%fa", "Alfa", "Beta", "Gama"]
    assert [r.fonte for r in filters.available_custodians(led).collect()] == \
        ["btg", "daycoval", "fidd", "master"]
    hits = [r.nmfundo for r in filters.fund_search(filters.available_funds(led), "L%F").collect()]
    assert hits == ["Al%fa"]  # literal, case-insensitive
    assert filters.available_funds(led, limit=2).count() == 2


def test_period_presets():
    as_of = dt.date(2024, 1, 31)
    assert preset_range(as_of, "Hoje") == (as_of, as_of)
    assert preset_range(as_of, "Últimos 7 dias") == (dt.date(2024, 1, 24), as_of)
    assert preset_range(as_of, "Últimos 45 dias") == (dt.date(2023, 12, 17), as_of)
    assert preset_range(as_of, "Personalizado", (dt.date(2024, 1, 5), dt.date(2024, 1, 9))) == \
        (dt.date(2024, 1, 5), dt.date(2024, 1, 9))


# ------------------------------------------------------------------ formatting

def test_brazilian_formats(spark):
    df = spark.createDataFrame([(1234567.5,), (None,), (-0.5,), (float("nan"),)], "x double")
    got = [(r.c, r.p) for r in df.select(fmt.currency_br(F.col("x")).alias("c"),
                                          fmt.percent_br(F.col("x")).alias("p")).collect()]
    assert got == [("R$ 1.234.567,50", "1234567,50%"), ("R$ 0,00", "0,00%"),
                   ("R$ -0,50", "-0,50%"), ("R$ 0,00", "0,00%")]
    d = spark.createDataFrame([(dt.date(2024, 1, 5),)], "d date").select(fmt.date_label(F.col("d")))
    assert d.collect()[0][0] == "05/01/2024"


def test_python_number_text(spark):
    df = spark.createDataFrame([(float("inf"),), (1234.5,), (None,)], "x double")
    got = [r[0] for r in df.select(fmt.py_number(F.col("x"), ",.2f")).collect()]
    assert got == ["inf", "1,234.50", "None"]


# ------------------------------------------------------------------ rule packs / custom SQL

def test_bind_template():
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31), ("A", "B"), ("x",))
    sql, args = rules.bind_template("SELECT 1 WHERE d BETWEEN ? AND ? {fund_filter} {custodian_filter}", p)
    assert sql.endswith("AND nmfundo IN (?, ?) AND fonte IN (?)")
    assert args == [dt.date(2024, 1, 1), dt.date(2024, 1, 31), "A", "B", "x"]


def test_custom_analysis_isolates_failures(spark, micro):
    qs = {"ok": "SELECT nmfundo, COUNT(*) AS n FROM {ledger} "
                "WHERE to_date(dt_lancamento) BETWEEN ? AND ? {fund_filter} GROUP BY nmfundo",
          "broken": "SELECT no_such_column FROM {ledger}"}
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31), ("Alfa",))
    res = rules.run_custom_analysis(spark, micro, qs, p)
    assert "broken" in res.errors and "ok" not in res.errors
    assert [(r.nmfundo, r.n) for r in res.frames["ok"].collect()] == [("Alfa", 3)]


def test_default_pack_queries(spark, micro):
    res = rules.run_custom_analysis(spark, micro, rules.DEFAULT_PACK["queries"], MICRO_PARAMS)
    assert not res.errors
    a6 = {r.nmfundo: r for r in res.frames["fund_liquidity_metrics"].collect()}
    assert (a6["Alfa"].total_entries, a6["Alfa"].total_exits, a6["Alfa"].operation_count) == (150, 250, 3)
    assert a6["Beta"].operation_count == 3 and a6[None].total_entries == 40
    a7 = res.frames["daily_metrics"].count()
    assert a7 == 6  # (date, fund) pairs in January


def test_load_rule_packs_from_yaml(tmp_path):
    (tmp_path / "liquidez.yaml").write_text(
        "name: t\nalert_rules:\n  - name: r\n    condition: liquidity_ratio > 1\n"
        "    severity: warning\n    message: 'Fundo {fund_name}: {liquidity_ratio:.2f}'\n",
        encoding="utf-8")
    (tmp_path / "ignored.txt").write_text("x")
    packs = rules.load_rule_packs(str(tmp_path))
    assert list(packs) == ["liquidez"] and packs["liquidez"]["alert_rules"][0]["name"] == "r"


def test_rule_alerts_and_messages(spark, micro, micro_lf):
    m = rules.rule_metrics(micro_lf)
    got = {(r.rule, r.fund): r.message for r in
           rules.rule_alerts(m, rules.DEFAULT_ALERT_RULES, MICRO_AS_OF).collect()}
    # Alfa 150/250 = 0.6 (Liquidez Baixa); Beta 400/100 = 4 (Excessiva); NULL fund: no exits
    assert got[("Liquidez Baixa", "Alfa")] == "Fundo Alfa com baixa liquidez: 0.60"
    assert got[("Liquidez Excessiva", "Beta")] == "Fundo Beta com liquidez excessiva: 4.00"
    assert not any(f is None for _, f in got)
    big = spark.createDataFrame([("X", 1.0, 1.0, 612345.678)],
                                "nmfundo string, liquidity_ratio double, volume_concentration double, "
                                "balance_volatility double")
    msg = rules.rule_alerts(big, rules.DEFAULT_ALERT_RULES, MICRO_AS_OF).collect()[0].message
    assert msg == "Fundo X com alta volatilidade: R$ 612,345.68"


# ------------------------------------------------------------------ streaming

def test_streaming_daily_metrics_matches_batch(spark, micro):
    from fundflow.streaming import refresh
    src = scratch_path(spark, "stream-src")
    micro.write.parquet(src)
    lines = refresh.ledger_stream(spark, src)
    q = (refresh.daily_metrics_stream(lines).writeStream.format("memory")
         .queryName("daily_stream_test").outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    got = to_output(spark.table("daily_stream_test"))
    p = FilterParams(dt.date(2000, 1, 1), dt.date(2100, 1, 1))
    want = to_output(flows.daily_metrics(filters.apply_filters(micro, p)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streaming_sink_to_parquet(spark, micro):
    from fundflow.streaming import refresh
    src = scratch_path(spark, "stream-src2")
    micro.write.parquet(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    lines = to_output(flows.daily_metrics(micro))
    q = refresh.start_daily_refresh(spark, src, out, ck, once=True)
    q.awaitTermination(120)
    got = to_output(refresh.read_daily_metrics(spark, out))  # the newest day is there
    assert got.exceptAll(lines).count() == 0 and lines.exceptAll(got).count() == 0
    # the same lines again, all of them late: every sum doubles, averages and extremes stay
    micro.write.mode("append").parquet(src)
    q = refresh.start_daily_refresh(spark, src, out, ck, once=True)
    q.awaitTermination(120)
    twice = to_output(flows.daily_metrics(micro.unionByName(micro)))
    got = to_output(refresh.read_daily_metrics(spark, out))
    assert got.exceptAll(twice).count() == 0 and twice.exceptAll(got).count() == 0


def test_merged_cubes_equal_one(micro_lf):
    from fundflow.plans import dashboard
    parts = [dashboard.daily_cube(micro_lf.filter(f"id_origem % 3 = {k}")) for k in range(3)]
    one = dashboard.daily_cube(micro_lf)
    both = dashboard.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    a, b = (to_output(dashboard.liquidity_metrics(c)) for c in (one, both))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert both.count() == one.count()


def test_scale_conf():
    from fundflow.session import scale_conf
    c = scale_conf(100 * 2 ** 40)  # 100 TiB in splits of 256 MiB, however many
    assert c["spark.sql.shuffle.partitions"] == "409600"
    assert scale_conf(10 * 2 ** 20)["spark.sql.shuffle.partitions"] == "200"
    assert scale_conf(1 << 40)["spark.sql.shuffle.partitions"] == "4096"


def test_adapt_mysql_style_pack(spark, micro):
    pack = {"queries": {"per_fund": """
        SELECT nmfundo, SUM(COALESCE(entrada, 0)) AS e, STDDEV(COALESCE(entrada, 0)) AS sd
        FROM WAREHOUSE.statement_lines
        WHERE DATE(dt_lancamento) BETWEEN %s AND %s
        {fund_filter}
        {custodian_filter}
        GROUP BY nmfundo"""}}
    adapted = rules.adapt_pack(pack, "WAREHOUSE.statement_lines")
    q = adapted["queries"]["per_fund"]
    assert "{ledger}" in q and "%s" not in q and "stddev_pop(" in q
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31), custodians=("btg",))
    res = rules.run_custom_analysis(spark, micro, adapted["queries"], p)
    assert not res.errors
    got = {r.nmfundo: (float(r.e), r.sd) for r in res.frames["per_fund"].collect()}
    assert got["Alfa"] == (100.0, 50.0) and got["Beta"] == (400.0, 100.0)


def test_thresholds_from_config():
    from fundflow.params import Thresholds
    t = Thresholds.from_mapping({"liquidity_ratio_min": 0.7, "concentration_threshold": "25",
                                 "cache_ttl": 1800})
    assert (t.liquidity_ratio_min, t.concentration_threshold, t.liquidity_ratio_max) == (0.7, 25.0, 1.5)
    assert t.extras == {"cache_ttl": 1800}


def test_refresh_job(spark, micro, tmp_path):
    from fundflow.plans import refresh_job
    store = scratch_path(spark, "job-ledger")
    sinks.write_ledger(micro, store)
    cfg = tmp_path / "app.yaml"
    cfg.write_text("analytics:\n  liquidity_ratio_min: 0.8\n  concentration_threshold: 30.0\n")
    out = scratch_path(spark, "job-out")
    args = refresh_job.parse(["--ledger", store, "--out", out, "--start", "2024-01-01",
                              "--end", "2024-01-31", "--config", str(cfg)])
    written = refresh_job.run(spark, args)
    assert {"kpis", "alerts", "liquidity_metrics", "concentration"} <= set(written)
    k = spark.read.parquet(written["kpis"]).first()
    assert (k.operation_count, k.total_volume) == (7, 940.0)
    assert spark.read.parquet(written["alerts"]).count() == 6


def test_display_orders(micro_lf):
    from fundflow.operators import flows as FL
    from fundflow.plans.presentation import ordered
    a1 = [(r.nmfundo, r.fonte) for r in ordered("liquidity_metrics", FL.liquidity_metrics(micro_lf)).collect()]
    assert a1 == [("Beta", "btg"), ("Alfa", "btg"), ("Alfa", "daycoval"), (None, "btg")]
    a3 = [r.concentration_pct for r in ordered("concentration", FL.concentration(micro_lf)).collect()]
    assert a3 == sorted(a3, reverse=True)
    a5 = [r.categoria for r in ordered("operation_summary", FL.operation_summary(micro_lf)).collect()]
    assert a5[0] == "Rendimento" and a5[-1] == "Outros"


def test_streaming_dashboard_refresh(spark, micro):
    from fundflow.streaming import refresh
    src = scratch_path(spark, "dash-src")
    micro.filter("id_origem <= 4").write.parquet(src)
    store, out, ck = (scratch_path(spark, n) for n in ("dash-store", "dash-out", "dash-ck"))

    def params(_batch):
        return MICRO_PARAMS

    q = refresh.start_dashboard_refresh(spark, src, store, out, ck, params, once=True)
    q.awaitTermination(300)
    from fundflow.sources.publish import published
    k = published(spark, out).read("kpis").first()
    assert k.operation_count == 4
    # a second file arrives; the next run appends it and refreshes the results
    micro.filter("id_origem > 4").write.mode("append").parquet(src)
    q = refresh.start_dashboard_refresh(spark, src, store, out, ck, params, once=True)
    q.awaitTermination(300)
    k = published(spark, out).read("kpis").first()
    assert (k.operation_count, k.total_volume) == (7, 940.0)
    assert readers.read_ledger(spark, store).count() == 8  # stored once each, incl. February


def test_read_ledger_from_catalog_with_renames(spark, micro):
    raw = micro.withColumnRenamed("nmfundo", "fund_name").withColumnRenamed("fonte", "custodian")
    raw.createOrReplaceTempView("statement_lines_test")
    led = readers.read_ledger_table(spark, "statement_lines_test",
                                    rename={"fund_name": "nmfundo", "custodian": "fonte"})
    assert led.columns == list(contract.LEDGER_COLUMNS)
    assert led.filter("nmfundo = 'Alfa' AND fonte = 'btg'").count() == 2


def test_newest_cutoff_prunes_before_top_k(spark, micro_lf):
    from fundflow.operators import extract as X
    got = [r.id_origem for r in X.extract(micro_lf, 3).collect()]
    assert sorted(got) == [5, 6, 7]  # 01-05, 01-04, 01-03 are the three newest
    assert sorted(r.id_origem for r in X.extract(micro_lf, 100).collect()) == [1, 2, 3, 4, 5, 6, 7]
    cut = micro_lf.select(X.newest_cutoff(micro_lf, 4)).first()[0]
    assert cut == dt.datetime(2024, 1, 2)  # 01-05, 01-04, 01-03 hold 3 lines; 01-02 reaches 4
    assert micro_lf.select(X.newest_cutoff(micro_lf, 100)).first()[0].year == 1  # cuts nothing
    # on the test tables the top-k sees about `limit` lines, not the whole period
    import __spark_entry__ as E
    led = E.ledger_for(spark, "/root/testdata/sf0.01", "orders")
    lf = filters.apply_filters(led, E.full("orders"))
    c = X.newest_cutoff(lf, 100)
    kept = lf.filter(F.col("dt_lancamento") >= c).count()
    assert 100 <= kept < 200 and lf.count() == 15000


def test_no_fund_is_cut_from_the_list(spark, micro):
    many = spark.range(1500).selectExpr("id", "concat('F', id) as nmfundo")
    led = many.join(micro.drop("nmfundo").limit(1)).select(*micro.columns)
    funds = filters.available_funds(led)
    assert funds.count() == 1500 and filters.fund_search(funds, "f1499").count() == 1


def test_checkpoint_dir_is_never_invented_on_a_cluster():
    from fundflow.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_adapted_template_leaves_literals():
    sql = rules.adapt_template(
        "SELECT STDDEV(x), 'ledger_view %s' FROM ledger_view JOIN my_ledger_view_2 -- %s\n"
        "WHERE a = %s AND b LIKE '%sale%' AND c LIKE \"%s'x\"", "ledger_view")
    assert sql == ("SELECT stddev_pop(x), 'ledger_view %s' FROM {ledger} JOIN my_ledger_view_2 -- %s\n"
                   "WHERE a = ? AND b LIKE '%sale%' AND c LIKE \"%s'x\"")


def test_evolution_alert_at_the_threshold(spark):
    evo = spark.createDataFrame([("F", 20.0000002), ("F", 0.0), ("G", 20.0), ("G", 0.0)],
                                "nmfundo string, pct_change double")
    m = evolution.evolution_metrics(evo)
    assert [r.fund for r in alerts.evolution_alerts(m, MICRO_AS_OF).collect()] == ["F"]


def test_evolution_stats_of_nothing(micro):
    none = evolution.balance_pct_change(micro.filter("false"))
    assert tuple(evolution.evolution_stats(none).first()) == (0, 0)


def test_cube_volatility_does_not_cancel(spark, micro):
    """Large flows that differ little, on many lines of one or several days."""
    from fundflow.plans import dashboard
    lines = spark.range(20_000).selectExpr(
        "id as id_origem", "'c' as fonte", "1L as id_carteira", "'F' as nmfundo", "'' as cnpj",
        "timestampadd(DAY, cast(id % 7 as int), timestamp_ntz'2024-01-01 00:00:00') as dt_lancamento",
        "cast(10000000000000 + 100 * (id % 2) as decimal(18,2)) as entrada",
        "cast(0 as decimal(18,2)) as saida", "cast(0 as decimal(18,2)) as saldo", "'' as lancamento")
    for lf in (lines, lines.withColumn("dt_lancamento", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))):
        for a1 in (flows.liquidity_metrics(lf), dashboard.liquidity_metrics(dashboard.daily_cube(lf))):
            assert a1.first().flow_volatility == 50.0


def test_pack_metrics(micro_lf):
    pack = rules.DEFAULT_METRICS | {"ticket": {"calculation": "SUM(daily_volume) / operation_count"}}
    got = {r.nmfundo: r for r in rules.pack_metrics(micro_lf, pack).collect()}
    for r in rules.rule_metrics(micro_lf).collect():
        assert tuple(got[r.nmfundo])[:4] == tuple(r)
    assert got["Alfa"].ticket == 400 / 3
    fired = rules.rule_alerts(rules.pack_metrics(micro_lf, pack), [
        {"name": "t", "condition": "ticket > 100", "severity": "warning",
         "message": "{fund_name}: {ticket:.1f}"}], MICRO_AS_OF).collect()
    assert "Alfa: 133.3" in {r.message for r in fired}
