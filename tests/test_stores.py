"""Stored ledgers: summaries, skipping, newest partitions.  Published results: whole sets only."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from fundflow.operators import extract as X, filters, flows
from fundflow.params import FilterParams
from fundflow.plans import dashboard
from fundflow.session import scratch_path
from fundflow.sources import publish as P, readers, sinks


@pytest.fixture(scope="module")
def ledger(spark):
    return E.ledger_for(spark, SF_MID, "orders")


@pytest.fixture(scope="module")
def store(spark, ledger):
    return sinks.write_ledger(ledger, scratch_path(spark, "store"), "month", num_files=4)


@pytest.fixture(scope="module")
def events(spark):
    return E.ledger_for(spark, SF_MID, "events")


@pytest.fixture(scope="module")
def grouped(spark, events):
    """One month in one file of many small row groups."""
    return sinks.write_ledger(events, scratch_path(spark, "grouped"), num_files=1, row_group_bytes=8 << 10)


def rows_scanned(df):
    """Rows that the scan of an executed frame handed on, and files it opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, out = [plan], {}
    while nodes:
        node = nodes.pop()
        kids = node.children()
        nodes += [kids.apply(k) for k in range(kids.size())]
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan"):
            metrics = node.metrics()
            out = {k: metrics.apply(k).value() for k in ("numOutputRows", "numFiles", "numPartitions")
                   if metrics.contains(k)}
    return out


# ------------------------------------------------------------------ F4-F6 from the summary
def test_pickers_read_no_lines(spark, ledger, store):
    summary = readers.read_summary(spark, store)
    for pick in (filters.available_funds, filters.available_custodians):
        assert pick(summary).collect() == pick(ledger).collect()
        plan = pick(summary)._jdf.queryExecution().executedPlan().toString()
        assert "_summary" in plan and "dt_lancamento" not in plan and "customer.parquet" not in plan
    assert summary.agg(F.sum("n")).first()[0] == ledger.count()
    assert readers.read_ledger(spark, store).count() == ledger.count()  # its readers do not see the summary


def test_appended_lines_are_summed_up(spark, micro):
    path = scratch_path(spark, "appended")
    sinks.write_ledger(micro.filter("id_origem <= 3"), path)
    sinks.write_ledger(micro.filter("id_origem > 3"), path, mode="append")
    counts = readers.read_summary(spark, path)
    assert counts.agg(F.sum("n")).first()[0] == 8
    assert [r[0] for r in filters.available_funds(counts).collect()] == ["Alfa", "Beta", "Gama"]
    sinks.write_ledger(micro.filter("id_origem = 8"), path)  # written anew
    assert [r[0] for r in filters.available_funds(readers.read_summary(spark, path)).collect()] == ["Gama"]


# ------------------------------------------------------------------ F2, F3 skipping
def test_row_groups_of_other_funds_are_skipped(spark, events, grouped):
    whole = readers.read_ledger(spark, grouped)
    everything = rows_scanned(whole)["numOutputRows"]
    one = filters.funds(whole, ("FUNDO_7",))
    assert one.count() == filters.funds(events, ("FUNDO_7",)).count() > 0
    assert rows_scanned(one)["numOutputRows"] < everything / 3
    both = filters.custodians(one, ("C3",))
    assert both.count() == filters.custodians(filters.funds(events, ("FUNDO_7",)), ("C3",)).count()
    assert rows_scanned(both)["numOutputRows"] < rows_scanned(one)["numOutputRows"]
    none = filters.funds(whole, ("FUNDO_1x",))  # between two names
    assert rows_scanned(none)["numOutputRows"] < everything / 3 and none.count() == 0


# ------------------------------------------------------------------ O1 from stored counts
@pytest.mark.parametrize("start, end, limit, funds, months", [
    (dt.date(1995, 1, 1), dt.date(2001, 8, 1), 1, None, 2),
    (dt.date(1995, 1, 1), dt.date(2001, 8, 1), 300, None, 3),
    (dt.date(1997, 3, 10), dt.date(1999, 5, 20), 300, None, 4),
    (dt.date(1997, 3, 10), dt.date(1999, 5, 20), 300, ("NATION_3", "NATION_4"), 27),
    (dt.date(1995, 1, 1), dt.date(2001, 8, 1), 10 ** 6, None, 1000),
])
def test_newest_lines_open_the_last_partitions(spark, ledger, store, start, end, limit, funds, months):
    p = FilterParams(start, end, funds=funds, limit=limit)
    part = filters.apply_filters(readers.read_newest(spark, store, p), p)
    got = X.extract(part, limit).select("id_origem").collect()
    want = X.extract(filters.apply_filters(ledger, p), limit).select("id_origem").collect()
    assert sorted(got) == sorted(want)
    opened = rows_scanned(readers.read_newest(spark, store, p))
    assert opened["numPartitions"] <= months


def test_newest_lines_of_daily_partitions(spark, events):
    path = sinks.write_ledger(events, scratch_path(spark, "daily"), "day", num_files=2)
    p = FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 20), limit=100)
    part = filters.apply_filters(readers.read_newest(spark, path, p), p)
    assert rows_scanned(readers.read_newest(spark, path, p))["numPartitions"] == 1
    assert sorted(X.extract(part, 100).select("id_origem").collect()) == sorted(
        X.extract(filters.apply_filters(events, p), 100).select("id_origem").collect())


# ------------------------------------------------------------------ S4 publication
def test_readers_see_whole_sets(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "results")
    frame = lambda k: spark.range(5).selectExpr(f"{k} as version", "id")
    assert P.published(spark, root) is None
    P.publish(spark, {"a": frame(1), "b": frame(1)}, root)
    before = P.published(spark, root)
    seen = []

    write = P.write_result

    def watched(df, path, *args, **kw):
        """Between any two writes of a refresh a reader finds the set before it."""
        done = write(df, path, *args, **kw)
        now = P.published(spark, root)
        seen.append({n: now.read(n).first()["version"] for n in ("a", "b")})
        return done

    monkeypatch.setattr(P, "write_result", watched)
    P.publish(spark, {"a": frame(2), "b": frame(2)}, root)
    assert seen == [{"a": 1, "b": 1}] * 2
    assert {n: P.published(spark, root).read(n).first()["version"] for n in ("a", "b")} == {"a": 2, "b": 2}
    assert before.read("a").count() == 5  # opened before the switch: still there
    # a refresh that stops half way is never seen, and goes with the next one
    broken = spark.range(1).selectExpr("cast('x' as int) as version")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        P.publish(spark, {"a": frame(3), "b": broken}, root)
    assert P.published(spark, root).version == 2
    monkeypatch.setattr(P, "write_result", write)
    done = P.publish(spark, {"a": frame(4), "b": frame(4)}, root)
    assert done.names() == ["a", "b"] and P.versions(spark, root) == [2, done.version]
    assert sorted(n for n in os.listdir(root) if n.startswith("v=")) == [
        os.path.basename(os.path.dirname(x.path("a"))) for x in (P.published(spark, root, below=done.version), done)]


def test_a_replayed_version_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "batches")
    for k, value in ((0, 10), (1, 11), (1, 12), (2, 13)):
        P.publish(spark, {"x": spark.range(1).selectExpr(f"{value} as v")}, root, version=k)
    assert P.versions(spark, root) == [1, 2]
    assert P.published(spark, root, below=2).read("x").first()["v"] == 12
    with pytest.raises(ValueError):
        P.publish(spark, {}, root, keep=0)


def test_intermediates_go_when_released(spark, micro):
    p = E.FilterParams(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    dash = dashboard.refresh(spark, micro, p, p.end_date)
    assert dash["kpis"].count() == 1 and os.path.isdir(dash.path)
    dash.release(spark)
    assert not os.path.exists(dash.path)
    for outside in ("/tmp", os.path.join(dash.path, "inner"), os.path.dirname(dash.path)):
        with pytest.raises(ValueError):
            P.discard(spark, outside)


def test_streamed_cubes_stay_one_folder(spark, micro):
    from fundflow.streaming import refresh
    folder = scratch_path(spark, "cubes")
    for k in range(5):
        refresh._merge_cube(micro.filter(f"id_origem % 5 = {k}"), folder, k)
        refresh._merge_cube(micro.filter(f"id_origem % 5 = {k}"), folder, k)  # replayed
    assert P.versions(spark, folder) == [3, 4]
    got = dashboard.daily_metrics(refresh.read_cube(spark, folder))
    want = flows.daily_metrics(micro)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()
