"""Dashboard refresh: one scan of the ledger feeds every daily-grained analysis.

Each dashboard rerun computes the KPI block, liquidity, concentration,
daily metrics, balance evolution and the rule-pack statistics.  Built
directly, each of those reads the ledger again.  They all reduce to
sufficient statistics per (date, fund, custodian), so ``daily_cube``
aggregates the lines once -- map-side combined, one shuffle of
pre-aggregated rows -- and ``refresh`` stores that cube (days x funds x
custodians rows, small) under the shared checkpoint folder.  Every
analysis is then derived from the stored cube without touching the
ledger.  Only line-grained operators (W1, the extract, A5's description
categories, the limited-extract KPIs) still read lines.

The population standard deviation of A1 comes from centred moments: each
cube row holds its lines' sum of squared deviations from their own mean, and
rows combine as ``sum(M2) + sum(n * (mean - m)^2)``, which neither
overflows nor cancels, at any number of lines.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fundflow.functions import classify as C
from fundflow.functions.money import dbl, entrada, flow, gross_volume, mean, ratio, rnd, saida, saldo, to_output
from fundflow.operators import alerts as L, evolution, flows, kpis as K, status
from fundflow.operators.filters import apply_filters
from fundflow.params import FilterParams, Thresholds
from fundflow.session import scratch_path
from fundflow.sources.publish import discard
from fundflow.sources.sinks import write_result


def daily_cube(lf: DataFrame) -> DataFrame:
    """Sufficient statistics per (date, fund, custodian)."""
    f = flow()
    nulls = sum((F.col(c).isNull().cast("long") for c in K.NULLABLE), F.lit(0).cast("long"))
    day = F.to_date("dt_lancamento")
    return lf.groupBy(day.alias("date"), "nmfundo", "fonte").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(entrada()).alias("e"),
        F.sum(saida()).alias("s"),
        F.sum(f).alias("f"),
        (F.var_pop(f) * F.count(F.lit(1))).alias("m2"),
        F.sum(gross_volume()).alias("gross"),
        F.max(F.abs(f)).alias("fabs"),
        F.sum(saldo()).alias("b"),
        F.min(saldo()).alias("bmin"),
        F.max(saldo()).alias("bmax"),
        F.sum(nulls).alias("nulls"),
        F.count_if(saldo() < 0).alias("neg"),
        # lines after midnight: with the date, enough to count lines after any as_of midnight
        F.count_if(F.col("dt_lancamento") > day.cast("timestamp_ntz")).alias("after_midnight"))


#: What alerts (but for their metadata) and summaries need of a cube.
ALERT_STATS = ("n", "e", "s", "f", "gross")


def shared(cube: DataFrame, columns: tuple[str, ...] = ALERT_STATS) -> DataFrame:
    """The cube for one query whose branches all start from it and need no more than ``columns``.

    The condition holds for every row and names all these columns, so each branch
    asks for the same aggregate: Spark plans one exchange, reads the ledger once
    and reuses it, with nothing written in between.
    """
    whole = F.col("n") > 0
    for c in columns:
        whole &= F.col(c).isNotNull()
    return cube.filter(whole)


def _about_group_mean(rows: DataFrame, *keys: str) -> DataFrame:
    """``m2`` of each row taken about the mean of its group instead of its own.

    The mean comes from a window over the group's cube rows (one a day, or one a
    batch), which shares its shuffle with the aggregate that follows.
    """
    group = Window.partitionBy(*keys)
    rows = rows.withColumn("_mean", mean(F.sum("f").over(group), F.sum("n").over(group)))
    apart = F.col("n") * F.pow(mean(F.col("f"), F.col("n")) - F.col("_mean"), 2)
    return rows.withColumn("m2", F.col("m2") + apart).drop("_mean")


def merged(cubes: DataFrame) -> DataFrame:
    """One cube from the cubes of disjoint sets of lines (batches), line order and overlap of days free."""
    keys = ("date", "nmfundo", "fonte")
    return _about_group_mean(cubes, *keys).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("n", "e", "s", "f", "m2", "gross", "b", "nulls", "neg", "after_midnight")),
        F.max("fabs").alias("fabs"), F.min("bmin").alias("bmin"), F.max("bmax").alias("bmax"))


def filtered(cube: DataFrame, p: FilterParams) -> DataFrame:
    """F1-F3 on a cube: its days and keys are the ledger's."""
    out = cube.filter(F.col("date").between(F.lit(p.start_date), F.lit(p.end_date)))
    out = out.filter(F.col("nmfundo").isin(*p.funds)) if p.funds else out
    return out.filter(F.col("fonte").isin(*p.custodians)) if p.custodians else out


def liquidity_metrics(cube: DataFrame) -> DataFrame:
    """A1 (+F8) from the cube; ``active_days`` is the number of cube rows."""
    g = _about_group_mean(cube, "nmfundo", "fonte").groupBy("nmfundo", "fonte").agg(
        F.sum("e").alias("total_entries"), F.sum("s").alias("total_exits"),
        F.sum("f").alias("net_flow"), F.sum("n").alias("operation_count"),
        F.count(F.lit(1)).alias("active_days"), F.sum("m2").alias("_m2"),
        F.max("fabs").alias("max_daily_flow"), F.min("bmin").alias("min_balance"),
        F.max("bmax").alias("max_balance"), F.sum("gross").alias("_volume"))
    n, sx = F.col("operation_count"), F.col("net_flow")
    var = F.col("_m2") / dbl(n)
    return (g.filter(F.col("_volume") > 0)
            .select("nmfundo", "fonte", "total_entries", "total_exits", "net_flow",
                    "operation_count", "active_days", mean(sx, n).alias("avg_daily_flow"),
                    rnd(F.sqrt(var), flows.STD_DIGITS).alias("flow_volatility"),
                    "max_daily_flow", "min_balance", "max_balance"))


def daily_metrics(cube: DataFrame) -> DataFrame:
    """A2 is the cube itself."""
    return cube.select(
        "date", "nmfundo", "fonte", F.col("e").alias("daily_entries"),
        F.col("s").alias("daily_exits"), F.col("f").alias("daily_net_flow"),
        F.col("n").alias("daily_operations"), mean(F.col("b"), F.col("n")).alias("avg_balance"),
        F.col("bmax").alias("max_balance"), F.col("bmin").alias("min_balance"))


def concentration(cube: DataFrame) -> DataFrame:
    """A3 from the cube."""
    return flows.shares(cube.groupBy("nmfundo", "fonte").agg(
        F.sum("gross").alias("total_volume"), F.sum("n").alias("operation_count")))


def fund_daily_stats(cube: DataFrame) -> DataFrame:
    """A8 + A9 from the cube."""
    return flows.fund_stats(cube.groupBy("nmfundo", "date").agg(
        F.sum("gross").alias("daily_volume"), F.sum("f").alias("daily_balance_change")))


def kpis(cube: DataFrame, p: FilterParams, as_of: dt.date) -> DataFrame:
    """A15 from the cube."""
    d = F.col("date")
    future = (F.when(d > F.lit(as_of), F.col("n"))
              .when(d == F.lit(as_of), F.col("after_midnight")).otherwise(F.lit(0)))
    days = cube.groupBy("date", "nmfundo").agg(
        *(F.sum(c).alias(c) for c in ("n", "e", "s", "b", "nulls", "neg")), F.sum(future).alias("future"),
        F.min("bmin").alias("bmin"))
    return K.kpis_from_sets(K.date_and_fund_sets(days), p, K._ts(as_of))


@dataclass
class Dashboard:
    cube: DataFrame
    frames: dict[str, DataFrame] = field(default_factory=dict)
    path: str | None = None  # of a cube stored for this dashboard alone

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def results(self) -> dict[str, DataFrame]:
        """The frames as sinks take them: money as double, no map columns."""
        return {name: to_output(df.drop("metadata")) for name, df in self.frames.items()}

    def release(self, spark: SparkSession) -> None:
        """Remove the stored cube; no frame can be read afterwards."""
        if self.path:
            discard(spark, self.path)


def alerts(cube: DataFrame, as_of: dt.date, t: Thresholds = Thresholds()) -> DataFrame:
    """L1-L3 combined."""
    by_fund = status.liquidity_status_by_fund(status.liquidity_status(liquidity_metrics(cube), t))
    evo = evolution.with_pct_change(daily_metrics(cube))
    return L.combine(L.liquidity_alerts(by_fund, as_of),
                     L.concentration_alerts(status.concentration_metrics(concentration(cube), t), as_of),
                     L.evolution_alerts(evolution.evolution_metrics(evo, t), as_of))


def derive(cube: DataFrame, p: FilterParams, as_of: dt.date,
           t: Thresholds = Thresholds()) -> Dashboard:
    a1 = liquidity_metrics(cube)
    a2 = daily_metrics(cube)
    a3 = concentration(cube)
    evo = evolution.with_pct_change(a2)
    k = kpis(cube, p, as_of)
    by_fund = status.liquidity_status_by_fund(status.liquidity_status(a1, t))
    conc = status.concentration_metrics(a3, t)
    evo_m = evolution.evolution_metrics(evo, t)
    frames = {
        "kpis": k,
        "liquidity_metrics": a1,
        "liquidity_status_by_fund": by_fund,
        "daily_metrics": a2,
        "concentration": a3,
        "concentration_metrics": conc,
        "concentration_overall": status.concentration_overall(a3, t),
        "balance_pct_change": evo,
        "evolution_metrics": evo_m,
        "fund_daily_stats": fund_daily_stats(cube),
        "kpi_alerts": L.kpi_alerts(k),
        "alerts": alerts(cube, as_of, t),
    }
    return Dashboard(cube, frames)


def refresh(spark: SparkSession, ledger: DataFrame, p: FilterParams, as_of: dt.date,
            t: Thresholds = Thresholds()) -> Dashboard:
    """Scan the filtered ledger once, store the daily cube under the shared
    checkpoint folder and derive every daily-grained analysis from it."""
    path = write_result(daily_cube(apply_filters(ledger, p)), scratch_path(spark, "daily-cube"))
    dash = derive(spark.read.parquet(path), p, as_of, t)
    dash.path = path
    return dash
