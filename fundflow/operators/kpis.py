"""The KPI block (A10-A15) as one single-row DataFrame.

The lines are aggregated once to (date, fund), combined before the
shuffle; GROUPING SETS ((date), (fund)) then run over that small result, so
no line is ever doubled.  A single conditional aggregation over the sets
gives the whole row: totals, data-quality counts and the daily flow
volatility from the date rows (every line has a date), liquidity and
concentration from the fund rows.  The three largest funds (O4) are a
distributed top-k over the same sets, attached as a scalar subquery; it asks
for the same columns, so both branches share one exchange and the ledger is
read once.

The reference drops the NULL fund where it groups by fund in pandas
(A11, A12) and keeps every line in row totals (A10, A13, A14).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fundflow.functions import classify as C
from fundflow.functions.money import dbl, ratio, rnd
from fundflow.operators.extract import extract
from fundflow.params import FilterParams

# Fixed values that must equal the reference's:
#   enriched extract width 17 (10 ledger + 7 derived columns), the data-quality
#   denominator; quality penalties: 2 x null %, -10 when more than 10% of
#   balances are negative, -20 when any posting is in the future; score 0..100.
EXTRACT_WIDTH = 17
# columns of the enriched extract that can hold NULL once money is filled
NULLABLE = ("id_origem", "fonte", "id_carteira", "nmfundo", "cnpj", "lancamento")

KPI_COLUMNS = (
    "total_volume", "net_flow", "total_entries", "total_exits", "operation_count",
    "active_funds", "liquidity_ratio", "min_balance", "avg_balance", "critical_funds_count",
    "liquidity_risk_level", "concentration_index", "top_fund_percentage",
    "top_3_funds_percentage", "concentration_risk_level", "daily_avg_operations",
    "operational_efficiency", "flow_volatility", "operational_health", "last_update",
    "period_days", "data_quality_score",
)
TOTALS = ("total_volume", "net_flow", "total_entries", "total_exits", "operation_count",
          "active_funds", "period_days", "last_update")
LIQUIDITY = ("liquidity_ratio", "min_balance", "avg_balance", "critical_funds_count",
             "liquidity_risk_level")
CONCENTRATION = ("concentration_index", "top_fund_percentage", "top_3_funds_percentage",
                 "concentration_risk_level")
PERFORMANCE = ("daily_avg_operations", "operational_efficiency", "flow_volatility",
               "operational_health")
QUALITY = ("data_quality_score",)


def _ts(d: dt.date) -> Column:
    return F.lit(d).cast(T.TimestampNTZType())  # zone-free midnight


def _grouped(ex: DataFrame, now: Column) -> DataFrame:
    nulls = sum((F.col(c).isNull().cast("long") for c in NULLABLE), F.lit(0).cast("long"))
    days = (ex.withColumn("date", F.to_date("dt_lancamento"))
            .groupBy("date", "nmfundo")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("entrada").alias("e"),
                 F.sum("saida").alias("s"),
                 F.sum("saldo").alias("b"),
                 F.min("saldo").alias("bmin"),
                 F.sum(nulls).alias("nulls"),
                 F.count_if(F.col("saldo") < 0).alias("neg"),
                 F.count_if(F.col("dt_lancamento") > now).alias("future")))
    return date_and_fund_sets(days)


def date_and_fund_sets(days: DataFrame) -> DataFrame:
    """(date) and (fund) totals of rows that have both."""
    return days.groupingSets([["date"], ["nmfundo"]], "date", "nmfundo").agg(
        F.grouping_id().alias("gid"),
        *(F.sum(c).alias(c) for c in ("n", "e", "s", "b", "nulls", "neg", "future")),
        F.min("bmin").alias("bmin"))


def kpis(lf: DataFrame, p: FilterParams, as_of: dt.date) -> DataFrame:
    """The single KPI row over all lines of ``lf`` (a page size never cuts it)."""
    now = _ts(as_of)
    return kpis_from_sets(_grouped(extract(lf), now), p, now)


def kpis_from_sets(g: DataFrame, p: FilterParams, now: Column) -> DataFrame:
    """The KPI row from a (date) / (fund) grouping-sets aggregate with columns
    ``gid, nmfundo, n, e, s, b, bmin, nulls, neg, future`` -- built from lines
    (``kpis``) or from the daily cube (``plans.dashboard``)."""
    # grouping_id bit is set for the column *not* grouped: day set -> 1, fund set -> 2
    day = F.col("gid") == 1
    fund = (F.col("gid") == 2) & F.col("nmfundo").isNotNull()
    fmean = ratio(F.col("b"), F.col("n"))
    vol = F.abs(F.col("e")) + F.abs(F.col("s"))

    def on(cond, c):
        return F.when(cond, c)

    stats = g.agg(
        # date rows: A10 totals, A13 daily volatility, A14 counts
        F.sum(on(day, F.col("n"))).alias("rows"),
        F.sum(on(day, F.col("e"))).alias("te"),
        F.sum(on(day, F.col("s"))).alias("ts"),
        F.sum(on(day, F.col("nulls"))).alias("nulls"),
        F.sum(on(day, F.col("neg"))).alias("neg"),
        F.sum(on(day, F.col("future"))).alias("future"),
        F.count_if(day).alias("ndays"),
        F.stddev_samp(on(day, F.col("e") - F.col("s"))).alias("day_std"),
        # fund rows (NULL fund excluded): A10 active funds, A11, A12
        F.count_if(fund).alias("nfunds"),
        F.sum(on(fund, F.col("bmin"))).alias("sum_min"),
        F.sum(on(fund, fmean)).alias("sum_mean"),
        F.min(on(fund, F.col("bmin"))).alias("min_min"),
        F.avg(on(fund, fmean)).alias("mean_mean"),
        F.count_if(fund & (dbl(F.col("bmin")) < fmean * 0.1)).alias("critical"),
        F.sum(on(fund, vol)).alias("vtotal"),
        F.max(on(fund, vol)).alias("vmax"),
        F.sum(on(fund, F.pow(dbl(vol), 2))).alias("vsq"))
    # every fund has lines: the condition only keeps all columns of the shared aggregate in use
    whole = ((F.col("n") > 0) & (F.least("nulls", "neg", "future") >= 0)
             & F.col("b").isNotNull() & F.col("bmin").isNotNull())
    top3 = (g.filter(fund).select(F.when(whole, vol).alias("v")).orderBy(F.col("v").desc()).limit(3)
            .agg(F.sum("v").alias("v3")))
    return stats.withColumn("v3", top3.scalar()).select(*_kpi_columns(p, now))


def _kpi_columns(p: FilterParams, now: Column) -> list[Column]:
    n, te, ts = F.col("rows"), F.col("te"), F.col("ts")
    empty = F.coalesce(n, F.lit(0)) == 0

    def dflt(value: Column, default) -> Column:
        d = F.lit(default) if not isinstance(default, Column) else default
        return F.when(empty, d).otherwise(value)

    # A10
    total_volume = dbl(F.abs(te) + F.abs(ts))
    # A11 (pandas: mean.sum() > 0 else 0)
    liq_raw = F.when(F.col("sum_mean") > 0, ratio(F.col("sum_min"), F.col("sum_mean"))) \
        .otherwise(F.lit(0.0))
    # A12 (zero total: index 0, top 0, no top-3 and no risk label)
    vt = F.col("vtotal")
    has_volume = F.coalesce(vt, F.lit(0)) != 0
    top1_raw = ratio(F.col("vmax"), vt) * 100
    hhi = F.col("vsq") / F.pow(dbl(vt), 2) * 100
    # A13
    days_div = max(p.period_days, 1)
    ops_day = dbl(n) / days_div
    eff = F.when(ts != 0, F.abs(ratio(te, ts))).otherwise(F.lit(0.0))
    vol = F.when(F.col("ndays") > 1, F.col("day_std")).otherwise(F.lit(0.0))
    # A14
    null_pct = dbl(F.col("nulls")) / dbl(n * EXTRACT_WIDTH) * 100
    score = F.lit(100.0)
    score = F.when(F.col("nulls") > 0, score - null_pct * 2).otherwise(score)
    score = F.when(F.col("neg") > n * 0.1, score - 10).otherwise(score)
    score = F.when(F.col("future") > 0, score - 20).otherwise(score)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))

    none_d = F.lit(None).cast("double")
    return [
        dflt(total_volume, 0.0).alias("total_volume"),
        dflt(dbl(te - ts), 0.0).alias("net_flow"),
        dflt(dbl(te), 0.0).alias("total_entries"),
        dflt(dbl(ts), 0.0).alias("total_exits"),
        dflt(n, 0).cast("long").alias("operation_count"),
        dflt(F.col("nfunds"), 0).cast("long").alias("active_funds"),
        dflt(rnd(liq_raw, 4), 0.0).alias("liquidity_ratio"),
        dflt(dbl(F.col("min_min")), none_d).alias("min_balance"),
        dflt(rnd(F.col("mean_mean"), 6), none_d).alias("avg_balance"),
        dflt(F.col("critical"), F.lit(None).cast("long")).cast("long").alias("critical_funds_count"),
        dflt(C.liquidity_risk(liq_raw), C.UNKNOWN_M).alias("liquidity_risk_level"),
        dflt(F.when(has_volume, rnd(hhi, 2)).otherwise(F.lit(0.0)), 0.0).alias("concentration_index"),
        dflt(F.when(has_volume, rnd(top1_raw, 2)).otherwise(F.lit(0.0)), none_d)
        .alias("top_fund_percentage"),
        dflt(F.when(has_volume, rnd(ratio(F.col("v3"), vt) * 100, 2)), none_d)
        .alias("top_3_funds_percentage"),
        dflt(F.when(has_volume, C.concentration_risk(top1_raw)), C.UNKNOWN_M)
        .alias("concentration_risk_level"),
        dflt(rnd(ops_day, 2), 0.0).alias("daily_avg_operations"),
        dflt(rnd(eff, 4), none_d).alias("operational_efficiency"),
        dflt(rnd(vol, 2), none_d).alias("flow_volatility"),
        dflt(C.operational_health(ops_day, eff), C.UNKNOWN_F).alias("operational_health"),
        now.alias("last_update"),
        dflt(F.lit(p.period_days).cast("long"), F.lit(None).cast("long")).alias("period_days"),
        dflt(score, 0.0).alias("data_quality_score"),
    ]


def kpi_part(k: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A10..A14 are column subsets of the KPI row."""
    return k.select(*names)
