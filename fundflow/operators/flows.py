"""Flow aggregations.

All aggregations are hash aggregations with map-side partial aggregation,
so a fund holding a large share of the rows is combined inside each input
partition before the shuffle; only one partial row per key per partition
moves.  Money sums stay DECIMAL (exact); the output edge casts to double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fundflow.functions import classify as C
from fundflow.functions.money import (
    dbl, entrada, flow, gross_volume, mean, ratio, rnd, saida, saldo,
)

FUND_KEYS = ("nmfundo", "fonte")
# stddev outputs are rounded so that the value does not depend on the
# order in which partial aggregates were merged
STD_DIGITS = 4


def _day() -> F.Column:
    return F.to_date(F.col("dt_lancamento"))


def liquidity_metrics(lf: DataFrame) -> DataFrame:
    """A1 (+F8): per (fund, custodian) flow statistics; zero-volume groups dropped.

    ``avg_daily_flow`` is the mean per *line* and ``flow_volatility`` the
    population standard deviation per line, as the reference's SQL computes.
    """
    f = flow()
    agg = lf.groupBy(*FUND_KEYS).agg(
        F.sum(entrada()).alias("total_entries"),
        F.sum(saida()).alias("total_exits"),
        F.sum(f).alias("net_flow"),
        F.count(F.lit(1)).alias("operation_count"),
        F.countDistinct(_day()).alias("active_days"),
        F.stddev_pop(f).alias("_std"),
        F.max(F.abs(f)).alias("max_daily_flow"),
        F.min(saldo()).alias("min_balance"),
        F.max(saldo()).alias("max_balance"),
        F.sum(gross_volume()).alias("_volume"),
    )
    return (agg.filter(F.col("_volume") > 0)
            .select(*FUND_KEYS, "total_entries", "total_exits", "net_flow", "operation_count",
                    "active_days",
                    mean(F.col("net_flow"), F.col("operation_count")).alias("avg_daily_flow"),
                    rnd(F.col("_std"), STD_DIGITS).alias("flow_volatility"),
                    "max_daily_flow", "min_balance", "max_balance"))


def daily_metrics(lf: DataFrame) -> DataFrame:
    """A2: per (date, fund, custodian) flows and balance statistics."""
    return (lf.groupBy(_day().alias("date"), *FUND_KEYS).agg(
        F.sum(entrada()).alias("daily_entries"),
        F.sum(saida()).alias("daily_exits"),
        F.sum(flow()).alias("daily_net_flow"),
        F.count(F.lit(1)).alias("daily_operations"),
        F.sum(saldo()).alias("_bal"),
        F.max(saldo()).alias("max_balance"),
        F.min(saldo()).alias("min_balance"),
    ).select("date", *FUND_KEYS, "daily_entries", "daily_exits", "daily_net_flow",
             "daily_operations", mean(F.col("_bal"), F.col("daily_operations")).alias("avg_balance"),
             "max_balance", "min_balance"))


def fund_volumes(lf: DataFrame) -> DataFrame:
    """First level of A3: gross volume and line count per (fund, custodian)."""
    return lf.groupBy(*FUND_KEYS).agg(
        F.sum(gross_volume()).alias("total_volume"),
        F.count(F.lit(1)).alias("operation_count"))


def grand_total(volumes: DataFrame) -> F.Column:
    """A4: total volume and line count over ``fund_volumes``, taken before the
    positive-volume filter, as one scalar subquery.

    Both columns are summed so that the subquery's grouped aggregate is the
    outer query's own: Spark then runs it, and reads the ledger, once.
    """
    return volumes.agg(F.struct(F.sum("total_volume").alias("volume"),
                                F.sum("operation_count").alias("lines")).alias("total")).scalar()


def concentration(lf: DataFrame) -> DataFrame:
    """A3 (+A4, J1, F9, C4): share of each (fund, custodian) in the total volume.

    The total (J1's one-row side) is summed over the grouped volumes as an
    uncorrelated scalar subquery, so no join is planned, no ``sum() OVER ()``
    window pulls every group into one partition, and the ledger is read once:
    both branches share the grouped aggregate's exchange.
    """
    return shares(fund_volumes(lf))


def shares(volumes: DataFrame) -> DataFrame:
    """Second level of A3 over (fund, custodian) volumes and line counts."""
    v = volumes.withColumn("_total", grand_total(volumes))
    pct = ratio(F.col("total_volume"), F.col("_total.volume")) * 100
    return (v.filter((F.col("total_volume") > 0) & (F.col("_total.lines") > 0))
            .select(*FUND_KEYS, "total_volume", "operation_count",
                    rnd(pct, 2).alias("concentration_pct"),
                    C.concentration_level(pct).alias("concentration_level")))


def operation_summary(lf: DataFrame) -> DataFrame:
    """A5 (+C3): per summary category; ``affected_funds`` ignores NULL funds."""
    f = flow()
    return (lf.groupBy(C.summary_category(F.col("lancamento")).alias("categoria")).agg(
        F.count(F.lit(1)).alias("total_operations"),
        F.sum(entrada()).alias("total_entries"),
        F.sum(saida()).alias("total_exits"),
        F.sum(f).alias("net_amount"),
        F.countDistinct("nmfundo").alias("affected_funds"),
        F.sum(F.abs(f)).alias("_abs"),
    ).select("categoria", "total_operations", "total_entries", "total_exits", "net_amount",
             "affected_funds",
             mean(F.col("_abs"), F.col("total_operations")).alias("avg_operation_size")))


def fund_daily(lf: DataFrame) -> DataFrame:
    """Per (fund, date): flows, gross volume and net flow -- the input of A8, A9 and L5."""
    return lf.groupBy("nmfundo", _day().alias("date")).agg(
        F.sum(gross_volume()).alias("daily_volume"),
        F.sum(flow()).alias("daily_balance_change"),
        F.sum(entrada()).alias("daily_entries"),
        F.sum(saida()).alias("daily_exits"),
        F.count(F.lit(1)).alias("daily_operations"))


def volume_concentration(lf: DataFrame) -> DataFrame:
    """Per fund MAX(daily volume) / AVG(daily volume)."""
    return fund_stats(fund_daily(lf)).select("nmfundo", "volume_concentration")


def balance_volatility(lf: DataFrame) -> DataFrame:
    """Per fund population stddev of the daily balance change (daily net flow)."""
    return fund_stats(fund_daily(lf)).select("nmfundo", "balance_volatility")


def fund_stats(daily: DataFrame, *more: F.Column) -> DataFrame:
    """A8 and A9 (and further aggregates) per fund over (fund, date) rows."""
    return daily.groupBy("nmfundo").agg(
        F.try_divide(dbl(F.max("daily_volume")),
                     dbl(F.sum("daily_volume")) / F.count(F.lit(1))).alias("volume_concentration"),
        rnd(F.stddev_pop("daily_balance_change"), STD_DIGITS).alias("balance_volatility"), *more)
